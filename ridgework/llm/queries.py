"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, clustering, decontaminate, exact_dedup, html_extract, metric_search, mixing, ngram_join, packing, pseudonyms, quality, token_store, warc


def queries() -> dict:
    found = [
        pseudonyms.op1_feistel_pseudonyms, packing.op2_best_fit_packing, html_extract.op3_main_text, ngram_join.op4_ngram_jaccard_join,
        exact_dedup.op5_content_sort_dedup, metric_search.op6_mtree_top_k, quality.op7_quality_scores,
        warc.op8_warc_revisits, mixing.op9_source_mixing, token_store.op10_token_store,
        decontaminate.op11_benchmark_decontamination, clustering.op12_drake_clusters, alignment.op13_cross_tokenizer_alignment,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": ngram_join.SQL, "op5_content_sort_dedup": exact_dedup.SQL, "op6_mtree_top_k": metric_search.SQL, "op8_warc_revisits": warc.SQL, "op11_benchmark_decontamination": decontaminate.SQL,
            "op12_drake_clusters": clustering.SQL}
