import hashlib
import re
from collections import Counter

from ridgework.llm import decontaminate as d

from .edge import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [
    (1, LONG), (2, "Short ONE"), (10, "one two three four five six"), (3, None), (4, " ... "), (5, LONG.replace(" ", "-").upper()), (None, "null id"), (6, "é É x"), (7, LONG), (7, "a b"), (8, "solo"), (9, "p q r s t u v"),
]
DOCS = [
    (100, "before " + LONG + " after"), (101, "Clean; text"), (102, "a SHORT, one? yes short one"), (103, None), (104, ""), (105, LONG[:40] + " x " + LONG[30:]), (106, "é é x É x é É x"), (107, "solo"), (108, "--solo solo--"),
    (109, "p q r s t u v " * 3), (100, LONG), (None, LONG), (None, None), (110, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (111, " ".join(["w0"] * 3000) + " " + LONG), (112, "İstanbul K solo"), (113, "-- \u2003solo\u2003x"),
]


def tables(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(i, t, "en", 3, "x") for i, t in docs], "doc_id long, text string, lang string, n_chars long, at string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, `end` int")


def rows(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_report_equals_brute_force(spark):
    docs, items = tables(spark)
    assert rows(d.decontamination_report(docs, items)) == brute(DOCS, ITEMS)
    assert rows(d.decontamination_report(docs, items, window=3)) == brute(DOCS, ITEMS, 3)
    # more windows than are broadcast at once: the corpus is scanned in parts
    assert rows(d.decontamination_report(docs, items, most=5)) == brute(DOCS, ITEMS)


def test_edge_rows_and_empty_tables(spark):
    docs, items = tables(spark)
    edge = documents(spark)
    assert rows(d.decontamination_report(edge, items)) == brute([(r.doc_id, r.text) for r in edge.collect()], ITEMS)
    assert rows(d.decontamination_report(docs, items.limit(0))) == brute(DOCS, [])
    assert d.decontamination_report(docs.limit(0), items).count() == 0


def test_plan_has_no_python(spark):
    docs, items = tables(spark)
    plan = d.decontamination_report(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_removal(spark):
    docs, items = tables(spark)
    report = {(r.doc_id, r.n_words): r for r in d.decontamination_report(docs, items).collect()}
    assert [tuple(s) for s in report[(102, 6)].spans] == [(1, 3), (4, 6)]
    got = {(r.doc_id, r.text): r for r in d.remove_contamination(docs, items).collect()}
    texts = {k[1] for k in got}
    assert (100, "before after") in got and got[(100, "before after")].n_chars == len("before after")
    assert (101, "Clean; text") in got and got[(101, "Clean; text")].n_chars == 3 and (103, None) in got and (104, "") in got  # clean rows stay as they are
    assert "a? yes" in texts and "İstanbul K" in texts
    assert not any(k == (100, LONG) or k[1] == "solo" for k in got)  # hit in whole: the document goes
    assert {(r.doc_id, r.text) for r in d.remove_contamination(docs, items, whole_from=0).collect()} == {(i, t) for i, t in DOCS if not [1 for (k, *_, c) in brute([(i, t)], ITEMS) if c]}
