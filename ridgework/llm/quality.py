"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are computed once and written as a table.  Training sums the normal
equations within partitions and then row by row over partitions, so only a matrix of fixed size
reaches the driver; so do the calibration counts, one per score bin.  All labelled rows outside the
held-out fold take part, none is sampled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mapped, materialize, table
from .token_store import text_blocks

#: Statistics of a text; each is a float column of the written table.
STATS = (
    "log_chars", "letters", "upper", "digits", "blanks", "newlines", "stops", "commas", "pipes", "bangs", "signs", "high_bytes", "entropy",
    "word_len", "short_words", "distinct_words", "same_as_previous", "line_len", "distinct_lines", "sign_words", "upper_words",
)
N_FEATURES = 256
RIDGE = 1e-3
SEED = 7
THRESHOLD = 0.7
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: Raw scores are calibrated in bins of this width between LOW and HIGH.
BIN, LOW, HIGH = 1e-3, -1.0, 2.0

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_SIGN = np.isin(_BYTES, list(b"#$%&*+/<=>@[]^_`{}~\\|!"))
_SIGNS = b"#$%&*!|"


def statistics(text: str) -> list[float]:
    """STATS of a whole text; zeros if it is empty."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = data.split(), data.split(b"\n")
    w = len(words) or 1
    times = Counter(words)  # each distinct word is looked at once, for all its places
    sizes = list(map(len, words))
    return [
        math.log1p(n), counts[_LETTER].sum() / n, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[32] / n, counts[10] / n, counts[46] / w, counts[44] / w,
        counts[124] / w, counts[33] / w, counts[_SIGN].sum() / n, counts[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        min(sum(sizes) / w, 40.0), sum(s <= 3 for s in sizes) / w, len(times) / w, sum(map(eq, words, words[1:])) / w,
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x[-1] in _SIGNS for x in words) / w, data.isupper() + sum(c for x, c in times.items() if x.isupper()) / w,
    ]


def stats_of(batch: pa.RecordBatch) -> np.ndarray:
    """A row of STATS per row of a batch with doc_id and text, with the precision of the written table."""
    return np.concatenate([np.array([statistics(t or "") for t in texts], np.float32) for _, texts in text_blocks(batch)] or [np.zeros((0, len(STATS)), np.float32)])


def document_stats(docs: DataFrame) -> DataFrame:
    """Written table doc_id, fold and STATS; null text counts as empty."""
    schema = "doc_id long, " + ", ".join(f"{s} float" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stats_of(batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {s: pa.array(x[:, i], pa.float32()) for i, s in enumerate(STATS)})

    rows = mapped(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, schema)
    return materialize(rows.withColumn("fold", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(0)).cast("int")), "quality-stats")


@dataclass
class Model:
    """Of fixed size, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    bins: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), z / 6, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, LOW, HIGH) if self.weights is not None else np.full(len(x), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.bins, self.values) if self.bins is not None else raw, 0.0, 1.0)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, values) of the pooled blocks, to interpolate between."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, mean, weight):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, n_features: int = N_FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Train on labelled rows of ``stats`` outside the held-out fold; the fold CALIBRATE fits the calibration.

    Labels are a row per doc_id; several are averaged, null ones left out.  Without any label
    every score is 0.5; without two values of a label, or rows to calibrate on, the nearest that can be done.
    """
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = materialize(stats.filter(F.col("fold") != HELD_OUT).join(y, "doc_id"), "quality-train")
    agg = rows.agg(F.count(F.lit(1)).alias("n"), *(f(s).alias(f"{k}_{s}") for s in STATS for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    d = len(STATS)
    mean = np.array([agg[f"m_{s}"] or 0.0 for s in STATS])
    scale = np.array([agg[f"s_{s}"] or 1.0 for s in STATS])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / math.sqrt(d), (d, n_features)), rng.uniform(0, 2 * math.pi, n_features), None)
    if not agg["n"]:
        discard(rows)
        return model
    k = n_features + d + 1
    train = rows.filter(F.col("fold") != CALIBRATE)
    train, held = (rows, rows) if train.isEmpty() else (train, rows.filter(F.col("fold") == CALIBRATE))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for f in frames:
            z = model.features(f[list(STATS)].to_numpy(np.float64))
            total += z.T @ np.hstack([z, f[["y"]].to_numpy()])
        yield pd.DataFrame({"i": np.arange(k), "v": list(total)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "v": [np.sum(np.stack(f["v"].to_numpy()), axis=0)]})

    found = train.mapInPandas(sums, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()  # n_features rows
    a = np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])])
    model.weights = np.linalg.solve(a[:, :k] + ridge * max(1, agg["n"]) / k * np.eye(k), a[:, k])

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"b": np.round(model.raw(f[list(STATS)].to_numpy(np.float64)) / BIN).astype(np.int64), "y": f["y"]})

    counts = held.mapInPandas(raw, "b long, y double").groupBy("b").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # (HIGH - LOW) / BIN rows at most
    if counts:
        b, mean_y, n = (np.array([r[c] for r in counts], float) for c in ("b", "y", "n"))
        model.bins, model.values = isotonic(b * BIN, mean_y, n)
    discard(rows)
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``stats``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "fold": f["fold"], "score": model.score(f[list(STATS)].to_numpy(np.float64))})

    rows = stats.mapInPandas(run, "doc_id long, fold int, score double")
    return rows.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every row of ``docs``; texts alone decide, null counts as empty.  Rows with the same doc_id are scored each."""
    stats = document_stats(docs)
    return score(stats, fit(stats, labels))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more: a map, which needs no key of a row.

    Each row goes by its own text, whether its doc_id is null, repeated or neither; null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(stats_of(batch).astype(np.float64)) >= threshold, pa.bool_()))

    return mapped(docs, run, docs.schema)


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, trained on the labelled ones, predicts to be good."""
    stats = document_stats(docs)
    model = fit(stats, labels)
    discard(stats)
    return accepted(docs, model)


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
