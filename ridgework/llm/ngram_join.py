"""Near-duplicate documents by an exact Jaccard join on word n-grams with several global orders.

Two sets of n and m shingles can only reach the similarity if, under any total order of all
shingles, they share one of their first n - ceil(t * n) + 1.  The orders used here put rare
shingles first (a class by corpus frequency, then one of several hashes), so passages that many
documents share come last and rarely meet.  A pair is verified only if it shares prefix shingles
under every order, and under the further ones so many that the rests can make up for the others.

* Frequencies: every task counts the shingles of its documents in large blocks and reports those that
  recur in a block.  What many of all documents share does so in some of B blocks, from about sqrt(2 B) documents on.  The most
  frequent ``MAX_FREQUENT`` are sent to all tasks: a table of fixed size, which only sets the orders.
* Equal sets become one class, with the smallest doc_id as its node.
* A first round takes two prefix shingles of each class only, and pairs each class with the smallest that has one of
  the two as well: it finds most of each group of near copies, whose many other shared shingles then pair nothing.
* Classes that share a prefix shingle under the first order form a bucket.  Take the first shingle that two similar sets
  share: i shingles of the one and j of the other come before it, so they overlap in n - i and m - j at most, and
  i + j is at most (1 - t) / (1 + t) of n + m.  So i is within that part of n, or j of m: such members may lead.
* A bucket's members are not paired all with all: in each round the smallest untried of those that may lead (one, then
  more) are its leaders and are compared with members of other components; then they are done.  Rounds end when no leader
  is left or the untried members of each bucket are in one component.  So groups of near copies take one pair a member,
  and no link between components is missed.
* Pairs are filtered by size and by the other orders, then verified on whole texts, streamed
  leader by leader; a leader of many members is split by salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, discard, mapped, materialize, numbered, partitions, rows_with_keys, table

WORDS = 5
#: Similarity of 80 in 100.
NUM, DEN = 80, 100
#: Orders beside the first.
MORE_ORDERS = 2
MAX_FREQUENT = 1 << 20
#: A block is counted when it holds so many shingles; those that recur in it are reported.
BLOCK_SHINGLES = 1 << 21
#: Texts whose words are hashed at once, in bytes.
BLOCK_BYTES = 1 << 20
#: Leaders of a bucket in the first round, and times more in each next.
LEADERS, MORE_LEADERS = 1, 8
#: Members that are verified against one copy of their leader.
PER_LEADER = 256
#: Candidate ids up to this number (16 MB) are broadcast to fetch texts; beyond it they are joined.
BROADCAST_IDS = 1_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Per text the 64-bit BLAKE2b hashes of its words, lower-cased (A-Z); each distinct word of the block is hashed once."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.flatten().dictionary_encode()
    found = coded.dictionary
    _, starts, data = found.buffers()
    ends = np.frombuffer(starts, np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
    raw, cut = data.to_pybytes() if data else b"", ends.tolist()  # slices of one buffer: values one by one are slow
    own = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(cut, cut[1:])]), "<u8")
    empty = ends[1:] == ends[:-1]
    at, bounds = coded.indices.to_numpy(), words.offsets.to_numpy()
    bounds = bounds - bounds[0]
    if empty.any():  # of white space at the ends
        real = ~empty[at]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        at = at[real]
    h = own[at] if len(at) else np.zeros(0, np.uint64)
    return [h[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def shingles_of(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of words with these hashes; of fewer words, one of all."""
    if not len(h):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) < k:
            x = np.uint64(len(h))
            for w in h:
                x = (x ^ w) * _MIX[1]
            return _mixed(np.array([x], np.uint64))
        n = len(h) - k + 1
        s = h[:n].copy()
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _MIX[i % len(_MIX)] + h[i : n + i]
        s = _mixed(s)
        s.sort()
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    return shingles_of(word_hashes(pa.array([text], pa.string()))[0], k)


def set_blocks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of the texts of a batch in blocks of bounded size."""
    texts, a, held = batch.column("text"), 0, 0
    for b, size in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += size
        if held >= BLOCK_BYTES or b == batch.num_rows:
            yield a, [shingles_of(h, k) for h in word_hashes(texts.slice(a, b - a))]
            a, held = b, 0


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


class Frequent:
    """Sorted frequent shingles with their classes, and which leading bits they have."""

    SHIFT = np.uint64(64 - 22)

    def __init__(self, shingles: np.ndarray, classes: np.ndarray):
        self.shingles, self.classes = shingles, classes
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[shingles >> self.SHIFT] = True


def prefixes_and_two(s: np.ndarray, frequent: Frequent, orders: int, num: int = NUM, den: int = DEN) -> tuple[list[np.ndarray], list[int]]:
    """The first shingles of a set under each order (sorted by the first one), as 32-bit hashes (equal shingles have equal ones), and two of the first order's.

    The two are the earliest of the prefix's most frequent class, which near copies mostly keep in common, and the earliest of all by hash.
    """
    if not len(s):
        return [np.zeros(0, np.int32)] * orders, []
    p, rank = prefix_length(len(s), num, den), np.zeros(len(s), np.uint64)
    if len(frequent.shingles) and len(s):
        some = np.flatnonzero(frequent.maybe[s >> Frequent.SHIFT])  # one byte read for most shingles
        at = np.minimum(np.searchsorted(frequent.shingles, s[some]), len(frequent.shingles) - 1)
        rank[some] = np.where(frequent.shingles[at] == s[some], frequent.classes[at], 0)
    out, x, two = [], s, s
    for i in range(orders):
        if i:
            with np.errstate(over="ignore"):
                x = _mixed(x + _MIX[i])
        key = (rank << np.uint64(58)) | (x >> np.uint64(6))
        first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
        if i == 0:
            first = first[np.lexsort((first, key[first]))]  # in this order, as positions count
        out.append((s[first] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        if i == 0:
            top = first[rank[first] == rank[first].max()]
            two = np.unique((s[[top.min(), first.min()]] >> np.uint64(32)).astype(np.uint32).view(np.int32))  # s is sorted
    return out, two.tolist()


def prefixes(s: np.ndarray, frequent: Frequent, orders: int, num: int = NUM, den: int = DEN) -> list[np.ndarray]:
    return prefixes_and_two(s, frequent, orders, num, den)[0]


def frequent_shingles(docs: DataFrame, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that recur most, MAX_FREQUENT at most, and their classes (log2 of the count), as ``Frequent`` takes them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = np.empty(BLOCK_SHINGLES, np.uint64), 0

        def flush() -> pa.RecordBatch:
            x = block[:size]
            x.sort()
            again = np.unique(x[1:][x[1:] == x[:-1]])
            counts = np.searchsorted(x, again, "right") - np.searchsorted(x, again)
            return pa.RecordBatch.from_pydict({"s": pa.array(again.view(np.int64)), "c": pa.array(counts.astype(np.int64))})

        for batch in batches:
            for _, sets in set_blocks(batch, k):
                for s in sets:
                    while len(s):
                        part, s = s[: BLOCK_SHINGLES - size], s[BLOCK_SHINGLES - size :]
                        block[size : size + len(part)] = part
                        size += len(part)
                        if size == BLOCK_SHINGLES:
                            yield flush()
                            size = 0
        if size:
            yield flush()

    found = mapped(docs, count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).select("s", F.floor(F.log2("c")).cast("int").alias("k"))
    found = materialize(found, "ngram-frequent")
    left, least = MAX_FREQUENT, None
    for r in found.groupBy("k").count().orderBy(F.col("k").desc()).collect():  # a row a class
        left -= r["count"]
        if left < 0:
            break
        least = r["k"]
    if least is None:
        discard(found)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.minimum(batch.column("k").to_numpy(), 63).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"s": pa.array([batch.column("s").to_numpy().tobytes()], pa.binary()), "k": pa.array([classes.tobytes()], pa.binary())})

    # nine bytes a shingle, in a row a batch: as rows of their own they would fill the driver
    rows = mapped(found.filter(F.col("k") >= least), packed, "s binary, k binary").collect()
    discard(found)
    s, c = np.frombuffer(b"".join(r["s"] for r in rows), np.uint64), np.frombuffer(b"".join(r["k"] for r in rows), np.uint8)
    order = np.argsort(s)
    return s[order], c[order]


def signatures(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Written table doc_id, n, digest of the set, two of its first prefix's shingles, and its prefixes p0, p1, ... under the orders."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, k))
    orders = 1 + MORE_ORDERS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(*shared.value)
        for batch in batches:
            for first, sets in set_blocks(batch, k):
                pre, two = zip(*(prefixes_and_two(s, frequent, orders, num, den) for s in sets))
                cols = {"doc_id": batch.column("doc_id").slice(first, len(sets)), "n": pa.array(map(len, sets), pa.int64()), "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())}
                cols["two"] = pa.array(two, pa.list_(pa.int32()))
                for i in range(orders):
                    # only equality of some element matters, so 16 bits do for the filters that follow the first order
                    cols[f"p{i}"] = pa.array([p[i] if i == 0 else (p[i] >> 16).astype(np.int16) for p in pre], pa.list_(pa.int32() if i == 0 else pa.int16()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n long, digest binary, two array<int>, p0 array<int>" + "".join(f", p{i} array<short>" for i in range(1, orders))
    signed = materialize(mapped(docs, sign, schema), "ngram-signatures")
    shared.destroy()
    return signed


def verify(pairs: DataFrame, docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) whose documents are similar.  pairs: a written table of distinct pairs."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ngram-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", F.ceil(F.col("c") / PER_LEADER).cast("int").alias("salts"))
    sizes = materialize(sizes, "ngram-leaders")
    members = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = members.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    leaders = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = leaders.unionByName(members).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sets = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b"))))
            for first, found in set_blocks(batch, k):
                for (a, salt, b), x in zip(keys[first:], found):
                    if b is None:
                        if of != (a, salt):
                            of, sets = (a, salt), []
                        sets.append(x)
                    elif any(similar(s, x, num, den) for s in sets):
                        out.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    links = materialize(mapped(rows, compare, "a long, b long").distinct(), "ngram-links")
    discard(ids, sizes)
    return links


def components(links: DataFrame) -> DataFrame:
    """Written table node, comp (smallest node reachable) of the nodes that have links.

    Each round takes the smallest label among neighbours and then the label of one's label; as paths halve, the rounds
    are about the logarithm of the longest.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("comp").alias("far"))
        after = materialize(step.join(jump, "now", "left").select("node", F.least("now", "far").alias("comp"), (F.least("now", "far") < F.col("comp")).alias("moved")), "labels")
        discard(labels)
        labels = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            discard(both)
            return labels


def enough(n: Column, p: Column, m: Column, q: Column, num: int, den: int) -> Column:
    """Whether sets of n and m shingles with prefixes p and q under one order can be similar.

    Common shingles up to the smaller of the two prefixes' ends are in both prefixes; beyond it the set whose prefix ends there
    has no more than its rest.  So the overlap is at most the prefixes' overlap and the larger rest.  Hashes that
    coincide within a prefix hide some of its overlap, so as many as coincide are granted.
    """
    hidden = F.size(p) - F.size(F.array_distinct(p)) + F.size(q) - F.size(F.array_distinct(q))
    both = F.size(F.array_intersect(p, q))
    rest = F.greatest(n - F.size(p), m - F.size(q))
    return (both > 0) & ((num + den) * (both + hidden + rest) >= num * (n + m))


def near_groups(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of ``docs``.

    Null and blank texts have no shingles and are linked with nothing.  A null doc_id is linked with nothing
    and its component_id is null.  Rows with the same doc_id are taken by their own texts each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = signatures(docs, k, num, den)
    named = signed.filter("n > 0 AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("two", *(f"p{i}" for i in range(1 + MORE_ORDERS)))]
    classes = materialize(named.groupBy("n", "digest").agg(F.min("doc_id").alias("node"), *firsts), "ngram-classes")
    may_lead = (num + den) * F.col("i") <= (den - num) * F.col("n")
    tokens = classes.select(F.posexplode("p0").alias("i", "t"), "node", "n")
    shared = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.bool_or(may_lead).alias("some")).filter("c > 1 AND some").select("t")
    shared = materialize(shared, "ngram-shared")
    members = materialize(tokens.join(shared, "t"), "ngram-members")
    discard(shared)
    filters = classes.select("node", "n", *(f"p{i}" for i in range(1, 1 + MORE_ORDERS)))

    links, tested = [], []

    def lead(left: DataFrame, count: int, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Compare the first ``count`` members of each bucket with its others; the leaders, and the components of all links so far (``comps`` before)."""
        leads = left.filter(may_lead)
        if count == 1:  # combined before the shuffle, as some bucket may hold much of all
            leads = leads.groupBy("t").agg(F.min(F.struct("node", "comp", "n", "i")).alias("l")).select("t", "l.*")
        else:
            leads = leads.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("node"))).filter(F.col("r") <= count)
        leads = materialize(leads.select("t", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("i").alias("i_a")), "ngram-leads")
        overlap = F.least(F.col("n") - F.col("i"), F.col("n_a") - F.col("i_a"))
        pairs = left.join(leads, "t").filter((F.col("comp") != F.col("comp_a")) & (den * F.least("n", "n_a") >= num * F.greatest("n", "n_a")) & ((num + den) * overlap >= num * (F.col("n") + F.col("n_a"))))
        pairs = pairs.select("a", F.col("node").alias("b")).distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        tested.append(pairs)
        a = filters.select(F.col("node").alias("a"), F.col("n").alias("n_a"), *(F.col(f"p{i}").alias(f"a{i}") for i in range(1, 1 + MORE_ORDERS)))
        both = pairs.join(a, "a").join(filters.withColumnRenamed("node", "b"), "b")
        for i in range(1, 1 + MORE_ORDERS):
            both = both.filter(enough(F.col("n_a"), F.col(f"a{i}"), F.col("n"), F.col(f"p{i}"), num, den))
        found = materialize(both.select("a", "b").distinct(), "ngram-candidates")
        if comps is not None and found.isEmpty():
            discard(found)
            return leads, comps
        links.append(verify(found, docs, k, num, den))
        discard(found, *([comps] if comps is not None else []))
        return leads, components(reduce(DataFrame.unionByName, links))

    def still_open(left: DataFrame, comps: DataFrame) -> DataFrame:
        """The members, with their components, of buckets that hold several components."""
        left = left.join(comps, "node", "left").select("t", "node", "n", "i", F.coalesce("comp", "node").alias("comp"))
        open_ = left.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or(may_lead).alias("some")).filter("lo <> hi AND some").select("t")
        open_ = materialize(open_, "ngram-open")
        after = materialize(left.join(open_, "t"), "ngram-left")
        discard(open_)
        return after

    leads, comps = lead(classes.select(F.explode("two").alias("t"), F.lit(0).alias("i"), "node", "n", F.col("node").alias("comp")), 1, None)
    left, count = still_open(members, comps), LEADERS
    discard(leads, members)
    while not left.isEmpty():
        before = left
        leads, comps = lead(left, count, comps)
        done = materialize(leads.groupBy("t").agg(F.max("a").alias("done")), "ngram-done")
        left = left.drop("comp").join(done, "t", "left").filter(F.col("done").isNull() | ~may_lead | (F.col("node") > F.col("done"))).drop("done")
        left = still_open(left, comps)
        discard(before, leads, done)
        count *= MORE_LEADERS
    names = materialize(classes.join(comps, "node", "left").select("n", "digest", F.coalesce("comp", "node").alias("component_id")), "ngram-names")
    out = materialize(signed.select("doc_id", "n", "digest").join(names, ["n", "digest"], "left").select("doc_id", "n", "component_id"), "ngram-groups")
    discard(left, comps, classes, signed, names, *links, *tested)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id (null last), of several the one of the smallest hash of the text.

    Rows are linked by a key of their own, so rows with a null or a repeated doc_id are compared like any others.
    """
    rows = numbered(docs, "ngram-docs")
    groups = near_groups(rows.select(F.col(ROW).alias("doc_id"), "text"))
    ranks = rows.select(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), ROW).alias("_rank"))
    first = groups.select(F.col("doc_id").alias(ROW), "component_id").join(ranks, ROW).groupBy("component_id").agg(F.min("_rank").alias("_rank"))
    kept = materialize(first.select(F.col("_rank")[ROW].alias(ROW)), "ngram-kept")
    discard(groups)
    return rows_with_keys(rows, kept).select(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the smallest doc_id reachable; for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(node, comp) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT e.a, min(c.comp) FROM c JOIN e ON e.b = c.node JOIN recurring.c AS o ON o.node = e.a GROUP BY e.a, o.comp HAVING min(c.comp) < o.comp)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""
