"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into b blocks.  Two fingerprints that differ in at
most d bits agree on b - d whole blocks at least, so each fingerprint is filed
under every choice of b - d blocks, and only fingerprints filed together are
compared.  b is d + 3, whatever the corpus: three blocks must agree (27 bits
for d = 4), so a file is short up to billions of fingerprints, and the number of
files that one is in, 35 for d = 4, stays the same.

Equal fingerprints are one class from the start.  A file of ordinary length is
compared in one task.  A longer one (a large group of near copies) is not: of
its fingerprints every number within half of d bits is listed, and those with
one such number in common are linked.  Two fingerprints have one in common if
and only if they differ in d bits at most, so this finds the same links, with
rows in proportion to the fingerprints and no pair to verify.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common
from sensorloom.llm.components import components

PRINT = T.StructType([T.StructField("row", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIDDLE = T.StructType([T.StructField("middle", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Fingerprints of a file that one task compares; where a ball holds more numbers than that, as many as it holds.
LONGEST = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of a whole text; zero if it has no word or is null.

    A-Z are lower-cased; shingles of `words` words, repeats included, are
    hashed with XXH64 (UTF-8, seed 42); a bit is 1 if it is set in over half
    of the hashes.
    """
    if not text:
        return 0
    # words are joined by single spaces, so each shingle is a slice
    found = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return 0
    line = b" ".join(found)
    stop = (np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found))) + np.arange(len(found))).tolist()
    start = [0, *(x + 1 for x in stop[:-1])]
    last = stop[words - 1 :] or stop[-1:]
    digest = xxhash.xxh64_intdigest
    n, ones = len(last), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        some = [digest(line[s:e], 42) for s, e in zip(start[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        ones += np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("mark"), pa.array(fps)], names=PRINT.names)


def fingerprints(rows: DataFrame, words: int = 4) -> DataFrame:
    """(row, mark, fp) of rows (row, mark, text); fp is the fingerprint as a signed 64-bit integer."""
    return rows.select("row", "mark", "text").mapInArrow(partial(_fingerprints, words=words), PRINT)


def _masks(blocks: int, differing: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << hi - lo) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(some) for some in combinations(block, blocks - differing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def joined(label: np.ndarray, x: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links row x with those of the other rows that its component does not hold yet; labels of components are kept in an array."""
    others = others[label[others] != label[x]]
    while len(others):  # as often as this row joins two components
        y = int(others[0])
        old, new = label[y], label[x]
        yield x, y
        label[label == max(old, new)] = min(old, new)
        others = others[label[others] != label[x]]


def forest(n: int, near: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between n rows; near(x) gives the rows that are linked with x.

    Rows of the largest component needn't look around themselves: every link
    from it to another component is seen from that one's rows.  So a group of
    copies costs a few looks, not one for each row.
    """
    label, looked = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        rest = np.flatnonzero((label != np.bincount(label, minlength=n).argmax()) & ~looked)
        if not len(rest):
            return
        x = int(rest[0])
        looked[x] = True
        yield from joined(label, x, near(x))


def _within(fp: np.ndarray, differing: int) -> Iterator[tuple[int, int]]:
    if len(fp) == 2:
        if (int(fp[0]) ^ int(fp[1])).bit_count() <= differing:
            yield 0, 1
        return
    yield from forest(len(fp), lambda x: np.flatnonzero(np.bitwise_count(fp ^ fp[x]) <= differing))


def _compare(batches: Iterator[pa.RecordBatch], differing: int) -> Iterator[pa.RecordBatch]:
    """Rows (file, fp) come ordered by file; each run is one file."""
    now: int | None = None
    held: list[np.ndarray] = []
    a: list[int] = []
    b: list[int] = []

    def close() -> None:
        fp = np.concatenate(held)
        for x, y in _within(fp.view(np.uint64), differing):
            a.append(int(fp[x]))
            b.append(int(fp[y]))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return batch

    for batch in batches:
        file, fp = batch.column("file").to_numpy(), batch.column("fp").to_numpy()
        change = np.flatnonzero(np.diff(file)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(file)]):
            if hi > lo:
                if held and file[lo] != now:
                    close()
                    held = []
                now = file[lo]
                held.append(fp[lo:hi])
        if a:
            yield out()
    if held:
        close()
    if a:
        yield out()


def ball(radius: int) -> np.ndarray:
    """All numbers of 64 bits with at most `radius` bits set."""
    return np.array([sum(1 << k for k in some) for r in range(radius + 1) for some in combinations(range(64), r)], dtype=np.uint64)


def _linked(run: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Links of neighbouring rows of equal runs, each once."""
    same = run[1:] == run[:-1]
    pair = np.unique(np.stack([fp[:-1][same], fp[1:][same]]), axis=1)
    pair = pair[:, pair[0] != pair[1]]
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def _middles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Every number within `radius` bits of a fingerprint with that fingerprint; of those in one batch, neighbours are
    linked at once, in rows (a, b) without a middle, and one goes on."""
    flips = ball(radius)
    step = max(1, (1 << 20) // len(flips))
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), step):
            own = fps[at : at + step]
            middle = (own[:, None] ^ flips[None, :]).ravel().view(np.int64)
            fp = np.repeat(own, len(flips)).view(np.int64)
            order = np.argsort(middle, kind="stable")
            middle, fp = middle[order], fp[order]
            some = _linked(middle, fp)
            first = np.concatenate([[True], middle[1:] != middle[:-1]])
            n, m = some.num_rows, int(first.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(n, np.int64), middle[first]]), mask=np.arange(n + m) < n), pa.array(np.concatenate([some.column("a").to_numpy(), fp[first]])), pa.array(np.concatenate([some.column("b").to_numpy(), np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)], names=MIDDLE.names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (middle, a) come ordered by middle: neighbours with one middle are linked."""
    last = None
    for batch in batches:
        middle, fp = batch.column("middle").to_numpy(), batch.column("a").to_numpy()
        if not len(fp):
            continue
        if last is not None:
            middle, fp = np.concatenate([[last[0]], middle]), np.concatenate([[last[1]], fp])
        last = middle[-1], fp[-1]
        yield _linked(middle, fp)


def links(fps: DataFrame, differing: int = 4, agreeing: int = 3) -> DataFrame:
    """(a, b): links between different fingerprints whose transitive closure is that of all pairs within `differing` bits, an even number.

    fps has one column fp of distinct fingerprints; `agreeing` is the number
    of blocks that must agree, out of that many more than `differing`; every
    number finds the same links.
    """
    if differing % 2:
        raise ValueError("differing must be even")
    spark = fps.sparkSession
    masks = _masks(differing + agreeing, differing)
    which = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    filed = fps.select("fp", which).select("fp", F.xxhash64("pos", "col").alias("file"))
    full = common.cut(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "full")
    shared = common.join_counted(filed, full, "file", "n", exploded=True)
    radius = differing // 2
    longest = max(LONGEST, sum(comb(64, r) for r in range(radius + 1)) if differing > 4 else 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = shared.where(F.col("n") <= longest).select("file", "fp")
    found = short.repartition(parts, "file").sortWithinPartitions("file").mapInArrow(partial(_compare, differing=differing), LINK)
    if full.where(F.col("n") > longest).isEmpty():
        return found
    some = common.cut(shared.where(F.col("n") > longest).select("fp").distinct(), "long-files")
    around = common.cut(some.mapInArrow(partial(_middles, radius=radius), MIDDLE), "middles")
    met = around.where("middle is not null").select("middle", "a").repartition(parts, "middle").sortWithinPartitions("middle").mapInArrow(_meet, LINK)
    return found.union(around.where("middle is null").select("a", "b").distinct()).union(met.distinct())


def named(heads: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id, component) for heads (key, head, n) and links (a, b) of keys.

    Nodes are heads with their keys, those without a head last, so that the
    least node of a component names it.  A hash table of nodes is many times
    their file, by whose size Spark decides, so they never go by broadcast.
    """
    node = F.struct(F.col("head").isNull().alias("none"), "head", F.col(key).alias("key"))
    nodes = heads.select(F.col(key).alias("key"), node.alias("node")).hint("merge")
    ends = pairs.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("x")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
    found = components(ends, "x", "y").select(F.col("node.key").alias(key), F.col("component").alias("at"))
    at = F.coalesce("at", node)
    return heads.join(found.hint("merge"), key, "left").select(key, "n", at["head"].alias("component_id"), at["key"].alias("component"))


def classes(prints: DataFrame, differing: int = 4, agreeing: int = 3) -> DataFrame:
    """Rows (row, fp) with component_id, the smallest row reachable over links of at most `differing` bits, and component, a number of the group.

    Equal fingerprints are linked, zero like any other.  A null row id joins
    its group and never names it, unless no other does.
    """
    heads = common.cut(prints.groupBy("fp").agg(F.min("row").alias("head"), F.count("*").alias("n")), "heads")
    found = common.cut(named(heads, links(heads.select("fp"), differing, agreeing), "fp"), "named")
    return common.join_counted(prints, found, "fp", "n").select(*prints.columns, "component_id", "component")


def _grouped(docs: DataFrame, words: int, differing: int, agreeing: int, similar: float | None, id_col: str, text_col: str) -> DataFrame:
    """(row, mark, fp, component_id, component) of near_duplicates(); component tells groups without an id apart."""
    row, mark = F.col(id_col).cast("long"), common.row_hash(docs)
    rows = docs.select(row.alias("row"), mark.alias("mark"), F.col(text_col).alias("text"))
    if similar is None:
        return classes(common.cut(fingerprints(rows, words), "prints"), differing, agreeing)
    from sensorloom.llm import similar as exact

    return exact.classes(rows.withColumn("who", F.coalesce("row", "mark")), words, differing, agreeing, similar)


def near_duplicates(docs: DataFrame, words: int = 4, differing: int = 4, agreeing: int = 3, similar: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    With `similar`, only documents that share that much of their shingles
    (Jaccard) are linked.  Candidates are fingerprints within `differing` bits
    and MinHash bands that agree, so of two documents at just 0.8 that no other
    links, 5 pairs in 100,000 stay apart; the more alike, the fewer.  Null and empty
    texts and texts of white space have fingerprint zero and so are one group.
    Rows that repeat come back as often as they are there; an empty table gives
    no rows; other columns are not returned.
    """
    found = _grouped(docs, words, differing, agreeing, similar, id_col, text_col)
    return found.select(F.col("row").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, differing: int = 4, agreeing: int = 3, similar: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays, whole and unchanged.

    Of rows with one id in a group the one with the smallest hash of all its
    columns stays, once.  A document without an id stays only if its group has
    no other with one.
    """
    found = _grouped(docs, words, differing, agreeing, similar, id_col, text_col)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("row").isNull().alias("none"), F.coalesce("row", F.lit(0)).alias("row"), "mark")).alias("pick")).select("pick.none", "pick.row", "pick.mark")
    none, row, mark = (common.fresh(docs, x) for x in ("none", "row", "mark"))
    # three keys that are never null, so that the join and the removal of repeats share one shuffle
    rows = docs.withColumns({none: F.col(id_col).cast("long").isNull(), row: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), mark: common.row_hash(docs)})
    return rows.join(kept.toDF(none, row, mark), [none, row, mark], "left_semi").dropDuplicates([none, row, mark]).select(*docs.columns)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, at most four differing bits."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
