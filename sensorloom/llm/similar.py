"""Groups of documents that share their shingles: exact similarity behind the SimHash stage.

Fingerprints alone miss most pairs near a similarity of 0.8, so the documents
that are compared are those with close fingerprints and, besides, those that
meet in a band of MinHash values.  Documents with the same shingles are one
class from the start.  Classes that meet are a file:

1. The closure of the files cuts the corpus into groups.  A group that fits in
   a task is compared there, on its whole shingle sets.
2. In files of larger groups some members, the heads, are compared with all
   members that they aren't linked with yet, pair by pair in Spark.
3. What is left is cut into groups again, and so on; from the second round on
   a file that fits is compared in one task, whatever its group.

A file is settled when every member outside its largest component has been a
head, as each link between two components is seen from both ends.  So a large
group of near copies costs about one row for each of its members; only a file
whose members are unlike each other costs more.  Heads are one at first, and
twice as many in each round, so rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common, simhash
from sensorloom.llm.components import components

#: MinHash values in a band, and bands.  Pairs that share 0.8 of their shingles meet in one of the bands but for 5 in
#: 100,000; those that share 0.5, in 54 of 100.
BAND, BANDS = 5, 25
#: Classes, and shingles of all of them, that one task compares.
CLASSES, SHINGLES = 4096, 1_000_000
#: Pairs with one class that one task compares.
PAIRS = 1024
SHAPES = T.StructType([T.StructField("row", T.LongType()), T.StructField("who", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's different shingles, in order; none if it has no word or is null."""
    found = simhash.WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER))
    some = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 7) for s in some], dtype=np.uint64))


#: Of each MinHash value: a factor, a term, and its weight in its band's number.
_TIMES, _PLUS, _MIX = (np.random.default_rng(5).integers(0, 1 << 62, size=(3, BAND * BANDS), dtype=np.uint64) * np.uint64(2) + np.array([[1], [0], [1]], dtype=np.uint64)).astype(np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of a set's MinHash values."""
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least * _MIX).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 11)


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))


def _shapes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        texts = batch.column("text").to_pylist()
        sets = [shingles(t, words) for t in texts]
        cells = [bands(h) if len(h) else np.zeros(0, np.uint64) for h in sets]
        columns = [pa.array(_signed([simhash.fingerprint(t, words) for t in texts])), pa.array(_signed([_key(h) for h in sets])), pa.array([len(h) for h in sets], pa.int64()), _lists(cells)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("who"), batch.column("mark"), *columns], names=SHAPES.names)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text", 2 << 20):
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(_signed([_key(h) for h in sets])), _lists(sets)], names=SETS.names)


def _alike(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is `least` or more."""
    size = np.array([len(h) for h in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]

    def near(x: int) -> np.ndarray:
        lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero(both / (size[x] + size - both) >= least)

    return simhash.forest(len(sets), near)


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (unit, key, shingles) come ordered by unit; each run is compared as a whole."""
    now: int | None = None
    keys: list[int] = []
    held: list[np.ndarray] = []

    def links() -> pa.RecordBatch:
        got = [(keys[x], keys[y]) for x, y in _alike(held, least)] if len(keys) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    for batch in batches:
        sets = batch.column("shingles")
        for k, (unit, key) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("key").to_pylist())):
            if unit != now:
                if keys:
                    yield links()
                now, keys, held = unit, [], []
            keys.append(key)
            held.append(sets[k].values.to_numpy().copy())
    if keys:
        yield links()


def compared(units: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): the links within each unit, for rows (unit, key); each unit is one task's work."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.join(sets, "key").select("unit", "key", "shingles").repartition(parts, "unit").sortWithinPartitions("unit")
    return rows.mapInArrow(partial(_compare, least=least), simhash.LINK)


def tested(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): those of different pairs (a, b) that share `least` of their shingles.  Pairs with one frequent a are shared out."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    left = parts.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "part", "x")
    right = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return right.join(left, ["a", "part"]).where(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b")


def _closed(files: DataFrame) -> DataFrame:
    """(key, group): the closure of files (file, key)."""
    return components(files.join(files.groupBy("file").agg(F.min("key").alias("b")), "file").select(F.col("key").alias("a"), "b")).select(F.col("node").alias("key"), F.col("component").alias("group"))


def _sized(rows: DataFrame, by: str) -> DataFrame:
    """(by, fits): whether one task can compare what rows (by, key, size) have in common."""
    return rows.groupBy(by).agg(((F.count("*") <= CLASSES) & (F.sum("size") <= SHINGLES)).alias("fits"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _heads(files: DataFrame, used: list[DataFrame], links: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """(file, key, at) of files that aren't settled, at being a member's component, and (file, a, at_a): about `many` new heads of each."""
    at = components(links).withColumnRenamed("node", "key")
    placed = common.cut(files.join(at, "key", "left").select("file", "key", F.coalesce("component", "key").alias("at")), "placed")
    main = placed.groupBy("file", "at").agg(F.count("*").alias("n")).groupBy("file").agg(F.max_by("at", F.struct("n", "at")).alias("main"))
    free = placed.join(main, "file").where("at <> main").select("file", "key", "at")
    if used:
        free = free.join(_all(used), ["file", "key"], "left_anti")
    free = common.cut(free, "free")
    place = F.xxhash64("key", "file")
    count = free.groupBy("file").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    share = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    heads = common.cut(free.join(count, "file").where((place == F.col("first")) | (share * F.col("n") < many - 1)).select("file", F.col("key").alias("a"), F.col("at").alias("at_a")), "heads-of-files")
    return placed.join(count.select("file"), "file"), heads


def linked(files: DataFrame, heads: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links whose closure is that of all pairs in one file that share `least`, for rows (file, key)."""
    found: list[DataFrame] = []
    used: list[DataFrame] = []
    level = 0
    while True:
        groups = common.cut(_closed(files).join(heads.select("key", "size"), "key"), "groups")
        sizes = common.cut(_sized(groups, "group"), "sizes")
        own = groups.join(sizes.where("fits"), "group").select(F.col("group").alias("unit"), "key")
        found.append(common.cut(compared(own, sets, least), "links"))
        large = groups.join(sizes.where("not fits"), "group").select("key", "size")
        if large.isEmpty():
            return _all(found)
        files = common.cut(files.join(large, "key"), "files")
        if level:
            fit = common.cut(_sized(files, "file"), "sizes")
            own = files.join(fit.where("fits"), "file").select(F.col("file").alias("unit"), "key")
            found.append(common.cut(compared(own, sets, least), "links"))
            files = files.join(fit.where("not fits").select("file"), "file")
        placed, head = _heads(files.select("file", "key"), used, _all(found), 1 << level)
        used.append(head.select("file", F.col("a").alias("key")))
        pairs = placed.join(head, "file").where("at <> at_a").select("a", F.col("key").alias("b")).distinct()
        found.append(common.cut(tested(pairs, sets, least), "links"))
        files = placed.select("file", "key")
        level += 1


def classes(docs: DataFrame, words: int, differing: int, agreeing: int, least: float) -> DataFrame:
    """(row, mark, fp, component_id, component) for docs (row, who, mark, text): groups of documents linked by pairs that share `least` or more of their shingles (Jaccard).

    Documents without a word are one group.  `who` finds a document's text
    again and may be anything that few share.
    """
    prints = common.cut(docs.mapInArrow(partial(_shapes, words=words), SHAPES), "prints")
    heads = common.cut(prints.groupBy("key").agg(F.min("row").alias("head"), F.min("who").alias("who"), F.min("size").alias("size"), F.count("*").alias("n"), F.first("bands").alias("bands")), "heads")

    filed = heads.select("key", F.posexplode("bands")).select("key", F.xxhash64("pos", "col").alias("file"))
    full = common.cut(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "full")
    met = common.join_counted(filed, full, "file", "n", exploded=True)
    # classes with one fingerprint, and the closest fingerprints
    of = common.cut(prints.where("size > 0").select("key", "fp").distinct(), "fingerprints")
    first = common.cut(of.groupBy("fp").agg(F.min("key").alias("first")), "firsts")
    equal = of.join(first, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first.select("fp"), differing, agreeing).distinct()
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = equal.union(near).where("a <> b").select(F.xxhash64("a", "b").alias("file"), F.explode(F.array("a", "b")).alias("key"))
    files = common.cut(met.select("file", "key").union(pairs.select("file", "key")), "files")

    ends = heads.join(files.select("key").distinct(), "key")
    read = docs.join(ends.select("who").distinct(), "who", "left_semi").select("text").mapInArrow(partial(_sets, words=words), SETS)
    sets = common.cut(read.join(ends.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")
    found = common.cut(simhash.named(heads, linked(files, heads, sets, least), "key"), "named")
    return common.join_counted(prints, found, "key", "n").select("row", "mark", "fp", "component_id", "component")
