"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (at most `capacity` bins, whatever the
corpus) reaches the driver.  There a plan is made over lengths and counts:
the longest length left leaves a gap; an index of the sums of one, two and
three lengths says whether some available lengths fill it exactly; if none
do, the best-fitting length goes in and the rest of the gap is tried again.
A combination is taken as often as its counts allow, so each step uses up a
length, and the plan's size depends on the capacity alone.  Pieces then find
their place by their rank among the pieces of their length: ranks are prefix
sums over the tasks that cut the pieces, so no group of equal lengths is ever
gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common, wordbpe

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)
PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Encodes, cuts, and numbers the pieces of each length within the task."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    enc = wordbpe.encoder(tokenizer)
    end = np.array([end_id], dtype="<u4")
    seen = [0] * (capacity + 1)
    for batch in common.rows(batches, "text"):
        out: list[tuple] = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_many(batch.column("text").to_pylist())):
            ids = np.concatenate([np.frombuffer(raw, dtype=enc.dtype).astype("<u4"), end])
            for piece, at in enumerate(range(0, len(ids), capacity)):
                some = ids[at : at + capacity]
                out.append((doc, piece, at, len(some), zlib.crc32(some.tobytes()), task, seen[len(some)]))
                seen[len(some)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=PIECES.names)


class _Sums:
    """Which gaps one, two or three available lengths fill exactly, as bit sets indexed by the sum."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.mask = (1 << len(counts)) - 1
        self.one = sum(1 << n for n, c in enumerate(counts) if c and n)
        self.two: int | None = None

    def used_up(self, length: int) -> None:
        self.one &= ~(1 << length)
        self.two = None

    def _pairs(self) -> int:
        """Sums of two available lengths; kept until a length is used up.  (A length with one piece left may pair
        with itself here; fill() checks the counts.)"""
        if self.two is None:
            two, rest = 0, self.one
            while rest:
                low = rest & -rest
                two |= self.one << (low.bit_length() - 1)
                rest ^= low
            self.two = two & self.mask
        return self.two

    def _pair(self, gap: int, taken: int = 0) -> list[int] | None:
        """The pair with the largest member; `taken` is a length of which one piece is spoken for."""
        near = self.one & ((1 << gap) - 1)
        while near:
            a = near.bit_length() - 1
            b = gap - a
            if b > a:
                return None
            if self.one >> b & 1:
                need = {a: 1}
                for x in (b, taken):
                    if x:
                        need[x] = need.get(x, 0) + 1
                if all(self.counts[x] >= n for x, n in need.items()):
                    return [a, b]
            near ^= 1 << a
        return None

    def fill(self, gap: int) -> list[int] | None:
        if gap <= 0 or not self.one:
            return None
        if self.one >> gap & 1:
            return [gap]
        two = self._pairs()
        if two >> gap & 1 and (pair := self._pair(gap)):
            return pair
        near = self.one & ((1 << gap) - 1)
        while near:
            a = near.bit_length() - 1
            if 3 * a < gap:
                return None
            if two >> (gap - a) & 1 and (pair := self._pair(gap - a, a)) and pair[0] <= a:
                return [a, *pair]
            near ^= 1 << a
        return None

    def best(self, gap: int) -> int:
        return (self.one & ((1 << gap + 1) - 1)).bit_length() - 1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence's pieces, number of such sequences), for the given number of pieces of each length."""
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} doesn't fit in {capacity}")
        left[n] += c
    sums, made = _Sums(left), []
    while sums.one:
        head = sums.one.bit_length() - 1
        members, gap = [head], capacity - head
        spent = {head: 1}
        left[head] -= 1
        if not left[head]:
            sums.used_up(head)
        while gap:
            some = sums.fill(gap)
            if some is None:
                n = sums.best(gap)
                if n <= 0:
                    break
                some = [n]
            for n in some:
                members.append(n)
                spent[n] = spent.get(n, 0) + 1
                left[n] -= 1
                gap -= n
                if not left[n]:
                    sums.used_up(n)
        again = min(left[n] // k for n, k in spent.items())
        if again:
            for n, k in spent.items():
                left[n] -= again * k
                if not left[n]:
                    sums.used_up(n)
        made.append((members, 1 + again))
    return made


def slots(made: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: the first rank, the first sequence and the offset of each of its slots, in the order of ranks."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for members, times in made:
        offset = 0
        for n in members:
            a, b, c = out.setdefault(n, ([], [], []))
            a.append(ranks.get(n, 0))
            b.append(first)
            c.append(offset)
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        first += times
    return out


def _place(batches: Iterator[pa.RecordBatch], where) -> Iterator[pa.RecordBatch]:
    by_length = where.value
    for batch in batches:
        length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
        sequence, offset = [], []
        for n, r in zip(length, rank):
            ranks, firsts, offsets = by_length[n]
            k = bisect_right(ranks, r) - 1
            sequence.append(firsts[k] + r - ranks[k])
            offset.append(offsets[k])
        yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in PACKED.fields[:5]), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=PACKED.names)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents, each with `end_id` after its ids, into sequences of at most `capacity` tokens.

    Only longer documents are cut.  Returns one row per piece (see PACKED).
    A null text is empty, so its piece holds the end id alone; rows with one
    or no id are packed each on its own; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or wordbpe.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = common.cut(rows.mapInArrow(partial(_cut, tokenizer=tokenizer, end_id=end_id, capacity=capacity), PIECES), "pieces")
    by_task = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # bounded by the capacity alone
    ranked = pieces.join(bases.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(partial(_place, where=where), PACKED)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
