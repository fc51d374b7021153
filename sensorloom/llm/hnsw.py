"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, merged.

Equal vectors are one class (of its members only the k + 1 smallest ids can
ever be in a result), and classes are dealt out by hash to shards that fit in
a task.  A shard's graph is made by insertion: nodes come in falling order of
their top layer, in batches; each walks down greedily from the entry to its
own top layer, and from there on a beam search finds the candidates for its
links, which are thinned by the usual rule: a candidate is linked unless it is
nearer to a neighbour already linked than to the node itself.  As nodes are
numbered in that order, layer k holds the first so many nodes, and its links
are one flat array of node numbers, row by row.

Queries travel to the shards in blocks, a shard's graph never to the queries;
what the shards find is merged by score.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: Most classes in a shard on average, and most bytes of their vectors; queries in a block, and blocks that one task
#: holds against a shard.
SHARD, SHARD_BYTES, BLOCK, BLOCKS_A_TASK = 50_000, 48 << 20, 2048, 64
#: Nodes that are inserted together at most.
BATCH = 512


class Graph:
    """Unit vectors in the order of insertion, and for each layer from the ground its links: rows of node numbers, -1 for none."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray]):
        self.unit, self.layers = unit, layers
        self.visited = 0

    def pack(self) -> bytes:
        out = [struct.pack("<3q", *self.unit.shape, len(self.layers)), self.unit.astype("<f4").tobytes()]
        for near in self.layers:
            out += [struct.pack("<2q", *near.shape), near.astype("<i4").tobytes()]
        return b"".join(out)

    @staticmethod
    def unpack(raw: bytes) -> Graph:
        n, width, many = struct.unpack_from("<3q", raw)
        at = 24
        unit = np.frombuffer(raw, "<f4", n * width, at).reshape(n, width)
        at += 4 * n * width
        layers = []
        for _ in range(many):
            rows, room = struct.unpack_from("<2q", raw, at)
            layers.append(np.frombuffer(raw, "<i4", rows * room, at + 16).reshape(rows, room))
            at += 16 + 4 * rows * room
        return Graph(unit, layers)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither vanish nor overflow; cosines stay exactly the same."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, initial=0.0))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    wide = scaled(vectors)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _descend(graph: Graph, queries: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
    """Greedy walks on one layer, in step."""
    unit, near = graph.unit, graph.layers[layer]
    at = at.copy()
    score = np.einsum("qd,qd->q", queries, unit[at])
    moving = np.arange(len(at))
    while len(moving):
        own = near[at[moving]]
        got = np.einsum("qd,qmd->qm", queries[moving], unit[np.maximum(own, 0)])
        graph.visited += int((own >= 0).sum())
        got[own < 0] = -np.inf
        best = got.argmax(axis=1)
        row = np.arange(len(best))
        better = got[row, best] > score[moving]
        moving, row, best = moving[better], row[better], best[better]
        at[moving], score[moving] = own[row, best], got[row, best]
    return at


def _beam(graph: Graph, queries: np.ndarray, at: np.ndarray, layer: int, width: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores), best first, -1 for none: a beam search on one layer from one node each, for all queries in
    step, among the first `known` nodes."""
    q, unit, near = len(queries), graph.unit, graph.layers[layer]
    # the beam: node, score, and whether its neighbours were looked at
    node = np.full((q, width), -1, dtype=np.int32)
    value = np.full((q, width), -np.inf, dtype=np.float32)
    done = np.zeros((q, width), dtype=bool)
    node[:, 0], value[:, 0] = at, np.einsum("qd,qd->q", queries, unit[at])
    seen = np.zeros((q, known), dtype=bool)
    seen[np.arange(q), at] = True
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active] | (node[active] < 0), -np.inf, value[active])
        # a few open nodes of the beam at a time
        pick = np.argpartition(-open_, min(3, width - 1), axis=1)[:, :3]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        some = live.any(axis=1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, pick] |= live
        fresh = np.where(live[:, :, None], near[np.where(live, node[rows, pick], 0)], -1).reshape(len(active), -1)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh[(fresh >= 0) & seen[rows, np.maximum(fresh, 0)]] = -1
        r, c = np.nonzero(fresh >= 0)
        graph.visited += len(r)
        seen[active[r], fresh[r, c]] = True
        got = np.full(fresh.shape, -np.inf, dtype=np.float32)
        got[r, c] = np.einsum("ed,ed->e", queries[active[r]], unit[fresh[r, c]])
        all_value = np.concatenate([value[active], got], axis=1)
        order = np.argpartition(-all_value, width - 1, axis=1)[:, :width] if all_value.shape[1] > width else np.broadcast_to(np.arange(width), (len(active), width))
        node[active] = np.take_along_axis(np.concatenate([node[active], fresh], axis=1), order, 1)
        value[active] = np.take_along_axis(all_value, order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(fresh.shape, dtype=bool)], axis=1), order, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    node, value = np.take_along_axis(node, order, 1), np.take_along_axis(value, order, 1)
    node[value == -np.inf] = -1
    return node, value


def _thinned(unit: np.ndarray, candidates: np.ndarray, scores: np.ndarray, links: int) -> np.ndarray:
    """The links of each row among its candidates (node numbers, best first, -1 for none): at most `links`, -1 for none."""
    out = np.full((len(candidates), links), -1, dtype=np.int32)
    for at in range(0, len(candidates), 256):
        some, score = candidates[at : at + 256], scores[at : at + 256]
        own = unit[np.maximum(some, 0)]
        among = np.matmul(own, own.transpose(0, 2, 1))
        there = some >= 0
        taken = np.zeros(some.shape, dtype=bool)
        count = np.zeros(len(some), dtype=int)
        for c in range(some.shape[1]):
            blocked = (taken[:, :c] & (among[:, c, :c] > score[:, c, None])).any(axis=1)
            taken[:, c] = there[:, c] & ~blocked & (count < links)
            count += taken[:, c]
        # room that is left is filled with the nearest of those passed over
        order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :links]
        got = np.take_along_axis(some, order, 1)
        out[at : at + 256, : got.shape[1]] = got
    return out


def _link_back(unit: np.ndarray, near: np.ndarray, new: np.ndarray, links: np.ndarray) -> None:
    """Adds each new node to the links of those that it links; full rows are thinned anew, to two thirds of their room."""
    room = near.shape[1]
    r, c = np.nonzero(links >= 0)
    old, back = links[r, c], new[r]
    order = np.argsort(old, kind="stable")
    old, back = old[order], back[order]
    nodes, first, many = np.unique(old, return_index=True, return_counts=True)
    rank = np.arange(len(old)) - np.repeat(first, many)
    slot = np.repeat((near[nodes] >= 0).sum(axis=1), many) + rank
    fits = slot < room
    over = np.unique(old[~fits])
    wide = np.full((len(over), room + int(many.max(initial=0))), -1, dtype=np.int32)
    wide[:, :room] = near[over]
    full = np.isin(old, over)
    wide[np.searchsorted(over, old[full]), room + rank[full]] = back[full]
    near[old[fits & ~full], slot[fits & ~full]] = back[fits & ~full]
    for at in range(0, len(over), 256):
        some = wide[at : at + 256]
        score = np.einsum("qd,qmd->qm", unit[over[at : at + 256]], unit[np.maximum(some, 0)])
        score[some < 0] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : room + room // 2]
        near[over[at : at + 256]] = -1
        near[over[at : at + 256], : room * 2 // 3] = _thinned(unit, np.take_along_axis(some, best, 1), np.take_along_axis(score, best, 1), room * 2 // 3)


def build(vectors: np.ndarray, links: int = 16, width: int = 64, seed: int = 42) -> tuple[Graph, np.ndarray]:
    """(graph, order) over non-zero finite vectors, order being the row of each node.

    Each layer holds about one in `links` of the nodes below it; a node has
    room for twice `links` links, on the ground for three times as many.
    """
    n = len(vectors)
    level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    held = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
    graph = Graph(units(vectors)[order], [np.full((m, 2 * links if k else 3 * links), -1, dtype=np.int32) for k, m in enumerate(held)])
    unit = graph.unit
    at = 1
    while at < n:
        top = int(level[at])
        stop = min(n, held[top], at + min(at, BATCH))  # one batch has one top layer
        new = np.arange(at, stop)
        own = unit[at:stop]
        start = np.zeros(len(new), dtype=np.int64)
        for k in range(len(held) - 1, top, -1):
            start = _descend(graph, own, start, k)
        among = own @ own.T
        np.fill_diagonal(among, -np.inf)
        for k in range(top, -1, -1):
            node, score = _beam(graph, own, start, k, min(width, at), at)
            start = np.maximum(node[:, 0], 0)
            # those that are inserted together are candidates, too
            m = min(len(new) - 1, links)
            if m > 0:
                near = np.argpartition(-among, m - 1, axis=1)[:, :m]
                node = np.concatenate([node, near + at], axis=1)
                score = np.concatenate([score, np.take_along_axis(among, near, 1)], axis=1)
                best = np.argsort(-score, axis=1, kind="stable")[:, :width]
                node, score = np.take_along_axis(node, best, 1), np.take_along_axis(score, best, 1)
            chosen = _thinned(unit, node.astype(np.int32), score, links if k else 2 * links)
            graph.layers[k][at:stop, : chosen.shape[1]] = chosen
            _link_back(unit, graph.layers[k], new, chosen)
        at = stop
    return graph, order


def search(graph: Graph, queries: np.ndarray, k: int, width: int = 128) -> np.ndarray:
    """Node numbers near each unit query, best first, -1 for none: greedy walks through the upper layers, then a beam on the ground."""
    at = np.zeros(len(queries), dtype=np.int64)
    for layer in range(len(graph.layers) - 1, 0, -1):
        at = _descend(graph, queries, at, layer)
    n = len(graph.unit)
    return _beam(graph, queries, at, 0, min(max(width, k), n), n)[0][:, :k]


SHARDS = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType()), T.StructField("graph", T.BinaryType())])
HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("class", T.LongType()), T.StructField("score", T.DoubleType())])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    return flat.reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """Rows ordered by their first two columns, as one table for each pair of values."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((np.diff(one) != 0) | (np.diff(two) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(one)]):
            if hi > lo:
                key = (int(one[lo]), int(two[lo]))
                if held and key != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def _build(batches: Iterator[pa.RecordBatch], links: int, candidates: int) -> Iterator[pa.RecordBatch]:
    for (dims, shard), rows in _runs(batches):
        rows = rows.sort_by("vec_id").combine_chunks()
        vectors, ids = _matrix(rows.column("embedding").chunk(0)), rows.column("vec_id").to_numpy().astype("<i8")
        graph, order = build(vectors, links, candidates)
        yield _packed(dims, shard, ids[order], vectors[order], graph.pack())


def _packed(dims: int, shard: int, ids: np.ndarray, vectors: np.ndarray, graph: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), vectors.tobytes(), graph))], names=SHARDS.names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries, without a graph."""
    for (dims, block), rows in _runs(batches):
        rows = rows.combine_chunks()
        yield _packed(dims, block, rows.column("vec_id").to_numpy().astype("<i8"), _matrix(rows.column("embedding").chunk(0)), None)


def _search(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by dims, shard and part, each shard's graph before the blocks of queries that it meets."""
    graph = None
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
            if row["graph"] is not None:
                graph, classes, originals = Graph.unpack(row["graph"]), ids, vectors
                continue
            unit = units(vectors)
            for at in range(0, len(ids), 256):
                found = search(graph, unit[at : at + 256], k, width)
                q, c = np.nonzero(found >= 0)
                hit = found[q, c]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(classes[hit]), pa.array(cosine(vectors[at + q], originals[hit]))], names=HITS.names)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dims) of vectors with an id that are not null, zero or empty and hold no null and no NaN or infinity, in double precision."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn("dims", F.size(v))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, links: int = 16, candidates: int = 64, width: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None) -> DataFrame:
    """The k nearest rows found for each query row by cosine: query_id, rank (from 1), vec_id, score.

    Queries are rows of the same kind; a row is never its own neighbour.  Ties
    go to the smaller id.  Rows that aren't usable() take no part; vectors are
    compared with those of their own length; of rows that repeat an id, as
    query or as candidate, the nearest pair counts, once; with fewer rows than
    k, all come back.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(vectors, id_col, vector_col).withColumn("key", F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")))).dropDuplicates(["key", "vec_id"])
    # the k + 1 smallest ids of each class, thinned within each task before they are shuffled
    by_key = Window.partitionBy("key").orderBy("vec_id")
    members = common.cut(rows.withColumn("nth", F.row_number().over(by_key)).where(F.col("nth") <= k + 1), "members")
    # one row for each length of vectors: m lengths need some 4 m * m bytes of vectors, so a thousandth of a table at most
    fits = F.greatest(F.lit(1), F.least(F.lit(shard or SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dims")))))
    sizes = common.cut(members.where("nth = 1").groupBy("dims").agg(F.ceil(F.count("*") / fits).cast("int").alias("shards")), "sizes")
    heads = members.where("nth = 1").join(F.broadcast(sizes), "dims")
    dealt = heads.select("dims", F.pmod(F.xxhash64("vec_id", "key"), F.col("shards")).cast("int").alias("shard"), "vec_id", "embedding")
    index = common.cut(dealt.repartition(parts, "dims", "shard").sortWithinPartitions("dims", "shard").mapInArrow(partial(_build, links=links, candidates=candidates), SHARDS), "index")
    asked = usable(queries, id_col, vector_col).join(F.broadcast(sizes), "dims")
    blocks = common.cut(asked.groupBy("dims").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = asked.join(F.broadcast(blocks), "dims").select("dims", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding")
    packed = dealt.repartition(parts, "dims", "block").sortWithinPartitions("dims", "block").mapInArrow(_blocks, SHARDS)
    # each block travels to every shard; a shard that meets very many blocks is there once for so many of them
    block = F.col("shard")
    sent = packed.join(F.broadcast(sizes), "dims").withColumn("part", F.floor(block / BLOCKS_A_TASK).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sent = sent.select("dims", F.col("to").alias("shard"), "part", "ids", "vectors", "graph")
    there = index.join(F.broadcast(blocks), "dims").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS_A_TASK).cast("int")))).select(*sent.columns)
    met = there.union(sent).repartition(parts, "dims", "shard", "part").sortWithinPartitions("dims", "shard", "part", F.col("graph").isNull())
    hits = met.mapInArrow(partial(_search, k=2 * k + 2, width=width), HITS)
    best = hits.groupBy("query_id", "class").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "class"))).where(F.col("r") <= 2 * k + 2)
    keys = members.where("nth = 1").select(F.col("vec_id").alias("class"), "key")
    classes = members.join(keys, "key").select("class", "vec_id")
    found = best.join(classes, "class").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
