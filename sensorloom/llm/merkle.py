"""A Merkle manifest of a dataset: leaves by row, a tree per language, a root over all, and a proof for each row.

A fragment of a tree is a sparse forest: the digests of nodes whose siblings
it doesn't hold, keyed by level and index.  Two fragments are merged by
uniting their nodes and folding every run of siblings that is complete.  A run's
size follows from the number of leaves, so the last run of a level, which may
be shorter, is known to be complete, too, and the merge is associative: any
grouping of fragments gives the same forest.  Spark sorts the leaves by range,
folds each part by itself, and merges the parts' forests as a tree, FAN at a
time, until one node per language is left.  A forest of a part has at most
two nodes a level, so nothing that is merged grows with the rows.

Proofs are read off the way down: a part rebuilds its own nodes and is given
those at its two edges on each level, which the merges have left on record.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm import common

#: Nodes of a run of siblings.
ARITY = 2
#: Rows of a part, about: a part's leaves are folded in one task.
PART_ROWS = 20_000
#: Fragments merged at a time.
FAN = 16

Forest = dict[tuple[int, int], str]


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def widths(leaves: int, arity: int = ARITY) -> list[int]:
    """The number of nodes on each level, from the leaves up to the one at the top."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def fold(forest: Forest, leaves: int, arity: int = ARITY) -> tuple[Forest, Forest]:
    """(what stays open, all nodes made): every complete run of siblings becomes its parent, over and over.

    A lone node on the level below the top's is a run as well; the node at the top stays open.
    """
    wide = widths(leaves, arity)
    nodes = dict(forest)
    made: Forest = {}
    for level in range(len(wide) - 1):
        for run in {i // arity for k, i in nodes if k == level}:
            held = [(level, i) for i in range(run * arity, min((run + 1) * arity, wide[level]))]
            if all(key in nodes for key in held):
                made[level + 1, run] = nodes[level + 1, run] = digest(nodes[key] for key in held)
                for key in held:
                    del nodes[key]
    return nodes, made


def merge(a: Forest, b: Forest, leaves: int, arity: int = ARITY) -> Forest:
    """The monoid's operation; the empty forest is its neutral element."""
    return fold(a | b, leaves, arity)[0]


def siblings(known: Forest, index: int, wide: list[int], arity: int = ARITY) -> list[tuple[list[str], list[str]]]:
    """For each level below the top, the digests before and after a leaf's ancestor in its run."""
    out = []
    for level in range(len(wide) - 1):
        first = index // arity * arity
        end = min(first + arity, wide[level])
        out.append(([known[level, i] for i in range(first, index)], [known[level, i] for i in range(index + 1, end)]))
        index //= arity
    return out


def climb(leaf: str, path: Iterable[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        leaf = digest((*before, leaf, *after))
    return leaf


_OPEN = "tree string, part long, level int, node long, digest string, open boolean"
_PATHS = "array<struct<before:array<string>,after:array<string>>>"


def _fold_part(table: pa.Table) -> pa.Table:
    """One part's leaves of one tree: what stays open of them."""
    nodes = {(0, i): d for i, d in zip(table.column("node").to_pylist(), table.column("digest").to_pylist())}
    still, _ = fold(nodes, table.column("leaves")[0].as_py())
    return _rows(table.column("tree")[0].as_py(), table.column("part")[0].as_py(), still, {})


def _merge_parts(table: pa.Table) -> pa.Table:
    """Fragments of one tree: the forest that they merge to, and the nodes that went into new ones."""
    got = zip(table.column("level").to_pylist(), table.column("node").to_pylist(), table.column("digest").to_pylist())
    nodes = {(k, i): d for k, i, d in got}
    still, made = fold(nodes, table.column("leaves")[0].as_py())
    return _rows(table.column("tree")[0].as_py(), table.column("part")[0].as_py(), still, {k: d for k, d in (nodes | made).items() if k not in still})


def _rows(tree: str, part: int, still: Forest, done: Forest) -> pa.Table:
    keys = [*still, *done]
    n = len(keys)
    values = [[tree] * n, [part] * n, [k for k, _ in keys], [i for _, i in keys], [*still.values(), *done.values()], [True] * len(still) + [False] * len(done)]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=["tree", "part", "level", "node", "digest", "open"])


def _sized(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows of fragments with their tree's number of leaves; a tree of many parts is split off by their number."""
    times = rows.groupBy("tree").agg(F.count("*").alias("times"))
    return common.join_counted(rows, common.cut(trees.join(times, "tree"), "trees"), "tree", "times").drop("times")


def number(rows: DataFrame, tree: str, order: list[str], digest_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with part and node, blocks).  node is a row's place, from 0, within its tree by `order`, then digest.

    Rows are dealt by range, equal ones by their place in the input, so that
    repeated rows don't meet in one part.  blocks has tree, part, first (its
    first place), size and leaves (of the whole tree).
    """
    total = rows.count()
    keys = [tree, *order, digest_col, "_place"]
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // PART_ROWS)), *keys)
    dealt = common.cut(ranged.withColumn("part", F.spark_partition_id().cast("long")), "ranged")
    sizes = dealt.groupBy(tree, "part").agg(F.count("*").alias("size"))
    along = Window.partitionBy(tree)  # one row per part
    blocks = sizes.withColumns({"first": F.sum("size").over(along.orderBy("part")) - F.col("size"), "leaves": F.sum("size").over(along)})
    blocks = common.cut(blocks, "blocks")
    within = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*keys[1:])) - 1
    numbered = dealt.withColumn("_within", within).join(blocks, [tree, "part"]).withColumn("node", F.col("first") + F.col("_within")).drop("_place", "_within")
    return common.cut(numbered, "numbered"), blocks


def forests(numbered: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, digest of its top), and all nodes on record: tree, level, node, digest.

    numbered: tree, part, node, digest, leaves.
    """
    trees = blocks.groupBy("tree").agg(F.max("leaves").alias("leaves"))
    parts = blocks.agg(F.max("part")).first()[0] or 0
    at = common.cut(numbered.select("tree", "part", "node", "digest", "leaves").groupBy("tree", "part").applyInArrow(_fold_part, _OPEN), "fragments")
    record = [at]
    while True:
        grouped = _sized(at.where("open"), trees).withColumn("part", F.floor(F.col("part") / FAN))
        at = common.cut(grouped.groupBy("tree", "part").applyInArrow(_merge_parts, _OPEN), "fragments")
        record.append(at)
        parts //= FAN
        if parts == 0:
            break
    nodes = record[0]
    for one in record[1:]:
        nodes = nodes.union(one)
    # a node is on record as open, as made or as both; they agree
    return at.where("open").select("tree", "digest"), nodes.groupBy("tree", "level", "node").agg(F.min("digest").alias("digest"))


def edges(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, part, edge): the nodes on record at and beside both ends of a part, on every level."""
    levels = F.ceil(F.log(F.col("leaves").cast("double")) / log(ARITY)).cast("int") + 1
    spread = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), levels))).withColumn("w", F.pow(F.lit(float(ARITY)), "level").cast("long"))
    reach = range(1 - ARITY, ARITY)
    ends = [F.expr(f"{end} div w") + d for end in ("first", "(first + size - 1)") for d in reach]
    around = spread.select("tree", "part", "level", F.explode(F.array_distinct(F.array(*ends))).alias("node"))
    # the topmost nodes are asked for by all parts of a tree
    key = F.struct("tree", "level", "node")
    asked = around.where("node >= 0").select("tree", "part", key.alias("key"))
    times = asked.groupBy("key").agg(F.count("*").alias("times"))
    one = common.cut(nodes.select(key.alias("key"), "digest").join(times, "key"), "asked")
    got = common.join_counted(asked, one, "key", "times")
    return got.groupBy("tree", "part").agg(F.collect_list(F.struct("key.level", "key.node", "digest")).alias("edge"))


def _prove(left: pa.Table, right: pa.Table, above: bool) -> pa.Table:
    """One part's rows with their proofs, or, for the topmost tree, with their siblings."""
    leaves = left.column("leaves")[0].as_py()
    wide = widths(leaves)
    own = {(0, i): d for i, d in zip(left.column("node").to_pylist(), left.column("digest").to_pylist())}
    known = dict(own)
    known.update(fold(own, leaves)[1])
    up: list[tuple[list[str], list[str]]] = []
    if right.num_rows:
        known |= {(x["level"], x["node"]): x["digest"] for x in right.column("edge")[0].as_py() or ()}
        if above:
            up = [(x["before"], x["after"]) for x in right.column("up")[0].as_py()]
    paths = [siblings(known, i, wide) + up for i in left.column("node").to_pylist()]
    if not above:
        made = pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], pa.list_(pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])))
        return pa.table([left.column("tree"), left.column("digest"), made], names=["lang_key", "subroot", "up"])
    subroot, root = right.column("subroot")[0].as_py(), right.column("root")[0].as_py()
    proofs = [digest(d for before, after in p for d in (*before, *after)) for p in paths]
    folded = [climb(d, p) for d, p in zip(left.column("tampered").to_pylist(), paths)]
    n = left.num_rows
    columns = [left.column("doc_id"), left.column("digest"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
    return pa.table(columns, names=[c.split()[0] for c in PROOFS.split(", ")])


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove_rows(left: pa.Table, right: pa.Table) -> pa.Table:
    return _prove(left, right, True)


def _prove_trees(left: pa.Table, right: pa.Table) -> pa.Table:
    return _prove(left, right, False)


def leaf(doc_id, source, lang, n_chars, text):
    """A row's digest: of each value `-` if null, else its UTF-8 byte count, a colon and the value."""
    values = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf that is folded is tampered with where 7 divides the CRC-32 of the
    id: its n_chars is one more (a null stays).  Rows of a language ascend by
    doc_id, null first, then by leaf; repeated rows are leaves of their own.
    A null language is a tree of its own, the first.  An empty table gives no
    rows; other columns are not read.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    # a language's key sorts as it does, null first
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    leaves = docs.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*own).alias("digest"), F.when(hit, leaf(own[0], own[1], own[2], more, own[4])).alias("tampered"))
    leaves = common.cut(leaves.withColumn("tampered", F.coalesce("tampered", "digest")), "leaves")
    rows, blocks = number(leaves, "tree", ["doc_id"], "digest")
    tops, nodes = forests(rows, blocks)
    # the trees' tops are the leaves of one more tree
    trees, tree_blocks = number(tops.select(F.lit("").alias("all"), "tree", "digest"), "all", ["tree"], "digest")
    trees = trees.withColumnRenamed("tree", "lang_key").withColumnRenamed("all", "tree")
    tree_blocks = tree_blocks.withColumnRenamed("all", "tree")
    top, tree_nodes = forests(trees, tree_blocks)
    keyed = trees.select("part", "node", "leaves", "digest", F.col("lang_key").alias("tree"), F.lit("").alias("all"))
    side = edges(tree_blocks, tree_nodes).withColumnRenamed("tree", "all")
    proven = keyed.groupBy("all", "part").cogroup(side.groupBy("all", "part")).applyInArrow(_prove_trees, f"lang_key string, subroot string, up {_PATHS}")
    proven = proven.crossJoin(F.broadcast(top.select(F.col("digest").alias("root")))).withColumnRenamed("lang_key", "tree")  # one row
    # every part gets its edges and what is above its tree; a tree has few parts, and a hot one goes by broadcast
    beside = blocks.select("tree", "part").join(edges(blocks, nodes), ["tree", "part"], "left")
    times = beside.groupBy("tree").agg(F.count("*").alias("times"))
    given = common.join_counted(beside, common.cut(proven.join(times, "tree"), "tops"), "tree", "times").drop("times")
    return rows.groupBy("tree", "part").cogroup(given.groupBy("tree", "part")).applyInArrow(_prove_rows, PROOFS)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents."""
    return manifest(common.table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE texts AS (
  SELECT lang, doc_id, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
bits AS (SELECT DISTINCT doc_id, list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))) AS b FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, xor(list_reduce(b, lambda r, x: xor(r >> 1, CASE WHEN xor(r, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM bits),
leaves AS (
  SELECT lang, doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS folded
  FROM texts LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS d, n FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, j AS i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2),
path AS (
  SELECT lang, doc_id, leaf, i AS at, 0 AS level, i, n, folded AS f, '' AS proof FROM placed
  UNION ALL
  SELECT p.lang, p.doc_id, p.leaf, p.at, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 1 THEN s.d || p.f ELSE p.f || coalesce(s.d, '') END), p.proof || coalesce(s.d, '')
  FROM path p LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.level AND s.i = CASE WHEN p.i % 2 = 1 THEN p.i - 1 ELSE p.i + 1 END WHERE p.n > 1),
over AS (
  SELECT p.lang, p.doc_id, p.leaf, p.at, 0 AS level, r.j AS i, r.n, p.f, p.proof FROM path p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT p.lang, p.doc_id, p.leaf, p.at, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 1 THEN s.d || p.f ELSE p.f || coalesce(s.d, '') END), p.proof || coalesce(s.d, '')
  FROM over p LEFT JOIN tops s ON s.level = p.level AND s.i = CASE WHEN p.i % 2 = 1 THEN p.i - 1 ELSE p.i + 1 END WHERE p.n > 1)
SELECT o.doc_id, o.leaf, r.subroot, t.d AS root, sha256(o.proof) AS proof_sha256, o.f AS folded_root, o.f = t.d AS verified
FROM over o JOIN subroots r ON r.lang IS NOT DISTINCT FROM o.lang, tops t WHERE o.n = 1 AND t.n = 1
"""
