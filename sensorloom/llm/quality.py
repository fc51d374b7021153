"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows and
flattened into arrays; scoring walks all rows of a batch through all trees at
once in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: Most labelled rows that a fit looks at.  Those with the smallest MD5 of their id are taken.
FIT_ROWS = 20_000

#: Classes of bytes whose shares of a text are statistics; a text's remaining bytes are those of non-ASCII letters.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-?", b"!", b"#$%&*", b"|<>{}[]()\\/_=+~^`@", bytes(range(128, 256))]
FEATURES = [f"share_{k}" for k in range(len(_CLASSES))] + ["log_bytes", "word_length", "sd_word_length", "longest_word", "log_lines", "line_length", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "symbol_words", "upper_words", "compression", "sentence_length"]


def _lookup() -> np.ndarray:
    table = np.full(256, len(_CLASSES), dtype=np.uint8)
    for k, some in enumerate(_CLASSES):
        table[list(some)] = k
    return table


_TABLE = _lookup()
_SYMBOL_END = tuple("#$%&*!|")


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each whole text; a null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        share = np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)] / n
        words, lines = text.split(), text.split("\n")
        n_words = len(words)
        if n_words:
            lengths = np.fromiter(map(len, words), dtype=np.float64, count=n_words)
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            pairs = len(set(zip(words, words[1:])))
            rest = (lengths.mean(), lengths.std(), np.log1p(lengths.max()), np.log1p(len(lines)), np.log1p(n / len(lines)), len(counts) / n_words, pairs / max(1, n_words - 1), len(set(lines)) / len(lines), max(counts.values()) / n_words, sum(w.endswith(_SYMBOL_END) for w in words) / n_words, sum(map(str.isupper, words)) / n_words)
        else:
            rest = (0.0,) * 11
        packed = sum(len(zlib.compress(raw[at : at + 32_768], 1)) for at in range(0, n, 32_768)) / n
        out[row] = (*share, np.log1p(n), *rest, packed, np.log1p(n / (1 + raw.count(b".") + raw.count(b"?") + raw.count(b"!"))))
    return out


class Trees:
    """Flattened trees: per tree and node a feature, a threshold, a left child (the right one follows) and a value.

    A leaf has feature -1 and itself as child.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.child, self.value, self.base, self.depth = feature, threshold, child, value, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, child, value in zip(self.feature, self.threshold, self.child, self.value):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, child[at] + (x[rows, f] > threshold[at]))
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, bins: int = 64, rate: float = 0.15, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Grows trees level by level on binned columns, with log loss.

    Without rows, or with one label only, every score is that label's share
    (one half without rows), drawn in a little from 0 and 1.
    """
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(prior / (1 - prior)))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1, dtype=np.int32)
    threshold, child, value = np.zeros((trees, nodes)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros((trees, nodes))
    made = Trees(feature, threshold, child, value, base, depth)
    if n == 0 or y.min() == y.max():
        return made
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = at - first
            live = local >= 0
            if not live.any():
                break
            slot = local[live]
            best = np.full(many, 1e-6)
            choice = [None] * many
            gs, hs = np.bincount(slot, g[live], many), np.bincount(slot, h[live], many)
            for j in range(width):
                key = slot * bins + binned[j][live]
                gl = np.bincount(key, g[live], many * bins).reshape(many, bins).cumsum(1)[:, :-1]
                hl = np.bincount(key, h[live], many * bins).reshape(many, bins).cumsum(1)[:, :-1]
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                for s in range(many):
                    if gain[s, k[s]] > best[s]:
                        best[s], choice[s] = gain[s, k[s]], (j, k[s])
            moved = np.full(n, -1, dtype=np.int64)
            for s in range(many):
                node = first + s
                if choice[s] is None:
                    continue
                j, k = choice[s]
                feature[t, node], threshold[t, node], child[t, node] = j, edges[j][k], 2 * node + 1
                own = at == node
                moved[own] = 2 * node + 1 + (binned[j][own] > k)
            at = np.where(moved >= 0, moved, at)
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t] = rate * gs / (hs + ridge)
        total += value[t][at]
    return made


SCORED = T.StructType([T.StructField("row", T.LongType()), T.StructField("score", T.DoubleType())])
_SAMPLE = T.StructType([T.StructField("row", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        x = statistics(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "y", "x"])


def held_out(id_col):
    """Whether a row's label is held out of every fit: CRC-32 of the id's text, modulo 3, is 1.  A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fits on at most `rows` labelled documents that aren't held out."""
    key = F.md5(F.col(id_col).cast("string"))
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("row"), F.col(label_col).cast("int").alias("y"), key.alias("key")).orderBy("key", "y").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(chosen.select("row", "y")), "row").mapInArrow(_sample, _SAMPLE).orderBy("row", "y").limit(2 * rows).toArrow()  # `rows` bounds both
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), dtype=np.float64))


def _score(batches: Iterator[pa.RecordBatch], trees: Trees, text_col: str, name: str = "score") -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, text_col):
        texts = batch.column(batch.schema.get_field_index(text_col))
        scores = trees.score(statistics(texts.to_pylist()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a column of scores, from 0 to 1, in place of any of that name; nulls and empty texts are scored too."""
    own = docs.drop(name)
    schema = T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())])
    return own.mapInArrow(partial(_score, trees=trees, text_col=text_col, name=name), schema)


def _rows_only(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in _score(batches, trees, "text"):
        yield batch.select(["doc_id", "score"])


def predictions(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of one half).

    Empty tables of documents give no rows; without labels every score is one half.
    """
    trees = train(docs, labels, rows)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_rows_only, trees=trees), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns as they were, one named score included."""
    name = common.fresh(docs, "score")
    return score(docs, train(docs, labels, rows), name=name).where(F.col(name) >= 0.5).drop(name)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by trees fitted to `labels.quality`."""
    return predictions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
