"""Token counts under a unigram model by trie-shared dynamic programming.

Distinct pre-tokens go into a trie.  The best score of a prefix under a
unigram model does not depend on what follows, so each trie node holds it
once, with the number of pieces on the best path, for all pre-tokens that
share the prefix; a pre-token's count is its last node's.  A worker keeps its
trie from task to task and drops it at a bound, so memory is bounded and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: Trie nodes and pre-tokens that a worker holds at most, about 250 bytes each.
_NODES, _WORDS = 600_000, 500_000
_SPACE = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary file's pieces by Zipf's law over their ranks; control pieces and single bytes have none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scale = log(sum(1 / (k + 1) for k in range(len(pieces)))) if pieces else 0.0
    return {p: -log(k + 1) - scale for k, p in enumerate(pieces)}


class Trie:
    """Forward scores of prefixes.  A character that no piece covers falls back to its UTF-8 bytes, one token each, at
    ten below the worst piece."""

    def __init__(self, scores: dict[str, float]):
        #: By suffix of a piece: its own score, or None if it is no piece itself.
        self.suffixes: dict[str, float | None] = {}
        for p in scores:
            for k in range(1, len(p)):
                self.suffixes.setdefault(p[k:], None)
        self.suffixes |= scores
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.counts.clear()
        self.scores.clear()

    def insert(self, word: str) -> None:
        """Walks the word down the trie, scoring new nodes, and stores its terminal count."""
        child, best, count, suffixes = self.child, self.best, self.count, self.suffixes
        node, path = 0, [0]
        for i, ch in enumerate(word, 1):
            key = (node, ch)
            node = child.get(key, -1)
            if node < 0:
                bytes_ = len(ch.encode("utf-8", "surrogatepass"))
                up = path[-1]
                top, least = best[up] + self.byte * bytes_, count[up] + bytes_
                for k in range(i - 1, -1, -1):
                    piece = word[k:i]
                    if piece not in suffixes:
                        break
                    own = suffixes[piece]
                    if own is not None:
                        score, n = best[path[k]] + own, count[path[k]] + 1
                        if score > top or score == top and n < least:
                            top, least = score, n
                node = len(best)
                best.append(top)
                count.append(least)
                child[key] = node
            path.append(node)
        self.counts[word] = count[node]
        self.scores[word] = best[node]

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.counts)
        if not new:
            return
        if len(self.best) > _NODES or len(self.counts) + len(new) > _WORDS:
            self.clear()
            new = words
        for w in new:
            self.insert(_SPACE + w)
            self.counts[w] = self.counts.pop(_SPACE + w)
            self.scores[w] = self.scores.pop(_SPACE + w)


_TRIES: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    if path not in _TRIES:
        _TRIES[path] = Trie(piece_scores(path))
    return _TRIES[path]


def count(text: str | None, model: Trie) -> tuple[int, int, float]:
    """(pre-tokens, tokens, log-probability) of a whole text."""
    n, tokens, total = 0, 0, 0.0
    words = (text or "").split()
    for at in range(0, len(words), 100_000):
        some = words[at : at + 100_000]
        model.learn(set(some))
        n += len(some)
        tokens += sum(map(model.counts.__getitem__, some))
        total += sum(map(model.scores.__getitem__, some))
    return n, tokens, total


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_probability", T.DoubleType())])


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    model = trie(vocabulary)
    for batch in common.rows(batches, "text"):
        got = [count(t, model) for t in batch.column("text").to_pylist()]
        n, tokens, total = zip(*got)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(total, pa.float64())], names=COUNTS.names)


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pretokens (words between white space), n_tokens and log_probability of the best segmentation.

    Null and empty texts have zero of each; rows that repeat come back as
    often; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_count, vocabulary=vocabulary or default_path()), COUNTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(common.table(spark, sf_dir, "documents"))
