"""Collocations: frequent phrases of two to five words, scored by how much oftener they occur than their parts allow.

Each task turns its texts into shards of word ids, sorts a shard's suffixes by
numpy prefix doubling, and reads the counts of phrases off the intervals of
common prefixes.  Spark adds up the shards' counts by phrase.

A phrase is frequent only if all its parts are.  So the texts are read four
times: for words, for pairs of frequent words, for triples of frequent pairs,
and for phrases of four and five words that are made of frequent triples.
Without the triples most of the latter would be counted in vain: the larger a
table, the more pairs are frequent, and what chains of them can be put together
grows faster still.  What is frequent goes to the tasks as a bitmap of hashes
of fixed size: a clash lets a rare part through, whose count the final threshold
sorts out, but no frequent part is ever missed.

Phrases of two words or more are counted by the numbers of their words, hashes
of 48 bits that are known to differ for all words that the bitmap lets through,
so the counts are exact, and only the frequent phrases are put into words again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

LONGEST = 5
#: Bits of a bitmap of frequent parts: 8 MB.
BITS = 1 << 26
#: Bytes of text in a shard; a single longer text is a shard of its own.
SHARD = 16 << 20
#: Bits of a word's number.
ID_BITS = 48
COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])

_END = 10
_TABLE = bytes(_END if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers from 1 and the words by number; 0 ends each piece."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids[b""], ids[b"\n"]
    parts = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    got = np.fromiter(map(ids.__getitem__, parts), dtype=np.int64, count=len(parts))
    return np.append(got[got > 0] - 1, 0), list(ids)[1:]


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs, in their order."""
    _, rank = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
    return rank.astype(np.int64)


def reach(linked: np.ndarray, most: int) -> np.ndarray:
    """How many words on end, at most `most`, start at each place: one and as many as links follow."""
    size = np.ones(len(linked), dtype=np.int64)
    for _ in range(most - 1):
        size = np.where(linked, 1 + _shifted(size, 1), 1)
    return np.minimum(size, most)


def phrases(ids: np.ndarray, size: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, counts) of the distinct phrases of `least` to `most` words: one place of each and its number.

    size[p] bounds the phrases that start at place p, as nothing runs over the
    end of a piece.  Suffixes are ranked by their first 1, 2, 4, 8 words, each
    rank made of two of the one before; a common prefix's length is put
    together from the same ranks.
    """
    ranks, width = {1: np.where(size > 0, ids, 0)}, 1
    while width < most:
        ranks[2 * width] = _pairs(ranks[width], np.where(size > width, _shifted(ranks[width], width), 0))
        width *= 2
    order = np.argsort(ranks[width], kind="stable")
    order = order[size[order] > 0]
    common_length = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    a, b = order[:-1], order[1:]
    while width >= 1:
        at, other = np.minimum(a + common_length, len(ids) - 1), np.minimum(b + common_length, len(ids) - 1)
        fits = (size[a] >= common_length + width) & (size[b] >= common_length + width)
        common_length += width * (fits & (ranks[width][at] == ranks[width][other]))
        width //= 2
    for m in range(least, most + 1):
        long = size[order] >= m
        # an interval of prefixes in common of m words or more; suffixes too short for m lie between intervals, never in one
        first = long & np.append(True, common_length < m)[: len(order)]
        starts = np.flatnonzero(first)
        if len(starts):
            yield m, order[starts], np.add.reduceat(long.astype(np.int64), starts)


def _hashes(lang: str, words: list[bytes], salt: str) -> np.ndarray:
    """Hashes of a language's words, the same as Spark's xxhash64(salt, lang, word)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(salt.encode(), 42))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs, from numbers or hashes of their halves."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second >> np.uint64(31)) ^ second
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(16)


def _phrase_hashes(numbers: np.ndarray) -> np.ndarray:
    """Hashes of pairs or triples, from the numbers of their words in rows."""
    hashes = [_mixed(numbers[:, j], numbers[:, j + 1]) for j in range(numbers.shape[1] - 1)]
    return hashes[0] if len(hashes) == 1 else _mixed(*hashes)


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these may be frequent."""
    at = hashes % np.uint64(BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """A shard's distinct words and their counts."""
    ids, words = word_ids(text)
    return words[1:], np.bincount(ids, minlength=len(words))[1:]


def _dense(ids: np.ndarray, size: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that are in a phrase of `least` words or more, and one place after each stretch of them as its end."""
    starts = size >= least
    near = starts.copy()
    for by in range(1, most):
        near[by:] |= starts[:-by] & (size[:-by] > by)
    kept = near | np.append(True, near[:-1])
    return np.where(near, ids, 0)[kept], np.where(near, size, 0)[kept]


def count_phrases(lang: str, text: bytes, salt: str, bitmaps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words in rows, counts) of a shard's distinct phrases whose parts may be frequent.

    With the bitmap of words these are pairs, with that of pairs as well triples,
    with that of triples as well phrases of four words and more.
    """
    ids, words = word_ids(text)
    hashes = _hashes(lang, words, salt)
    numbers = hashes >> np.uint64(64 - ID_BITS)
    known = _held(bitmaps[0], hashes)
    known[0] = False
    linked = known[ids]
    linked &= _shifted(linked, 1)
    least, most = 2, 2
    if len(bitmaps) > 1:
        pairs = _mixed(numbers[ids], _shifted(numbers[ids], 1))
        linked &= _held(bitmaps[1], pairs)
        least, most = 3, 3
    size = reach(linked, most)
    if len(bitmaps) > 2:
        chained = linked & _shifted(linked, 1) & _held(bitmaps[2], _mixed(pairs, _shifted(pairs, 1)))
        least, most = 4, LONGEST
        size = np.where(linked, 1 + reach(chained, most - 1), 1)
    ids, size = _dense(ids, np.where(ids > 0, size, 0), least, most)
    for m, at, n in phrases(ids, size, least, most):
        yield numbers[ids[at[:, None] + np.arange(m)]], n


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about SHARD bytes at a time."""
    held: defaultdict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in common.rows(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            held[lang].append(text)
            size += len(text)
            if size >= SHARD:
                yield held
                held, size = defaultdict(list), 0
    if held:
        yield held


def _rows(lang: str, m: int, found: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    rows = [pa.array([lang] * len(found), pa.string()), pa.array([m] * len(found), pa.int32()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(rows, names=COUNTS.names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        for lang, texts in shard.items():
            yield _rows(lang, 1, *count_words(b"\n".join(texts)))


def _hashed(hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["h", "f"])


def _keys(numbers: np.ndarray) -> pa.Array:
    """Rows of words' numbers as bytes, the highest first."""
    n, m = numbers.shape
    width = ID_BITS // 8
    data = np.ascontiguousarray(numbers.astype(">u8").view(np.uint8).reshape(n, m, 8)[:, :, 8 - width :])
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(m * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _count_phrases(batches: Iterator[pa.RecordBatch], salt: str, bitmaps) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        for lang, texts in shard.items():
            for numbers, n in count_phrases(lang, b"\n".join(texts), salt, [b.value for b in bitmaps]):
                for k in range(0, len(n), 1_000_000):
                    yield pa.RecordBatch.from_arrays([_keys(numbers[k : k + 1_000_000]), pa.array(n[k : k + 1_000_000], pa.int64())], names=["key", "f"])


def _hash_keys(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = np.zeros((batch.num_rows, m, 8), dtype=np.uint8)
        whole[:, :, 8 - ID_BITS // 8 :] = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, m, -1)
        yield pa.RecordBatch.from_arrays([pa.array(_phrase_hashes(whole.view(">u8")[:, :, 0].astype(np.uint64)).view(np.int64))], names=["h"])


def _bitmap(hashes: DataFrame):
    """A column `h` of hashes as a broadcast bitmap; it has BITS bits, however many they are."""
    at = F.pmod("h", F.lit(BITS))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) % 64 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITS / 64 rows
    made = np.zeros(BITS // 64, dtype=np.uint64)
    made[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(made)


def salted(words: DataFrame, least: int, bits: int = ID_BITS) -> tuple[str, DataFrame]:
    """A salt with which the hashes of all words that a bitmap of the frequent ones lets through differ in their first `bits` bits, and the words with these hashes as `h`."""
    for salt in map(str, count()):
        hashed = words.withColumn("h", F.xxhash64(F.lit(salt), "lang", "phrase"))
        slots = hashed.where(F.col("f") >= least).select(F.pmod("h", F.lit(BITS)).alias("slot")).distinct()
        let_through = hashed.select("h", F.pmod("h", F.lit(BITS)).alias("slot")).join(slots, "slot", "left_semi")
        if let_through.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("id")).count().where("count > 1").isEmpty():
            return salt, hashed


def _in_words(keys: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, words, phrase, f) of phrases by the numbers of their words; `words` has `id`, lang and phrase."""
    width = ID_BITS // 8
    ids = F.expr(f"transform(sequence(0, length(key) div {width} - 1), i -> cast(conv(hex(substring(key, cast(i * {width} + 1 as int), {width})), 16, 10) as long))")
    parts = common.cut(keys.select("key", "f", F.posexplode(ids).alias("at", "id")), "parts")
    times = parts.groupBy("id").agg(F.count("*").alias("times"))
    found = common.join_counted(parts, common.cut(words.join(times, "id"), "numbered"), "id", "times")
    whole = found.groupBy("key", "f").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "phrase"))).alias("parts"))
    return whole.select("lang", F.size("parts").alias("words"), F.array_join("parts.phrase", " ").alias("phrase"), "f")


def phrase_counts(docs: DataFrame, least: int = 100) -> DataFrame:
    """(lang, words, phrase, f): the counts of all single words, and of those phrases of two to five words that occur `least` times or more in their language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = common.cut(texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")), "words")
    salt, hashed = salted(words, least)
    often = hashed.where(F.col("f") >= least)
    bitmaps, found = [_bitmap(often.select("h"))], []
    for m in (2, 3, 4):
        counted = texts.mapInArrow(partial(_count_phrases, salt=salt, bitmaps=list(bitmaps)), "key binary, f long").groupBy("key").agg(F.sum("f").alias("f"))
        found.append(common.cut(counted.where(F.col("f") >= least), "phrases"))
        if m < 4:
            bitmaps.append(_bitmap(found[-1].mapInArrow(partial(_hash_keys, m=m), "h long")))
    numbered = often.select(F.shiftrightunsigned("h", 64 - ID_BITS).alias("id"), "lang", "phrase")
    return words.union(common.cut(_in_words(reduce(DataFrame.union, found), numbered), "phrases"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase, of the first part and of the rest
    at its lowest-scoring cut (ties to the earlier), n all words of the
    language; the score is floor(1000 a n / (l r)), exactly.  Phrases inside a
    longer one that is as frequent are left out.  A null text is empty, a null
    language `und`; repeated rows count as often; equal scores go by a, then
    by phrase in byte order; an empty table gives no rows; other columns are
    not read.
    """
    counts = phrase_counts(docs, least)
    total = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= least)
    candidates = often.where("words > 1").withColumn("parts", F.split("phrase", " "))
    # inside some longer candidate as frequent means inside one of just one more word: counts fall with length
    inner = candidates.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice("parts", F.lit(2), F.col("words") - 1), " "), F.array_join(F.slice("parts", F.lit(1), F.col("words") - 1), " "))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    left = candidates.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("outer") < F.col("f"), F.lit(True)))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("phrase")).alias("first"), F.struct("lang", F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("phrase")).alias("rest"))
    cuts = common.cut(cuts, "cuts")
    sizes = often.select(F.struct("lang", "phrase").alias("part"), F.col("f"))

    def looked_up(rows: DataFrame, key: str, name: str) -> DataFrame:
        """A part such as `the` belongs to many phrases, so its rows are counted first and frequent parts go by broadcast."""
        times = rows.groupBy(key).agg(F.count("*").alias("times"))
        one = common.cut(sizes.withColumnRenamed("part", key).join(times, key).select(key, F.col("f").alias(name), "times"), "parts")
        return common.join_counted(rows, one, key, "times").drop("times")

    both = looked_up(looked_up(cuts, "first", "l"), "rest", "r")
    langs = total.join(both.groupBy("lang").agg(F.count("*").alias("times")), "lang")
    scored = common.join_counted(both, common.cut(langs, "langs"), "lang", "times")
    wide = "decimal(38,0)"
    score = F.expr(f"cast(a as {wide}) * cast(n as decimal(20,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]'), lambda w: w <> '') AS words
    FROM documents)),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM pieces),
sized AS (SELECT lang, words, p, unnest(range(1, 6)) AS m FROM places),
f AS (SELECT lang, m, array_to_string(words[p : p + m - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE p + m - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
inside AS (SELECT DISTINCT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, k, a AS longer FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS k FROM c))),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 100 * c.a),
cut AS (SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase))),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * cut.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head AND x.m = cut.k JOIN f y ON y.lang = cut.lang AND y.phrase = cut.tail AND y.m = cut.m - cut.k JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
