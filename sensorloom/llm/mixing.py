"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of size s with weight w has the mean repetition rate w * total / s.
Each document's count is drawn by inverting the Poisson distribution of its
source's rate at a uniform number that comes from a hash of the seed and its
id, so a lost task draws the same counts again; the document is exploded by
its count, and the copies are dealt out and ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import common

#: A table of rates of at most this many sources (about 50 bytes to 1 KB each) is broadcast.
BROADCAST_SOURCES = 10_000
#: The largest rate of a single draw.
LARGEST_RATE = 500.0


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate): sizes in characters over all rows.

    Weights are as given (a source without one gets none) or, by default,
    size ** alpha; `total` characters are aimed at, by default as many as there are.
    A source whose texts are all empty has rate 1 or, with weights given and none for it, 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("source")).cast("double"), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    aim = F.lit(float(total)) if total is not None else F.col("all_size").cast("double")
    rate = F.when(F.col("size") == 0, F.when(F.col("weight") > 0, 1.0).otherwise(1.0 if weights is None else 0.0)).when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * aim / F.col("size")).otherwise(0.0)
    return sizes.join(F.broadcast(sums)).select("source", "size", rate.alias("rate"))


def _distribution(rate: Column) -> Column:
    """The cumulative Poisson probabilities of 0, 1, ..., as far as doubles tell them from one."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * rate / k)).alias("sums")),
        lambda acc: acc["sums"],
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", extra: bool = True) -> DataFrame:
    """The documents, each as often as its source's rate asks for, in a global random order.

    With `extra`, the columns n_copies, copy (from 0) and mix_key come after
    the documents' own; names already taken there are replaced.  Without, all
    of the documents' columns stay as they are.  Documents with no source are
    a source of their own; a null or empty text has size 0; rows with one id
    have one count (a null id counts as an id); an empty table gives no rows.
    """
    spark = docs.sparkSession
    rate = common.cut(rates(docs, weights, alpha, total, source_col, text_col), "rates")
    # exp(-rate) must not vanish: a count of a large rate is the sum of draws at equal parts of it
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE).cast("int"))
    by, times, sums, n_copies, nth, mix_key = (common.fresh(docs, x) for x in ("source_of", "draws", "sums", "n_copies", "copy", "mix_key"))
    chances = rate.select(F.col("source").alias(by), draws.alias(times), _distribution(F.col("rate") / draws).alias(sums))
    if rate.count() <= BROADCAST_SOURCES:
        chances = F.broadcast(chances)
    added = ("n_copies", "copy", "mix_key") if extra else ()
    own = [c for c in docs.columns if c.lower() not in added]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(F.concat(F.lit(f"{seed}:"), key))
    count = F.size(F.filter(sums, lambda p: p <= u)).cast("bigint")

    def again(so_far: Column, i: Column) -> Column:
        v = uniform(F.concat(F.lit(f"{seed}:"), key, F.lit(":draw:"), i.cast("string")))
        return so_far + F.size(F.filter(sums, lambda p: p <= v)).cast("bigint")

    further = F.when(F.col(times) > 1, F.aggregate(F.sequence(F.lit(2), F.col(times)), F.lit(0).cast("bigint"), again)).otherwise(F.lit(0).cast("bigint"))
    drawn = docs.join(chances, F.col(source_col).eqNullSafe(F.col(by))).withColumn(n_copies, count + further)
    copies = drawn.where(F.col(n_copies) > 0).withColumn(nth, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_copies) - 1)))
    mixed = copies.withColumn(mix_key, F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.col(nth).cast("string"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash deals the copies out and orders each part: together a random order of all, without a sort over all
    dealt = mixed.repartition(parts, mix_key).sortWithinPartitions(mix_key)
    return dealt.select(*own, *(F.col(c).alias(name) for c, name in zip((n_copies, nth, mix_key), added)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights by the square root of each source's size."""
    return mix(common.table(spark, sf_dir, "documents"))


SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), sums AS (
  SELECT sum(size)::DOUBLE AS all_size, sum(pow(size::DOUBLE, 0.5)) AS all_weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE pow(size::DOUBLE, 0.5) / all_weight * all_size / size END AS rate FROM sizes, sums
), parts AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 500.0) AS BIGINT)) AS draws FROM rates
), ks AS (
  SELECT source, draws, rate / draws AS rate, unnest(range(0, CAST(ceil(rate / draws + 12 * sqrt(rate / draws) + 30) AS BIGINT) + 1)) AS k FROM parts
), chances AS (
  SELECT source, k, sum(exp(CASE WHEN k = 0 THEN -rate ELSE k * ln(rate) - rate - lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS p FROM ks
), draws AS (
  SELECT documents.*, unnest(range(1, draws + 1)) AS draw FROM documents JOIN parts ON documents.source IS NOT DISTINCT FROM parts.source
), us AS (
  SELECT *, ('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN draw > 1 THEN ':draw:' || draw ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM draws
), drawn AS (
  SELECT us.doc_id, us.text, us.lang, us.source, us.n_chars, count(*) AS n_copies
  FROM us JOIN chances ON us.source IS NOT DISTINCT FROM chances.source AND chances.p <= us.u
  GROUP BY us.doc_id, us.text, us.lang, us.source, us.n_chars
), copies AS (
  SELECT *, unnest(range(0, n_copies)) AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
       md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS mix_key
FROM copies
"""
