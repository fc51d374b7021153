"""What the corpus operators share: the shared folder, cut lineage, batches of Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: `spark.checkpoint.dir`, as a URI.

    Only where the session names none and runs on this machine alone (a test)
    is a folder of this machine taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='sensorloom-')}")
        base = _LOCAL[0]
    return base.rstrip("/") if "://" in base else f"file://{base.rstrip('/')}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by cut()."""
    jvm = spark._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if parent.startswith(shared_dir(spark).split("://")[0]):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a string or binary column holds about `most` bytes in each; a longer single row stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        size = max(1, batch.column(at).nbytes)
        step = max(1, batch.num_rows * most // size) if size > most else batch.num_rows
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds the bytes of the batches that Spark hands to Python, unless the session sets a bound: 10,000 long rows would be many times that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame):
    """A hash of all of a row's columns but maps, which Spark can't hash."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


#: Keys with more than one in so many of all rows are joined by broadcast; there are at most as many of them.
HOT = 4096


def join_counted(rows: DataFrame, one: DataFrame, key: str, n: str, exploded: bool = False) -> DataFrame:
    """Inner join with a table that has one row per key and, in n, the number of this key's rows in `rows`.

    Keys with over 1/HOT of all rows are at most HOT, so they go by broadcast;
    all others share out evenly by the usual shuffle, however hot the former are.
    Spark takes exploded rows for as few as they were before: with `exploded`
    neither they nor their other keys, which may be as many, go by broadcast.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / HOT
    often = F.broadcast(one.where(hot))
    seldom = rows.join(F.broadcast(one.where(hot).select(key)), key, "left_anti")
    others = one.where(~hot)
    return rows.join(often, key).unionByName(seldom.join(others.hint("merge") if exploded else others, key))
