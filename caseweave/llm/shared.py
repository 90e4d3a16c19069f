"""Written tables and files in the folder all executors share, and running offsets without a global sort in one task."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave import session

_tables: list[str] = []
_shipped: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a session that names no such folder is refused."""
    return session.new_table_path(spark, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Keep what operators write inside the block in a folder of its own; at the end it goes, and its tables leave the catalog.

    Results must be written or collected inside the block.
    """
    known = len(_tables)
    with session.scratch(spark) as folder:
        try:
            yield folder
        finally:
            for name in _tables[known:]:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            del _tables[known:]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no path of the driver."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, str(path.relative_to(root.parent)))
    folder = spark.conf.get("spark.checkpoint.dir", None) or session.shared_folder(spark)
    uri = f"{folder.rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip"
    system, place = open_folder(uri)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(spark.sparkContext.applicationId)


def store(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once and read it back from the shared folder; a lost executor cannot change its rows."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``store``, in buckets of ``key``: later joins on it move only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", shared_path(spark, name))
    _tables.append(table)
    writer.bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def text_key() -> Column:
    """Stands for a text: its MD5 as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


TEXT_BYTES = 128 << 20


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Every text once, stored in buckets of its key: key, text, copies; and the number of buckets.

    Copies meet before the shuffle where a task has several, so a text that a third of all rows repeat is moved
    once per task. All later joins on the key leave the texts where they are. There are as many buckets as shuffle
    partitions, and more of them where one would hold more than ``TEXT_BYTES`` of the table.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // TEXT_BYTES))
    rows = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return store_by(texts, "texts", "key", buckets), buckets


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, for tasks that write or read files of their own format."""
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def with_offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same ``by`` in the given order (nulls first).

    Rows are cut into ranges of (by, order), so that neither a hot group nor the whole table
    meets in one task; the totals of the ranges are one row for each range and group in it.
    The cut rows are stored, since both uses must see the same ranges. ``by`` must not hold nulls.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *by, *order)
    ranged = store(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *by).agg(F.sum(value).alias("_total"))
    totals = totals.select("_range", *by, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(totals, ["_range", *by])
    return joined.select(*df.columns, (F.col("_local") + F.col("_shift")).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


HOT_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of stored ``rows`` with stored ``groups``, one for each ``key``, of which ``size`` says how many rows it has.

    Keys that hold more than a thousandth of the rows are fewer than ``HOT_KEYS``, so they are broadcast and their rows
    stay where they are. All others are joined by a shuffle.
    """
    hot = rows.count() // HOT_KEYS
    large = F.broadcast(groups.filter(F.col(size) > hot).withColumn("_hot", F.lit(True)))
    marked = rows.join(large, key, "left")
    others = marked.filter("_hot is null").select(*rows.columns).join(groups.filter(F.col(size) <= hot), key, "left")
    return marked.filter("_hot").select(*others.columns).unionByName(others)
