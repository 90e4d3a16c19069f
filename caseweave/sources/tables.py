"""Scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.recode import drop_suffix, recode
from caseweave.sources.schemas import MONTH_PARTS


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header, read with a fixed schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Stored table; a year filter on a table partitioned by year skips whole folders."""
    df = spark.read.parquet(path)
    return df if years is None else df.filter(F.col("year_dx").isin(list(years)))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Store a table as Parquet.

    With partition columns, rows are first sent to the task of their partition and
    a slice of the others, so that each folder gets a bounded number of files and a
    large partition is written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


@contextmanager
def bucketed_table(
    df: DataFrame, path: str, bucket_by: Sequence[str], buckets: int, partition_by: Sequence[str] = ()
) -> Iterator[DataFrame]:
    """Store a table in buckets of some columns (and folders of others), and read it inside the block.

    Counts and joins on the bucket columns, with or without further ones, then need no exchange. A bucket has
    one file per folder. The entry in the catalog, which Spark needs to know the buckets, goes at the end of the block; the files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *bucket_by)
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.bucketBy(buckets, *bucket_by).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_month_parts(
    spark: SparkSession, paths: Sequence[str], schema: str, names: Sequence[str] = MONTH_PARTS
) -> DataFrame:
    """One scan over twelve parts, each tagged with the month its file or folder is named after."""
    named = F.regexp_extract(F.col("_metadata.file_path"), "[/=](" + "|".join(names) + r")(?=[./])", 1)
    months = {name: i for i, name in enumerate(names, start=1)}
    parts = spark.read.schema(schema).option("header", True).csv(list(paths))
    return parts.withColumn("month", recode(named, months))


def union_parts(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Tables appended by column name with the part they came from; absent columns are NULL."""
    result = None
    for name, part in parts.items():
        tagged = part.withColumn(tag, F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def rows_of_known(df: DataFrame, name: str, known: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Table body without headings, totals and notes.

    A row belongs to the body when its name is known. The numeric columns come back as numbers,
    NULL where a cell is blank or unreadable; such a district keeps its other years.
    """
    body = df.join(known.select(name).distinct(), name, "left_semi")
    return body.withColumns({column: F.col(column).try_cast("double") for column in numeric})


def population_by_year(papua: DataFrame, west_papua: DataFrame, known: DataFrame, suffix: int = 3) -> DataFrame:
    """(year_dx, province, city, n) from the two wide population tables as they come.

    The numbers of the second table carry a suffix of fixed length.
    """
    years = ["year_19", "year_20"]
    west_papua = west_papua.withColumns({year: drop_suffix(year, suffix) for year in years})
    parts = {
        "Papua": rows_of_known(papua.select("city", *years), "city", known, years),
        "West Papua": rows_of_known(west_papua.select("city", *years), "city", known, years),
    }
    long = union_parts(parts, "province").unpivot(["province", "city"], years, "_year", "n")
    return long.select(F.when(F.col("_year") == "year_19", 2019).otherwise(2020).alias("year_dx"), "province", "city", "n")


def official_units(parts: Mapping[str, DataFrame], known: DataFrame) -> DataFrame:
    """(province, city, n_hu_web) from the unit tables of the provinces as they come, totals and notes left out."""
    named = {
        province: part.select(F.col("`Nama Kab/Kota`").alias("city"), F.col("`Jumlah Unit`").alias("n_hu_web"))
        for province, part in parts.items()
    }
    body = rows_of_known(union_parts(named, "province"), "city", known, ["n_hu_web"])
    return body.select("province", "city", "n_hu_web")


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Column labels stored as field metadata."""
    columns: list[Column] = []
    for column in df.columns:
        if column in labels:
            columns.append(F.col(column).alias(column, metadata={"label": labels[column]}))
        else:
            columns.append(F.col(column))
    return df.select(*columns)


def labels_of(df: DataFrame) -> dict[str, str]:
    """Column labels found in the schema."""
    return {f.name: f.metadata["label"] for f in df.schema.fields if "label" in f.metadata}


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small table of fixed values, marked for broadcast; its size does not depend on any data."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
