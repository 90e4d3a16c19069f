"""Data checks that return the offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Cells of one 64-bit word; the sign bit stays free.
_WORD = 63


def missing_cells(df: DataFrame, base: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Cells of the full grid (every base row with every level) that ``df`` has no row for.

    The cells of a base row are numbered, and the rows of ``df`` become one bit set for each base row before they
    are shuffled. Bits that are not set are the missing cells, so the grid itself is never made or joined.
    """
    cell, cells = F.lit(0), 1
    for column, values in levels.items():
        place = F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)), F.lit(0))
        cell, cells = cell * len(values) + (place - 1), cells * len(values)
    words = [f"_word{i}" for i in range(-(-cells // _WORD))]
    numbered = df.select(*base.columns, cell.cast("int").alias("_cell")).filter("_cell IS NOT NULL")
    bits = [
        F.expr(f"bit_or(if(_cell div {_WORD} = {i}, shiftleft(1L, _cell % {_WORD}), 0L))").alias(word)
        for i, word in enumerate(words)
    ]
    seen = numbered.groupBy(*base.columns).agg(*bits)
    word = F.expr(f"element_at(array({', '.join(f'coalesce({w}, 0L)' for w in words)}), cast(_cell div {_WORD} + 1 AS int))")
    missing = base.distinct().join(seen, base.columns, "left")
    missing = missing.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    missing = missing.withColumn("_word", word).filter(f"getbit(_word, _cell % {_WORD}) = 0")
    named, rest = [], F.col("_cell")
    for column, values in reversed(levels.items()):
        named.append(F.element_at(F.array(*[F.lit(v) for v in values]), (rest % len(values) + 1).cast("int")).alias(column))
        rest = F.floor(rest / len(values)).cast("int")
    return missing.select(*base.columns, *reversed(named))


def varying_attributes(df: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Key combinations in which an attribute is not constant, NULL counting as a value."""
    value = F.col(attribute)
    mixed = F.min(value) != F.max(value)
    partly_missing = (F.count(value) > 0) & (F.count(value) < F.count(F.lit(1)))
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(value).alias("smallest"),
            F.max(value).alias("largest"),
            (F.coalesce(mixed, F.lit(False)) | partly_missing).alias("_bad"),
        )
        .filter("_bad")
        .drop("_bad")
    )


def first_reason(reasons: Mapping[str, Column]) -> Column:
    """Name of the first reason that applies, NULL if none does."""
    tag = None
    for name, condition in reasons.items():
        tag = F.when(condition, F.lit(name)) if tag is None else tag.when(condition, F.lit(name))
    return tag


def rejects(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Rows that meet a reason, tagged with the first one that applies."""
    return df.withColumn("reason", first_reason(reasons)).filter(F.col("reason").isNotNull())


def missing_population(df: DataFrame, keys: Sequence[str], population: str) -> DataFrame:
    """Key combinations whose population is unknown, with their row count."""
    return (
        df.filter(F.col(population).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    )


def row_counts(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count of every key combination of ``expected`` (keys, expected), 0 where there is no row, and whether it is right."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return expected.join(counts, list(keys), "left").select(
        *keys, rows.alias("rows"), "expected", (rows == F.col("expected")).alias("complete")
    )
