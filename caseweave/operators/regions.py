"""Rates and indices attached to map regions and their outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.units import full_lookup


def attach_to_regions(values: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """Full join of values to regions by name: both unmatched regions and unmatched values stay."""
    return full_lookup(values, regions, [name])


def attach_to_outlines(vertices: DataFrame, attributes: DataFrame, region_id: str) -> DataFrame:
    """Full join of outline vertices to region attributes by id.

    Written as a left join of the long vertex table, which may have one very
    large region, plus the attributes that have no outline.
    """
    left = vertices.join(attributes, region_id, "left")
    drawn = vertices.select(region_id).distinct()
    bare = attributes.join(drawn, region_id, "left_anti")
    return left.unionByName(bare, allowMissingColumns=True)


def unmatched(values: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """Names that are on one side only, with the side that has them."""
    only_values = values.select(name).distinct().join(regions.select(name), name, "left_anti")
    only_regions = regions.select(name).distinct().join(values.select(name), name, "left_anti")
    return only_values.withColumn("side", F.lit("values")).unionByName(
        only_regions.withColumn("side", F.lit("regions"))
    )


def with_class(df: DataFrame, value_class: Column, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Add a class column, optionally keeping only some of the others."""
    classed = df.withColumn(name, value_class)
    return classed.select(*keep, name) if keep else classed
