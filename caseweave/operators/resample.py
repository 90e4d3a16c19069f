"""Bootstrap of the Gini index and percentile intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators.concentration import curve_rate
from caseweave.operators.draws import Draw, block_sums, digest_draw, hashed_draw  # noqa: F401  (digest_draw is for callers)
from caseweave.operators.running import lookup, running_totals
from caseweave.session import stored

# Units of one block: its cases and populations are two arrays in a row.
BLOCK_UNITS = 4096
# Unit tables up to this many rows are broadcast; two 8-byte columns keep that below 4 MB.
BROADCAST_UNITS = 200_000
# Replicates that draw in one copy of a block, which is a row of work.
REPLICATES_PER_COPY = 256

def replicate_key(seed: int, strata: Sequence[str], rep: Column) -> Column:
    """60-bit number of a replicate: the first 15 digits of an MD5 digest of seed, stratum and replicate."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(key).cast("string") for key in strata], rep.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _fair(count: str, node: str, turn: str) -> str:
    """How many of ``count`` fair bits are set: random words are counted bit by bit, the last one in part."""
    word = f"xxhash64(_key, {node}, {turn}, i)"
    mask = f"if(i < {count} div 64, -1L, ~shiftleft(-1L, cast({count} % 64 AS int)))"
    return f"aggregate(sequence(0L, {count} div 64), 0L, (sum, i) -> sum + bit_count({word} & {mask}))"


def _binomial(count: str, left: str, size: str, node: str) -> str:
    """How many of ``count`` draws fall into the first ``left`` of ``size`` units.

    A uniform number is compared with ``left / size`` bit by bit, for all draws at once: those that differ at this
    bit are decided, about half of them, and the others go on. 63 bits leave out a draw with probability 2**-63.
    """
    bit = f"2 * z.r >= {size}"
    more = f"named_struct('u', z.u - k, 's', z.s + k, 'r', 2 * z.r - {size})"
    less = "named_struct('u', k, 's', z.s, 'r', 2 * z.r)"
    turn = f"element_at(transform(array({_fair('z.u', node, 'j')}), k -> if({bit}, {more}, {less})), 1)"
    drawn = f"aggregate(sequence(1L, 63L), named_struct('u', {count}, 's', 0L, 'r', {left}), (z, j) -> {turn}, z -> z.s)"
    return f"if({left} >= {size}, {count}, if({left} <= 0, 0L, {drawn}))"


def block_counts(units: str, blocks: str, block_units: int) -> Column:
    """How many of ``units`` draws each of ``blocks`` blocks of a replicate gets: an array.

    All draws are split between the two halves of the blocks, then each part again, down to single blocks
    (recursive binomial splitting), so a replicate costs a few bits a draw and level, and no row for any draw.
    """
    depth = f"cast(ceil(log2({blocks})) AS int)"
    width = f"shiftleft(1L, {depth} - t)"

    def before(block: str) -> str:
        return f"least({units}, ({block}) * {block_units})"

    low, middle, high = before(f"q * {width}"), before(f"q * {width} + {width} div 2"), before(f"(q + 1) * {width}")
    node = "shiftleft(1L, t) + q"
    split = _binomial("c", f"({middle} - {low})", f"({high} - {low})", node)
    pair = f"if({high} <= {low}, array(0L, 0L), element_at(transform(array({split}), k -> array(k, c - k)), 1))"
    level = f"flatten(transform(counts, (c, q) -> {pair}))"
    # Positions of transform are int; all arithmetic is on long.
    level = level.replace("q * ", "cast(q AS long) * ").replace("(q + 1)", "(cast(q AS long) + 1)")
    return F.expr(f"if({blocks} = 1, array({units}), aggregate(sequence(0, greatest({depth} - 1, 0)), array({units}), (counts, t) -> {level}))")


def bootstrap_gini(
    df: DataFrame,
    strata: Sequence[str],
    cases: str,
    population: str,
    tie: Sequence[str],
    replicates: int = 10_000,
    seed: int = 13,
    origin: bool = True,
    draw: Draw = hashed_draw,
    block_units: int = BLOCK_UNITS,
) -> DataFrame:
    """Gini index of each bootstrap replicate: (strata, rep, g), ``rep`` from 0.

    Every replicate draws as many units as its stratum has, with replacement. Units are put in the order of the
    curve once, ``block_units`` to a block. A replicate first gets its number of draws per block (``block_counts``), then
    draws inside the block, where they are sorted and summed as arrays (``draws.block_sums``): no draw is a row. What leaves a
    block is one row of sums for each replicate; a stratum of many blocks is put together from these. The result depends
    on ``seed`` and ``block_units``, not on partitions.

    A replicate that draws an unknown value has no index (NULL), as has one without cases; without
    ``origin`` the first piece is left out, and a stratum of one unit has none.
    """
    spark = df.sparkSession
    ranked = df.select(
        *strata,
        *[t for t in tie if t not in strata],
        F.col(cases).cast("double").alias("_c"),
        F.col(population).cast("double").alias("_p"),
        curve_rate(cases, population).alias("_rate"),
    )
    order = [F.col("_rate").desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]]
    numbered = running_totals(ranked, strata, order, {"_unit": F.lit(1)})
    numbered = numbered.withColumn("_block", F.expr(f"(_unit - 1) div {block_units}"))
    packed = numbered.groupBy(*strata, "_block").agg(F.array_sort(F.collect_list(F.struct("_unit", "_c", "_p"))).alias("_units"))
    packed, _ = stored(packed.select(*strata, "_block", F.col("_units._c").alias("_cs"), F.col("_units._p").alias("_ps")))
    sizes = packed.groupBy(*strata).agg(F.sum(F.size("_cs")).cast("long").alias("_n"), F.count(F.lit(1)).alias("_b"))
    units = packed.agg(F.sum(F.size("_cs"))).first()[0] or 0

    # Replicates are few, narrow rows with much work each: spread them by an explicit number of partitions.
    width = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.withColumn("_key", replicate_key(seed, strata, F.col("rep"))).repartition(width, "_key")
    counted = reps.select(*strata, "rep", "_key", F.posexplode(block_counts("_n", "_b", block_units)).alias("_place", "_m"))
    counted = counted.select(*strata, "rep", "_key", F.col("_place").cast("long").alias("_block"), "_m").filter("_m > 0")
    keys = [*strata, "_block"]
    counted = counted.withColumn("_copy", F.expr(f"rep div {REPLICATES_PER_COPY}").cast("int"))
    # One struct key: equal when its NULL parts are. Dealt by an explicit number, which adaptive execution keeps: rows of much work.
    at = F.struct(*keys, "_copy").alias("_at")
    dealt = counted.select(at, F.struct("rep", "_key", "_m").alias("_draw")).repartition(width, "_at")
    dealt = dealt.groupBy("_at").agg(F.collect_list("_draw").alias("_draws"))
    if units <= BROADCAST_UNITS:
        dealt = dealt.select(*[F.col("_at")[key].alias(key) for key in keys], "_draws")
        drawn = lookup(dealt, F.broadcast(packed), keys, "inner")
    else:
        copies = F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES_PER_COPY))
        copied = packed.withColumn("_copy", F.explode(copies)).select(at, "_cs", "_ps").repartition(width, "_at")
        drawn = dealt.join(copied.hint("merge"), "_at").select(*[F.col("_at")[key].alias(key) for key in keys], "_draws", "_cs", "_ps")
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(key).cast("string") for key in strata])
    fields = [*[df.schema[key] for key in strata], T.StructField("_block", T.LongType()), T.StructField("rep", T.IntegerType(), False), T.StructField("_m", T.LongType())]
    fields += [T.StructField(name, T.DoubleType()) for name in ("_c", "_p", "_a", "_fc", "_fp")]
    drawn = drawn.select(*keys, text.alias("_text"), "_draws", "_cs", "_ps")
    names = list(strata)
    sums = drawn.mapInArrow(lambda batches: block_sums(batches, draw, names), T.StructType(fields))

    # A sum of blocks is unknown if one of them is.
    before = W.partitionBy(*strata, "rep").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_a", F.col("_a") + 2 * F.coalesce(F.sum("_c").over(before), F.lit(0.0)) * F.col("_p"))
    unknown = F.count_if(F.col("_c").isNull() | F.col("_p").isNull()) > 0
    result = sums.groupBy(*strata, "rep").agg(
        *[F.sum(c).alias(c) for c in ("_c", "_p", "_a", "_m")], unknown.alias("_unknown"),
        F.min_by(F.struct("_fc", "_fp"), "_block").alias("_first"),
    )
    area, defined = F.col("_a"), ~F.col("_unknown")
    if not origin:
        area = area - F.col("_first._fc") * F.col("_first._fp")
        defined = defined & (F.col("_m") > 1)
    index = F.try_divide(area, F.col("_c") * F.col("_p")) - 1
    return result.select(*strata, "rep", F.when(defined, index).alias("g"))


def percentile_interval(
    df: DataFrame,
    strata: Sequence[str],
    value: str,
    low: float = 0.025,
    high: float = 0.975,
    scale: float = 100.0,
) -> DataFrame:
    """Exact interpolated percentiles of a value per stratum, scaled."""
    ends = F.percentile(F.col(value), F.array(F.lit(low), F.lit(high)))
    return (
        df.groupBy(*strata)
        .agg(ends.alias("_ends"))
        .select(*strata, (F.col("_ends")[0] * scale).alias("lci"), (F.col("_ends")[1] * scale).alias("uci"))
    )
