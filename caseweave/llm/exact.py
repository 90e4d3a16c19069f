"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import join_groups, store

SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 26
HASHES = 2


def _slot(number: int, slots: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256", F.lit(number)), F.lit(slots)) + F.lit(number * slots)


def exact_duplicates(docs: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """Mark all but one row of every group of equal texts.

    Pass 1 sets ``HASHES`` filter slots for each row and keeps the slots that more than one row set.
    They are packed into 64-bit words and broadcast: at most ``HASHES * max_slots / 64`` pairs of
    longs (2 million at the default), whatever the input. Pass 2 tests every row. A row with a slot of
    its own is unique and passes straight on; only the others are shuffled, and grouped exactly.
    The rows of hot groups stay where they are (``join_groups``).
    A fuller filter (more rows than ``max_slots / 16``) lets more unique rows be shuffled and changes no result.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null text counts as empty, and equal empty
    texts are a group. Of equal texts the largest ``doc_id`` stays; null ids stay only in groups
    without another. Of rows repeated with the same id and text one is kept. An empty table gives no rows.
    Returns doc_id, keep_id, group_size, kept, text_sha256 (SHA-256 stands for the text).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = store(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256")), "exact")
    slots = SLOTS_PER_ROW * max(rows.count(), 64)
    slots = min(1 << (slots - 1).bit_length(), max_slots)

    slot = rows.select(F.explode(F.array(*[_slot(i, slots) for i in range(HASHES)])).alias("slot"))
    repeated = slot.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")
    words = repeated.groupBy(F.expr("slot div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits")
    )

    tested = rows
    for i in range(HASHES):
        part = words.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}"))
        tested = tested.withColumn(f"slot{i}", _slot(i, slots)).withColumn(f"word{i}", F.expr(f"slot{i} div 64"))
        tested = tested.join(F.broadcast(part), f"word{i}", "left")
    hits = [F.expr(f"coalesce(shiftright(bits{i}, cast(slot{i} % 64 AS int)) & 1, 0) = 1") for i in range(HASHES)]
    suspect = hits[0]
    for hit in hits[1:]:
        suspect = suspect & hit
    tested = tested.select("doc_id", "text_sha256", suspect.alias("suspect"))

    unique = tested.filter(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    # Rows repeated with the same id are counted first, then groups: both with partial sums before the shuffle.
    members = tested.filter("suspect").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    members = store(members, "members")
    groups = members.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("rows"))
    resolved = join_groups(members, store(groups, "groups"), "text_sha256", "rows")
    resolved = resolved.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    resolved = resolved.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )
    return unique.unionByName(resolved)
