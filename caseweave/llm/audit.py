"""What each of five filters removes in every order of them, from sorted posting lists of the documents that fail."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import join_groups, partitions, store
from caseweave.llm.words import blocks

FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#$%&*|")] = 1
_CAPITALS = np.zeros(256, np.int64)
_CAPITALS[65:91] = 1
_POINTS = np.ones(256, np.int64)
_POINTS[0x80:0xC0] = 0


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, the failures of filters A to D as bits 0 to 3, and a digest of the text."""
    kind = docs.schema["doc_id"].dataType

    def judge(batches):
        for rows, data, offsets in blocks(batches):
            def total(values: np.ndarray) -> np.ndarray:
                sums = np.zeros(len(data) + 1, np.int64)
                np.cumsum(values[data], out=sums[1:])
                return np.diff(sums[offsets])

            whole = data.tobytes()
            edges = offsets.tolist()
            words, distinct, digests = [], [], []
            for low, high in zip(edges[:-1], edges[1:]):
                text = whole[low:high]
                found = text.split()  # at the six ASCII space characters
                words.append(len(found))
                distinct.append(len(set(found)))
                digests.append(hashlib.sha256(text).digest()[:16])
            words, distinct = np.array(words, np.int64), np.array(distinct, np.int64)
            failed = (words < 200) * 1 + (100 * distinct < 50 * words) * 2
            failed += (100 * total(_CAPITALS) > 2 * total(_POINTS)) * 4 + (total(_SYMBOLS) > 0) * 8
            columns = [rows.column(0), rows.column(1), pa.array(failed.astype(np.int32)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "failed", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(judge, f"doc_id {kind.simpleString()}, part string, failed int, digest binary")


def _first_of_equal(rows: DataFrame) -> DataFrame:
    """Add the failure of filter E (bit 4): an equal text has a smaller id."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    joined = join_groups(rows, store(groups.filter("copies > 1").select("digest", "least", "copies"), "copies"), "digest", "copies")
    copy = F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))
    return joined.select("doc_id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def _absent(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which entries of ``left`` are not in ``right``: the shorter list gallops through the longer one."""
    if len(left) > len(right):
        out = np.ones(len(left), bool)
        at = np.searchsorted(left, right)
        hit = at < len(left)
        hit[hit] = left[at[hit]] == right[hit]
        out[at[hit]] = False
        return out
    at = np.searchsorted(right, left)
    out = at == len(right)
    out[~out] = right[at[~out]] != left[~out]
    return out


def _merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union of two sorted lists: what only the second holds is set in between the runs of the first."""
    only = right[_absent(right, left)]
    return np.insert(left, np.searchsorted(left, only), only)


def union_sizes(lists: list[np.ndarray], marked: list[np.ndarray]) -> np.ndarray:
    """For every set of lists (by bits) the size of their union, then how many of it each list of ``marked`` holds."""
    unions, sizes = [np.zeros(0, np.int64)], np.zeros((1 + len(marked), 1 << len(lists)), np.int64)
    for chosen in range(1, 1 << len(lists)):
        last = chosen.bit_length() - 1
        unions.append(_merge(unions[chosen ^ (1 << last)], lists[last]))
        sizes[0, chosen] = len(unions[-1])
        for i, ids in enumerate(marked, 1):
            sizes[i, chosen] = len(ids) - np.count_nonzero(_absent(ids, unions[-1]))
    return sizes


def _counted(batches):
    """Posting lists of one range of ids, part by part and batch by batch, and their sizes summed.

    Rows come by id, labels of an id before its documents. The entries of the lists are the numbers of the rows in that
    order, so that repeated ids stay apart.
    """
    sums: dict[str, np.ndarray] = {}
    known, good, toxic = None, False, False
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        failed, labelled = batch.column(2).to_numpy(), batch.column(3).to_pylist()
        marks = np.zeros(len(ids), np.int64)
        for i, (doc_id, label) in enumerate(zip(ids, labelled)):
            if label is not None:
                if doc_id != known:
                    known, good, toxic = doc_id, False, False
                good, toxic = good or bool(label & 1), toxic or bool(label & 2)
            elif known is not None and doc_id == known:
                marks[i] = good + 2 * toxic
        places: dict[str, list[int]] = {}
        for i, part in enumerate(parts):
            if labelled[i] is None:
                places.setdefault(part, []).append(i)
        for part, at in places.items():
            at = np.array(at, np.int64)
            lists = [at[failed[at] >> k & 1 == 1] for k in range(len(FILTERS))]
            marked = [at[marks[at] >> k & 1 == 1] for k in range(2)]
            sums[part] = sums.get(part, 0) + union_sizes(lists, marked)
    if sums:
        columns = [pa.array(list(sums), pa.string())]
        columns += [pa.array([s[i].tolist() for s in sums.values()], pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "removed", "good", "toxic"])


def _size(sizes: str, chosen: Column) -> Column:
    return F.element_at(F.col(sizes), (chosen + 1).cast("int"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of the filters A to E removes, per part (source).

    A: under 200 words (``[^\\x20\\x09-\\x0D]+``); B: under half of the words are distinct; C: over 2 % of the code points
    are A-Z; D: any of ``#$%&*|``; E: an equal text has a smaller id anywhere in the table.

    The texts are judged where they lie. Rows that fail (and labels) are dealt by ranges of ids, so that a hot source is
    cut as any other. Each range keeps sorted posting lists per part and filter, merges them to the unions of all 32 sets
    of filters, and yields the sizes; sizes add up over ranges. What a step removes is the difference of two unions,
    so all 120 orders follow from the 32 sums of a part. A task holds one Arrow batch and 96 numbers for each of its parts.
    A text that many rows have is resolved by ``join_groups``, without a task that holds all its rows.

    ``docs`` has doc_id, source and text, ``labels`` doc_id, quality and toxic; other columns are ignored. Null text is
    empty, null source is the part ''. Repeated rows count each. A row with a null id fails no E and has no label; of several labels
    of an id any 1 counts. A table without documents gives no rows. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    judged = store(_judged(docs), "judged")
    kind = docs.schema["doc_id"].dataType.simpleString()
    totals = judged.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    failing = _first_of_equal(judged).filter("failed > 0")
    failing = failing.select("doc_id", "part", "failed", F.lit(None).cast("int").alias("label"))
    label = F.when(F.col("quality") == 1, 1).otherwise(0) + F.when(F.col("toxic") == 1, 2).otherwise(0)
    marks = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit("").alias("part"), F.lit(0).alias("failed"), label.alias("label"))
    marks = marks.filter("doc_id is not null and label > 0").distinct()
    # Null ids have no label and no order, so they go anywhere.
    rows = store(failing.unionByName(marks), "failing").withColumn("place", F.when(F.col("doc_id").isNull(), F.rand(7)).otherwise(0))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", F.col("label").desc_nulls_last())
    ranged = ranged.select("doc_id", "part", "failed", "label")
    sizes = ranged.mapInArrow(_counted, "part string, removed array<long>, good array<long>, toxic array<long>")
    summed = [F.array(*[F.sum(F.col(c)[i]) for i in range(_SETS)]).alias(c) for c in ("removed", "good", "toxic")]
    nothing = F.array_repeat(F.lit(0).cast("long"), _SETS)
    unions = totals.join(sizes.groupBy("part").agg(*summed), "part", "left").select(
        "part", "total", *[F.coalesce(c, nothing).alias(f"_{c}") for c in ("removed", "good", "toxic")]
    )

    orders = F.explode(F.lit(["".join(order) for order in permutations(FILTERS)]))
    steps = unions.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    own = F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)")
    after = F.expr("aggregate(sequence(1, step), 0, (bits, i) -> bits | shiftleft(1, ascii(substring(filter_order, i, 1)) - 65))")
    steps = steps.withColumns({"_own": own, "_after": after, "_before": after - own})
    own = F.col("_own")
    removed = _size("_removed", F.col("_after")) - _size("_removed", F.col("_before"))
    every = F.lit(_SETS - 1)
    steps = steps.select(
        "part", "filter_order", "step", (F.col("total") - _size("_removed", F.col("_after"))).alias("kept"), removed.alias("removed"),
        (_size("_removed", own) - removed).alias("redundant"), (_size("_removed", every) - _size("_removed", every - own)).alias("unique_fails"),
        *[(_size(f"_{c}", F.col("_after")) - _size(f"_{c}", F.col("_before"))).alias(f"{c}_lost") for c in ("good", "toxic")],
        F.expr("substring(filter_order, step, 1)").alias("_filter"),
    )
    # A part has 600 rows here, whatever its size.
    return steps.withColumn("shapley", F.expr("sum(removed) over (partition by part, _filter)")).drop("_filter")
