"""Which hashed windows occur more than once: packed exchange of hashes, without a row for each window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import store
from caseweave.llm.words import blocks

SLICE_BYTES = 32 << 20

# (rows, text bytes, offsets) -> text number, position and hash of the chosen windows
Select = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def slide(x: np.ndarray, span: int, op: Callable) -> np.ndarray:
    """``op`` over every ``span`` neighbours, by doubling."""
    have = 1
    while 2 * have <= span:
        x, have = op(x[:-have], x[have:]), 2 * have
    return op(x[: len(x) - (span - have)], x[span - have :]) if have < span else x


def chosen_minima(values: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Whether a value is the least of some run: ``least`` holds the minima of runs of ``span`` values, 0 for runs that do not count.

    Runs of equal content choose the same places, ties included.
    """
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return slide(padded, span, np.maximum) == values


def positions(column: pa.Array, kind=np.int32) -> list[np.ndarray]:
    """Positions of each row, from a packed column; null has none."""
    return [np.frombuffer(packed or b"", kind) for packed in column.to_pylist()]


def packed_windows(source: DataFrame, select: Select, buckets: int, hashed="<u8", place="<i4") -> DataFrame:
    """The chosen windows of every block of texts by hash bucket, stored: hashes, how often each, texts and places.

    ``source`` has key, text and what else ``select`` reads. A task sends every hash of a block of texts once, so a window
    that a third of all texts hold costs one entry for each block. ``hashed`` is the type of the hashes: ``<u8``, or ``S16``
    for two such numbers in one. ``place`` is the type of the positions.
    """

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        for part, data, offsets in blocks(batches):
            block += 1
            text, at, value = select(part, data, offsets)
            if not len(at):
                continue
            keys = part.column(0)
            bucket = bucket_of(value, buckets)
            order = np.argsort(value, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            text, at, value, bucket = text[order], at[order], value[order], bucket[order]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows = []
            for low, high in zip(edges[:-1], edges[1:]):
                own = value[low:high]
                first = np.append(True, own[1:] != own[:-1])
                count = np.diff(np.append(np.flatnonzero(first), high - low))
                texts, number = np.unique(text[low:high], return_inverse=True)
                parts = (
                    own[first].tobytes(), count.astype(np.int32).tobytes(),
                    b"".join(keys.take(pa.array(texts)).to_pylist()), number.astype(np.int32).tobytes(), at[low:high].astype(place).tobytes(),
                )
                rows.append((block, int(bucket[low]), sum(map(len, parts)), *parts))
            names = ["block", "bucket", "size", "hashes", "counts", "keys", "texts", "at"]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    packed = source.mapInArrow(pack, "block long, bucket long, size long, hashes binary, counts binary, keys binary, texts binary, at binary")
    return store(packed, "windows")


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    if value.dtype.itemsize > 8:
        value = np.frombuffer(value.tobytes(), "<u8")[:: value.dtype.itemsize // 8]
    return ((value >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def repeated_hashes(packed: DataFrame, hashed="<u8") -> DataFrame:
    """bucket and the packed, sorted hashes ``again`` of the windows that occur more than once."""

    def count(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table.column("hashes").to_pylist()), hashed)
        twice = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32) > 1
        alone, inverse, total = np.unique(value, return_inverse=True, return_counts=True)
        again = total > 1
        again[inverse[twice]] = True
        return pa.table({"bucket": table.column("bucket")[:1], "again": pa.array([alone[again].tobytes()], pa.binary())})

    return packed.select("bucket", "hashes", "counts").groupBy("bucket").applyInArrow(count, "bucket long, again binary")


def by_bucket(seeds: DataFrame, buckets: int) -> DataFrame:
    """Distinct (seed, shift) rows packed by bucket: sorted hashes ``again``, how many shifts each has, and these."""

    def place(batches):
        for batch in batches:
            bucket = bucket_of(batch.column(0).to_numpy().view(np.uint64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "seed", "shift"])

    def pack(table: pa.Table) -> pa.Table:
        seed, shift = table.column("seed").to_numpy().view(np.uint64), table.column("shift").to_numpy()
        order = np.argsort(seed, kind="stable")
        again, numbers = np.unique(seed[order], return_counts=True)
        packed = [again.tobytes(), numbers.astype(np.int32).tobytes(), shift[order].astype(np.int32).tobytes()]
        return pa.table({"bucket": table.column("bucket")[:1]} | {n: pa.array([p], pa.binary()) for n, p in zip(("again", "numbers", "shifts"), packed)})

    placed = seeds.select("seed", "shift").distinct().mapInArrow(place, "bucket long, seed long, shift int")
    return placed.groupBy("bucket").applyInArrow(pack, "bucket long, again binary, numbers binary, shifts binary")


def places(packed: DataFrame, known: DataFrame, hashed="<u8", place="<i4", fits: Callable | None = None) -> DataFrame:
    """key and the packed positions ``at`` of the windows whose hash is in ``known``.

    Does ``known`` name shifts, each position is given once minus every shift for which ``fits(position, shift)`` holds.
    The packs of a bucket are cut into slices of about ``SLICE_BYTES``, so that a hot bucket has more slices and none of them is
    larger. The hashes of the bucket go once to each slice, ahead of its packs, and are not repeated for every pack. What is
    found goes back to the block of texts in one row for each pack.
    """
    shifted = "shifts" in known.columns

    def view(column: pa.Array, i: int, kind) -> np.ndarray:
        return np.frombuffer(column[i].as_buffer(), kind)

    def mark(batches):
        here, wanted, numbers, shifts = None, None, None, None
        for batch in batches:
            rows = []
            hashes, counts, keys, texts, ats = batch.columns[3:]
            for i, (bucket, part, block) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if block is None:
                    # Copies, since a view would keep the whole batch.
                    here, wanted = (bucket, part), view(hashes, i, hashed).copy()
                    if shifted:
                        numbers, shifts = view(counts, i, np.int32).copy(), view(ats, i, np.int32).copy()
                    continue
                if here != (bucket, part):
                    continue
                own, count = view(hashes, i, hashed), view(counts, i, np.int32)
                which = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hit = np.repeat(wanted[which] == own, count)
                if not hit.any():
                    continue
                text, at = view(texts, i, np.int32)[hit], view(ats, i, place)[hit]
                if shifted:
                    which = np.repeat(which, count)[hit]
                    many = numbers[which]
                    start = np.repeat((np.cumsum(numbers) - numbers)[which], many)
                    inner = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
                    text, at, shift = np.repeat(text, many), np.repeat(at, many), shifts[start + inner].astype(place)
                    kept = fits(at, shift)
                    text, at = text[kept], at[kept] - shift[kept]
                    if not len(text):
                        continue
                rows.append((block, keys[i].as_py(), text.tobytes(), at.astype(place).tobytes()))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = [pa.int64()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "keys", "texts", "at"])

    def unpack(table: pa.Table) -> pa.Table:
        found: dict[bytes, list[np.ndarray]] = {}
        for keys, texts, at in zip(*(table.column(c).to_pylist() for c in ("keys", "texts", "at"))):
            text, where = np.frombuffer(texts, np.int32), np.frombuffer(at, place)
            order = np.argsort(text, kind="stable")
            text, where = text[order], where[order]
            edges = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), len(text))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                start = 16 * int(text[low])
                found.setdefault(keys[start : start + 16], []).append(where[low:high])
        packed_at = [np.unique(np.concatenate(parts)).tobytes() for parts in found.values()]
        return pa.table({"key": pa.array(list(found), pa.binary()), "at": pa.array(packed_at, pa.binary())})

    none = F.lit(None).cast("binary")
    slices = F.broadcast(packed.groupBy("bucket").agg(F.ceil(F.sum("size") / SLICE_BYTES).cast("int").alias("slices")))
    ahead = known.filter(F.octet_length("again") > 0).join(slices, "bucket")
    ahead = ahead.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("block"),
        F.col("again").alias("hashes"), (F.col("numbers") if shifted else none).alias("counts"), none.alias("keys"), none.alias("texts"),
        (F.col("shifts") if shifted else none).alias("at"),
    )
    packs = packed.join(slices, "bucket").withColumn("slice", F.pmod(F.hash("block"), F.col("slices")))
    rows = ahead.unionByName(packs.select(*ahead.columns)).repartition("bucket", "slice")
    rows = rows.sortWithinPartitions("bucket", "slice", F.col("block").asc_nulls_first())
    marked = rows.mapInArrow(mark, "block long, keys binary, texts binary, at binary")
    return marked.groupBy("block").applyInArrow(unpack, "key binary, at binary")


def repeated_windows(source: DataFrame, select: Select, buckets: int, hashed="<u8") -> DataFrame:
    """key and the packed int32 positions ``at`` of the chosen windows whose hash occurs again anywhere."""
    packed = packed_windows(source, select, buckets, hashed)
    return places(packed, repeated_hashes(packed, hashed), hashed)
