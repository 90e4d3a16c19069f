"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, permuted block indexes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.shared import partitions, store, unused, with_offsets
from caseweave.llm.words import blocks, words_of

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = 20_240_601


def word_counts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, ``carry`` and the number of words of every text."""
    names = ["doc_id", "source", *carry]
    narrow = docs.select(*names, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("size", T.LongType())])

    def count(batches):
        for rows, data, offsets in blocks(batches):
            sizes = pa.array(words_of(data, offsets).counts, pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], sizes], [*names, "size"])

    return narrow.mapInArrow(count, schema)


def capped_targets(sizes: Sequence[float], weights: Sequence[float], repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; what a source cannot fill is reshared by weight among the others."""
    targets, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while active:
        unit = left / sum(weights[i] for i in active)
        over = {i for i in active if unit * weights[i] > repeats * sizes[i]}
        if not over:
            for i in active:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(repeats * sizes[i])
            left -= targets[i]
        active -= over
    return targets


def _keyed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of range(size) at ``index``: a Feistel network, walked until it is back in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(6):
            left, right = right, left ^ (_keyed(right, key * 8 + turn) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """``documents``: one row per document with its offset in its source; ``pieces``: slots of the mix with the parts of documents in them."""

    documents: DataFrame
    pieces: DataFrame


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    repeats: int = MAX_REPEATS,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> Mixture:
    """Mix all sources to targets given by weights (cycled over the sources in code point order, null last).

    The words of a source, its documents in order of (doc_id, size), are cut into blocks of ``block_words``.
    Every shard of the mix draws multinomial counts of its slots per source from its own seeded generator.
    The numbered slots of a source run through pseudorandom permutations of its blocks, a new one for each
    pass, so a block comes again only when all have come, ``repeats`` times at most. What a source was drawn
    too often or too seldom is settled at its last slots, so that the taken words equal the target up to one block.

    The one thing gathered on the driver is a row for each source, to which the weights belong anyway.
    Null or wordless texts have size 0 and take no part; an empty table gives no rows; repeated rows count as
    documents of their own; other columns are ignored, but for those in ``carry``, which go on to both results.
    Reruns agree.
    """
    spark = docs.sparkSession
    sized = store(word_counts(docs, carry), "sizes")
    totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    sizes = [totals[n] for n in names]
    weight = [float(weights[i % len(weights)]) for i in range(len(names))]
    targets = capped_targets(sizes, weight, repeats)
    n_blocks = [-(-size // block_words) for size in sizes]
    slots = [min(round(t * n / z), repeats * n) if z else 0 for t, n, z in zip(targets, n_blocks, sizes)]
    info = spark.createDataFrame(
        [(i, n, z, t) for i, (n, z, t) in enumerate(zip(names, sizes, targets))],
        T.StructType([
            T.StructField("source_no", T.LongType(), False), T.StructField("name", sized.schema["source"].dataType),
            T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        ]),
    )
    # A row for each source is small, but the optimizer does not know its size, and would gather the documents instead.
    placed = sized.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("name")))
    placed = placed.select("doc_id", "source", *carry, "size", "source_no", "source_size", "target")
    placed = store(with_offsets(placed, ["source_no"], ["doc_id", "size"], "size", "offset"), "placed")

    parts = placed.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})"))
    )
    parts = parts.select(
        "source_no", "block", "offset", *carry,
        F.greatest(F.lit(0), F.col("block") * block_words - F.col("offset")).alias("word_start"),
        F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("offset")).alias("word_end"),
    )

    total = sum(slots)
    shards = -(-total // shard_slots)
    share = np.array(slots, float) / max(total, 1)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(shard)]))
                counts = rng.multinomial(min(shard_slots, total - int(shard) * shard_slots), share)
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": int(shard), "source_no": used, "slots": counts[used]})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source_no long, slots long")
    drawn = store(drawn, "draws")
    wanted = spark.createDataFrame(
        [(i, s, n) for i, (s, n) in enumerate(zip(slots, n_blocks))], "source_no long, wanted long, n_blocks long"
    )
    last = drawn.groupBy("source_no").agg(F.sum("slots").alias("drawn"))
    settled = wanted.join(last, "source_no", "left").select(
        F.lit(shards).cast("long").alias("shard"), "source_no",
        F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.coalesce("drawn", F.lit(0))).alias("slots"),
    )
    counted = with_offsets(drawn.unionByName(settled), ["source_no"], ["shard"], "slots", "first")
    counted = counted.join(F.broadcast(wanted), "source_no").withColumn(
        "slots", F.least(F.col("slots"), F.col("wanted") - F.col("first"))
    )

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                for low in range(row.first, row.first + row.slots, 1 << 16):
                    j = np.arange(low, min(low + (1 << 16), row.first + row.slots))
                    turns, block = j // row.n_blocks, np.empty_like(j)
                    for turn in np.unique(turns):
                        key = seed + 1_000_003 * int(row.source_no) + 7_919 * int(turn)
                        block[turns == turn] = permuted(j[turns == turn] % row.n_blocks, row.n_blocks, key)
                    yield pd.DataFrame(
                        {"shard": row.shard, "source_no": row.source_no, "slot": j, "turn": turns, "block": block}
                    )

    schema = "shard long, source_no long, slot long, turn long, block long"
    numbered = counted.filter("slots > 0").select("shard", "source_no", "slots", "first", "n_blocks")
    # Few, narrow rows that turn into many: dealt by an explicit number, which adaptive execution keeps.
    numbered = numbered.repartition(partitions(docs.sparkSession), "shard", "source_no")
    numbered = numbered.mapInPandas(number, schema)
    # Both sides hold a row for each block, where the optimizer counts the few rows or small files they come from: left
    # to itself it would gather one of them on the driver and broadcast it.
    return Mixture(placed, numbered.join(parts.hint("merge"), ["source_no", "block"]))


def taken_words(mixture: Mixture) -> DataFrame:
    """Words that the mix takes of every document, repeats counted."""
    taken = mixture.pieces.groupBy("source_no", "offset").agg(F.sum(F.expr("word_end - word_start")).alias("words"))
    # An offset belongs to one document with words; documents without words share it.
    placed = mixture.documents
    used = placed.join(taken, ["source_no", "offset"], "left")
    words = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long")
    return used.select("doc_id", "source", "size", "source_size", "target", words.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass over a document in which the mix takes some of it.

    The text holds what that pass takes, in order: all of it unchanged, or runs of its words, one to a line.
    ``n_chars``, if there, is counted anew; other columns stay. Documents without words, and those that no pass
    takes, are left out. Options and edge cases are those of ``mix_sources``.
    """
    row, taken_at = unused(docs, "row"), unused(docs, "taken")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    pieces = mix_sources(rows, carry=[row], **options).pieces
    taken = pieces.groupBy(row, "turn").agg(
        F.sort_array(F.collect_list(F.struct("word_start", "word_end"))).alias(taken_at)
    )
    joined = rows.join(taken.drop("turn"), row).select(*[F.col(f"`{c}`") for c in docs.columns], taken_at)
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")

    def cut(batches):
        for part, data, offsets in blocks(batches):
            words, texts = words_of(data, offsets), []
            taken = part.column(len(names)).to_pylist()
            for i, runs in enumerate(taken):
                first, runs = int(words.first[i]), _merged(runs)
                if runs == [(0, int(words.counts[i]))]:
                    texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
                    continue
                spans = [(int(words.start[first + a]), int(words.end[first + b - 1])) for a, b in runs]
                texts.append(b"\n".join(data[a:b].tobytes() for a, b in spans))
            columns = list(part.columns[: len(names)])
            columns[text_at] = pa.array([t.decode() for t in texts], columns[text_at].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([len(t.decode()) for t in texts], pa.int64()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # The cut names its columns by place, so clashing names of extra columns do no harm.
    return joined.mapInArrow(cut, schema)


def _merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for run in runs:
        a, b = int(run["word_start"]), int(run["word_end"])
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
