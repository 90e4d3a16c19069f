"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import functools
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.shared import open_folder, shared_path, store
from caseweave.llm.words import Words, blocks, words_of

WIDTH = 5
CONTAINMENT = 0.8
EXTRA_HASHES = 3
ITEM_SHINGLES = 1 << 21


def least_shared(shingles: int, containment: float = CONTAINMENT) -> int:
    """Shingles of an item that a document must hold."""
    return max(1, int(np.ceil(round(containment * shingles, 9))))


def sketch_size(shingles: int, containment: float = CONTAINMENT) -> tuple[int, int]:
    """Smallest hashes kept of an item and how many of them a document must hold.

    The size follows from the upper bound of the item's size partition (powers of two). A document that
    holds enough of the item misses at most ``shingles - least_shared`` of its shingles, hence at most so many
    of the sketch: no item is lost, and a sketch longer than that by a few keeps chance candidates out.
    """
    upper = (1 << shingles.bit_length()) - 1
    size = min(shingles, upper - least_shared(upper, containment) + 1 + EXTRA_HASHES)
    return size, max(1, size - (shingles - least_shared(shingles, containment)))


def _grouped(owner: np.ndarray, value: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, and for each the owners that have it: (values, starts, owners)."""
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    distinct, first = np.unique(value, return_index=True)
    return distinct, np.append(first, len(value)), owner


def _pairs(words_in: np.ndarray, hashes: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(text, owner, value number) for texts that have an indexed value, each value once per text."""
    distinct, starts, owners = index
    if not len(distinct) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(distinct, hashes), len(distinct) - 1)
    hit = distinct[at] == hashes
    both = np.unique(words_in[hit] * len(distinct) + at[hit])
    text, value = both // len(distinct), both % len(distinct)
    count = starts[value + 1] - starts[value]
    place = np.repeat(starts[value] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return np.repeat(text, count), owners[place]


@dataclass
class ItemIndex:
    """A block of test items: ids, shingle counts, least shares, and per window width the sketch and all shingles."""

    ids: list
    sizes: np.ndarray
    least: np.ndarray
    need: np.ndarray
    by_width: dict[int, tuple[np.ndarray, tuple, tuple]]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shared shingles) for all items contained in texts of a block."""
        words = words_of(data, offsets)
        hashes = words.hashes(fold=True)
        n, found = len(self.ids), []
        for width, (coarse, sketch, shingles) in self.by_width.items():
            at, window = words.windows(hashes, width)
            texts = words.text_of[at]
            # Documents too short for an item are left out by its size partition.
            room = np.bincount(texts, minlength=len(words.counts))
            near = coarse[(window & np.uint64(0xFFFF)).astype(np.int64)]
            text, item = _pairs(texts[near], window[near], sketch)
            pair, hits = np.unique(text * n + item, return_counts=True)
            candidate = pair[(hits >= self.need[pair % n]) & (room[pair // n] >= self.least[pair % n])]
            if not len(candidate):
                continue
            exact = np.zeros(len(words.counts), bool)
            exact[candidate // n] = True
            here = exact[texts]
            text, item = _pairs(texts[here], window[here], shingles)
            pair, shared = np.unique(text * n + item, return_counts=True)
            true = np.isin(pair, candidate) & (shared >= self.least[pair % n])
            found.append((pair[true] // n, pair[true] % n, shared[true]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


def item_shingles(words: Words) -> list[tuple[int, np.ndarray]]:
    """Window width and distinct window hashes of every item; an item of fewer words is one window of all its words."""
    hashes = words.hashes(fold=True)
    out = []
    for low, high in zip(words.first[:-1], words.first[1:]):
        width = min(WIDTH, int(high - low))
        if not width:
            out.append((0, np.zeros(0, np.uint64)))
            continue
        part = Words(words.data, words.offsets, words.start[low:high], words.end[low:high], np.array([0, high - low]))
        out.append((width, np.unique(part.windows(hashes[low:high], width)[1])))
    return out


def build_index(ids: list, items: list[tuple[int, np.ndarray]], containment: float = CONTAINMENT) -> ItemIndex:
    sizes = np.array([len(s) for _, s in items], np.int64)
    plans = [sketch_size(max(int(s), 1), containment) for s in sizes]
    by_width = {}
    for width in sorted({w for w, _ in items if w}):
        numbers = [i for i, (w, _) in enumerate(items) if w == width]
        # Window hashes are well mixed, so the smallest are a MinHash sketch.
        sketches = [items[i][1][: plans[i][0]] for i in numbers]
        sketch = _grouped(np.repeat(numbers, [len(s) for s in sketches]), np.concatenate(sketches), len(ids))
        sets = [items[i][1] for i in numbers]
        shingles = _grouped(np.repeat(numbers, [len(s) for s in sets]), np.concatenate(sets), len(ids))
        coarse = np.zeros(1 << 16, bool)
        coarse[(sketch[0] & np.uint64(0xFFFF)).astype(np.int64)] = True
        by_width[width] = (coarse, sketch, shingles)
    least = np.array([least_shared(max(int(s), 1), containment) for s in sizes], np.int64)
    return ItemIndex(ids, sizes, least, np.array([need for _, need in plans], np.int64), by_width)


def item_blocks(items: DataFrame, limit: int = ITEM_SHINGLES, containment: float = CONTAINMENT) -> tuple[DataFrame, list[str]]:
    """item_id, item (stands for its set of shingles) and item_shingles; and files of the indexes of blocks of items.

    Equal sets are one entry, so copies of an item neither fill a block nor repeat its work. Blocks of
    about ``limit`` shingles (16 MB) are built and written by tasks; only the names of the files come to the driver.
    """
    source = items.select("item_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([
        source.schema["item_id"], T.StructField("width", T.IntegerType()),
        T.StructField("shingles", T.BinaryType()), T.StructField("size", T.LongType()),
    ])

    def shingle(batches):
        for rows, data, offsets in blocks(batches):
            found = item_shingles(words_of(data, offsets))
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([w for w, _ in found], pa.int32()),
                pa.array([s.tobytes() for _, s in found], pa.binary()), pa.array([len(s) for _, s in found], pa.int64()),
            ], names=schema.names)

    kept = source.mapInArrow(shingle, schema).filter("size > 0").withColumn("item", F.unhex(F.md5(F.concat("shingles", F.encode(F.col("width").cast("string"), "UTF-8")))))
    kept = store(kept, "items")
    sets = kept.groupBy("item").agg(F.first("width").alias("width"), F.first("shingles").alias("shingles"), F.first("size").alias("size"))
    sets = store(sets, "sets")
    total = sets.agg(F.sum("size")).first()[0] or 0
    folder = shared_path(items.sparkSession, "items-index")

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("item", "width", "shingles"))))
        index = build_index([r[0] for r in rows], [(r[1], np.frombuffer(r[2], np.uint64)) for r in rows], containment)
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.index"  # a repeated task writes a file of its own
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(index))
        return pa.table({"path": [f"{folder}/{name}"]})

    numbered = sets.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-total // limit)))))
    written = store(numbered.groupBy("block").applyInArrow(build, "path string"), "blocks")
    return kept.select("item_id", "item", F.col("size").alias("item_shingles")), sorted(r.path for r in written.collect())


@functools.lru_cache(maxsize=1)
def _opened(path: str) -> ItemIndex:
    system, place = open_folder(path)
    with system.open_input_stream(place) as file:
        return pickle.loads(file.read())


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, limit: int = ITEM_SHINGLES) -> DataFrame:
    """Pairs of a document and a test item of whose distinct shingles it holds at least ``containment``.

    Shingles are runs of five words, ASCII letters taken as lower case; an item of one to four words is one
    shingle of all its words. A whole-document MinHash signature cannot find an item in a long document (their
    similarity is the ratio of their sizes), so the sketch is the item's: partitioned by size, its smallest
    hashes are looked up among all windows of a document, and the candidates are verified in the same task.
    The documents are not shuffled; every task reads the stored blocks of items one after another, one pass over the
    documents for each. Hashes have 64 bits.

    Texts or items that are null or have no words match nothing. Repeated documents, or items, give a row each
    (rows equal in both ids and counts appear as often). Other columns are ignored; an empty table gives no rows. Ids may
    have any type. Returns doc_id, item_id, item_shingles, shared, containment.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("item", T.BinaryType()), T.StructField("shared", T.LongType())])

    def search(path: str, batches):
        index = _opened(path)
        for rows, data, offsets in blocks(batches):
            text, item, shared = index.matches(data, offsets)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(text)), pa.array([index.ids[i] for i in item], pa.binary()), pa.array(shared.astype(np.int64)),
            ], names=schema.names)

    listed, paths = item_blocks(items, limit, containment)
    parts = [source.mapInArrow(functools.partial(search, path), schema) for path in paths]
    found = functools.reduce(DataFrame.unionAll, parts, docs.sparkSession.createDataFrame([], schema))
    share = F.col("shared") / F.col("item_shingles")
    return found.join(listed, "item").select("doc_id", "item_id", "item_shingles", "shared", share.alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, limit: int = ITEM_SHINGLES) -> DataFrame:
    """Documents that hold no test item, all columns as they came; the search of ``contained_items``."""
    text_at, schema = docs.columns.index("text"), docs.schema

    def clean(path: str, batches):
        index = _opened(path)
        for batch in batches:
            for rows, data, offsets in blocks([batch], batch.schema.names[text_at]):
                text, _, _ = index.matches(data, offsets)
                keep = np.ones(rows.num_rows, bool)
                keep[text] = False
                yield rows.filter(pa.array(keep))

    for path in item_blocks(items, limit, containment)[1]:
        docs = docs.mapInArrow(functools.partial(clean, path), schema)
    return docs
