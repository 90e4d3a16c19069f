"""Substring dedup on words by level-wise doubling of repeated windows."""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.repeats import chosen_minima, positions, repeated_windows, slide
from caseweave.llm.shared import distinct_texts, store, text_key
from caseweave.llm.words import blocks, rolling, words_of

WINDOW = 35
FIRST = 9
_TOP = np.uint64(2**64 - 1)


def levels(first: int, window: int) -> list[int]:
    """Lengths from ``first``, doubled up to ``window``."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _hashes(words, hashes: np.ndarray, width: int, base: int = 0xB5297A4D3F84D5B5) -> np.ndarray:
    """Window hashes at all positions, those across two texts included."""
    sums, powers = rolling(hashes, base)
    raw = (sums[width:] - sums[:-width]) * powers.down[: len(hashes) - width + 1]
    raw = (raw ^ (raw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(width)
    return np.maximum((raw ^ (raw >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25), 1)


def _seeds(window: int, before: int | None, width: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """Windows of ``width`` words that stand for the surviving windows of ``window`` words.

    A window of full length is represented at each level by the least hash among the shorter windows in it, so that
    equal windows have equal representatives. It survives a level if that one is repeated; ``before`` is the length
    of the level before, whose repeated positions are in the third column.
    """
    words = words_of(data, offsets)
    none = np.zeros(0, np.int64)
    if len(words.start) < window:
        return none, none, np.zeros(0, np.uint64)
    hashes = words.hashes()
    alive = words.text_of[: len(words.start) - window + 1] == words.text_of[window - 1 :]
    if before is not None:
        value, span = _hashes(words, hashes, before), window - before + 1
        marked = np.full(len(value), _TOP)
        for first, at in zip(words.first[:-1], positions(part.column(2))):
            marked[first + at] = value[first + at]
        alive &= slide(marked, span, np.minimum) == slide(value, span, np.minimum)
    value, span = _hashes(words, hashes, width), window - width + 1
    least = np.where(alive, slide(value, span, np.minimum), np.uint64(0))
    at = np.flatnonzero(chosen_minima(value, least, span))
    text = words.text_of[at]
    found = value[at]
    if width == window:
        # What is removed rests on two independent hashes of the window, over 64-bit hashes of its words.
        other = _hashes(words, hashes, width, 0xA0761D6478BD642F)[at]
        found = np.frombuffer(np.stack([found, other], 1).tobytes(), "S16")
    return text, at - words.first[text], found


def repeated_word_windows(texts: DataFrame, groups: int, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """key and packed positions of the windows of ``window`` words that occur again among distinct texts or in their own."""
    found, before = None, None
    for width in levels(first, window):
        source = texts.select("key", "text")
        if found is not None:
            source = texts.join(found, "key").select("key", "text", "at")
        found = store(repeated_windows(source, functools.partial(_seeds, window, before, width), groups, "S16" if width == window else "<u8"), "level")
        before = width
    return found


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers, judged on the input.

    Lengths 9, 18 and 35: a text sends the windows of one length that stand for what is left of it, and only what is
    repeated at this length is looked at again at twice that length. Copies of a whole text are one text with a
    count; if it has a full window, all its words go. Hashes have 64 bits, those of full windows 128 (over 64-bit hashes of words).

    Null text has no words. Repeated rows are copies. An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words, one space between).
    """
    texts, groups = distinct_texts(docs)
    found = repeated_word_windows(texts, groups, window, first)
    source = texts.join(found, "key", "left").select("key", "text", "copies", "at")

    def clean(batches):
        for part, data, offsets in blocks(batches):
            words, rows = words_of(data, offsets), []
            copies = part.column(2).to_pylist()
            for i, at in enumerate(positions(part.column(3))):
                n = int(words.counts[i])
                kept = data[offsets[i] : offsets[i + 1]].tobytes().split()
                if copies[i] > 1 and n >= window:
                    kept = []
                elif len(at):
                    edges = np.zeros(n + 1, np.int32)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    kept = list(itertools.compress(kept, (np.cumsum(edges)[:n] == 0).tolist()))
                joined = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["key", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    cleaned = source.mapInArrow(clean, "key binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return docs.select("doc_id", text_key().alias("key")).join(cleaned, "key").drop("key")
