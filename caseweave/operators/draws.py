"""Draws of the bootstrap as arrays: the random numbers, and the sums of what replicates draw in a block.

For tasks of Arrow batches. Nothing here needs this package on the workers: its functions are pickled by value.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Draws worked on at once, so that their arrays stay in the processor's cache.
CHUNK = 16_384
MASK = 2**32 - 1
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) & MASK for i in range(64)]
MD5_TURNS = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
MD5_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
POWERS_OF_TEN = 10 ** np.arange(1, 19)
# The first word of a digest is final after this step.
MD5_FIRST_WORD = 61

# Numbers of 0 at least for replicates, which are rows, and a range of the places, which are columns: (rep, key, range).
Numbers = Callable[[np.ndarray, np.ndarray, slice], np.ndarray]
# From the text of seed and stratum, and the places of a block.
Draw = Callable[[bytes, np.ndarray], Numbers]


def _xxh64(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit numbers."""
    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    first, second, third = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    x = (seed + np.uint64(0x27D4EB2F165667C5 + 8)) ^ (turned(value * second, 31) * first)
    x = turned(x, 27) * first + np.uint64(0x85EBCA77C2B2AE63)
    x = (x ^ (x >> np.uint64(33))) * second
    x = (x ^ (x >> np.uint64(29))) * third
    return x ^ (x >> np.uint64(32))


def hashed_draw(text: bytes, place: np.ndarray) -> Numbers:
    """63-bit numbers that depend only on seed, stratum, replicate and place, so lost tasks repeat them exactly.

    ``key`` is the number of the replicate. The hash is XXH64 of it (seed 42), and of the place with that as its seed.
    """
    places = place.astype(np.uint64)[None, :]

    def numbers(rep: np.ndarray, key: np.ndarray, columns: slice) -> np.ndarray:
        seeds = _xxh64(key.astype(np.uint64), np.full(len(key), 42, np.uint64))
        return _xxh64(places[:, columns], seeds[:, None]) >> np.uint64(1)

    return numbers


def digest_draw(text: bytes, place: np.ndarray) -> Numbers:
    """Same contract from the first 8 hexadecimal digits of an MD5 digest of every draw: slower, and simple to repeat in other engines.

    The digested text is ``text``, the replicate and the place, with a bar between them.
    """
    messages: dict[int, list] = {}

    def numbers(rep: np.ndarray, key: np.ndarray, columns: slice) -> np.ndarray:
        out = np.empty((len(rep), columns.stop - columns.start), np.uint32)
        lengths = np.searchsorted(POWERS_OF_TEN, rep, "right") + 1
        for digits in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == digits)
            if digits not in messages:
                messages[digits] = _messages(text + b"|", digits, place)
            for first, last, state, at, words in messages[digits]:
                low, high = max(first, columns.start), min(last, columns.stop)
                if low < high:
                    cut = [word if isinstance(word, int) else word[None, low - first : high - first] for word in words]
                    out[rows, low - columns.start : high - columns.start] = _digests(state, at, cut, rep[rows], digits, high - low)
        return out

    return numbers


def _messages(fixed: bytes, rep_digits: int, place: np.ndarray) -> list[tuple[int, int, tuple[int, ...], int, list]]:
    """What is digested for places in ascending order, as padded words, with zeros where the digits of a replicate go.

    For each range of the places whose texts take as many blocks of 64 bytes: its ends, the state after the blocks that ``fixed``
    fills, where the replicate's digits go, and the words, each a number or an array over the places.
    """
    state, done = MD5_START, len(fixed) // 64 * 64
    for low in range(0, done, 64):
        state, _ = _known_steps(state, [int.from_bytes(fixed[i : i + 4], "little") for i in range(low, low + 64, 4)])
    tail, at = fixed[done:], len(fixed) - done + rep_digits + 1
    digits = np.searchsorted(POWERS_OF_TEN, place, "right") + 1
    blocks = (at + digits + 9 + 63) // 64
    out = []
    for count in np.unique(blocks).tolist():
        first, last = np.searchsorted(blocks, [count, count + 1]).tolist()
        text = np.zeros((64 * count, last - first), np.uint8)
        text[: len(tail)] = np.frombuffer(tail, np.uint8)[:, None]
        text[at - 1] = ord("|")
        for size in np.unique(digits[first:last]).tolist():
            same = slice(*np.searchsorted(digits[first:last], [size, size + 1]).tolist())
            for i in range(size):
                text[at + i, same] = place[first:last][same] // 10 ** (size - 1 - i) % 10 + 48
            text[at + size, same] = 0x80
            text[-8:, same] = np.frombuffer((8 * (done + at + size)).to_bytes(8, "little"), np.uint8)[:, None]
        parts = text.reshape(16 * count, 4, -1).astype(np.uint32) << np.array([0, 8, 16, 24], np.uint32)[:, None]
        rows = np.bitwise_or.reduce(parts, axis=1)
        words = [int(row[0]) if (row == row[0]).all() else row for row in rows]
        out.append((first, last, state, len(tail), words))
    return out


def _digests(state: tuple[int, ...], at: int, words: list, rep: np.ndarray, rep_digits: int, width: int) -> np.ndarray:
    """First word of the MD5 digest of each message with each of the replicates put in."""
    shape, words = (len(rep), width), list(words)
    for i in range(rep_digits):
        digit = (rep[:, None] // 10 ** (rep_digits - 1 - i) % 10 + 48).astype(np.uint32)
        word, shift = divmod(at + i, 4)
        words[word] = words[word] | (digit << np.uint32(8 * shift))
    words = [word if isinstance(word, int) else np.ascontiguousarray(np.broadcast_to(word, shape)) for word in words]
    for low in range(0, len(words), 16):
        state = _steps(state, words[low : low + 16], shape, MD5_FIRST_WORD if low + 16 == len(words) else 64)
    return state[0].byteswap()


def _known_steps(state: Sequence[int], words: list) -> tuple[tuple[int, ...], int]:
    """MD5 with plain numbers up to the first word that is an array: the registers and the steps done, or at the end the new state."""
    a, b, c, d = state
    for i in range(64):
        word = words[MD5_WORDS[i]]
        if not isinstance(word, int):
            return (a, b, c, d), i
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | (~d & MASK)))[i // 16]
        x = (a + f + MD5_SINES[i] + word) & MASK
        a, b, c, d = d, (b + (x << MD5_TURNS[i] | x >> (32 - MD5_TURNS[i]))) & MASK, b, c
    return tuple((x + y) & MASK for x, y in zip(state, (a, b, c, d))), 64


def _steps(state: Sequence, words: list, shape: tuple[int, int], steps: int) -> list[np.ndarray]:
    """MD5 of one block of words for many texts at once, in place; after fewer than 64 steps only the first word counts."""
    registers, begun = _known_steps(state, words) if all(isinstance(x, int) for x in state) else (state, 0)
    a, b, c, d = (np.array(np.broadcast_to(np.asarray(x, np.uint32), shape)) for x in registers)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    if begun == 64:  # no word is an array
        return [a, b, c, d]
    for i in range(begun, steps):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[MD5_WORDS[i]]
        if isinstance(word, int):
            f += np.uint32((MD5_SINES[i] + word) & MASK)
        else:
            f += np.uint32(MD5_SINES[i])
            f += word
        np.right_shift(f, np.uint32(32 - MD5_TURNS[i]), out=turned)
        np.left_shift(f, np.uint32(MD5_TURNS[i]), out=f)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    if steps < 64:
        return [b + np.asarray(state[0], np.uint32)]
    return [x + np.asarray(y, np.uint32) for x, y in zip((a, b, c, d), state)]


def block_sums(batches: Iterator[pa.RecordBatch], draw: Draw, strata: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """For each row, which is a block with replicates that draw in it, a row of sums for each of these replicates."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield _block_sums({name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}, draw, strata)


def _block_sums(row: dict[str, pa.Scalar], draw: Draw, strata: Sequence[str]) -> pa.RecordBatch:
    """Sums of the units drawn in one block by each replicate, and twice the area below their piece of the curve.

    Draws are sorted numbers of units, which stand in the order of the curve; they are added one after the other. A sum is
    unknown if one of its units is. ``_fc`` and ``_fp`` are the first unit's.
    """
    draws = row["_draws"].values
    rep, key, times = (draws.field(name).to_numpy(zero_copy_only=False) for name in ("rep", "_key", "_m"))
    lists = [row[name].values for name in ("_cs", "_ps")]
    size, block, text = len(lists[0]), row["_block"].as_py(), row["_text"].as_py().encode()
    # A place after the last unit takes what a replicate does not draw.
    values = [np.append(x.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) for x in lists]
    unknown = [np.append(x.is_null().to_numpy(zero_copy_only=False), False) for x in lists]
    out = {name: np.empty(len(rep)) for name in ("_c", "_p", "_a", "_fc", "_fp")}
    missing = {name: np.zeros(len(rep), bool) for name in out}
    most = int(times.max())
    numbers, step = draw(text, (block << 32) + np.arange(most)), max(1, CHUNK // most)
    for low in range(0, len(rep), step):
        part = slice(low, min(low + step, len(rep)))
        taken = times[part]
        width = int(taken.max())
        picks = np.empty((len(taken), width), np.int64)
        for left in range(0, width, CHUNK):
            columns = slice(left, min(left + CHUNK, width))
            drawn = numbers(rep[part], key[part], columns)
            picks[:, columns] = drawn - drawn // drawn.dtype.type(size) * drawn.dtype.type(size)
        picks[np.arange(width) >= taken[:, None]] = size
        picks.sort(axis=1)
        (case, people), last = (x[picks] for x in values), (np.arange(len(taken)), taken - 1)
        with np.errstate(all="ignore"):
            cases = np.cumsum(case, axis=1)
            before = np.zeros_like(cases)
            before[:, 1:] = cases[:, :-1]
            sums = cases, np.cumsum(people, axis=1), np.cumsum(people * (2 * before + case), axis=1)
        for name, x in zip(("_c", "_p", "_a"), sums):
            out[name][part] = x[last]
        out["_fc"][part], out["_fp"][part] = case[:, 0], people[:, 0]
        for x, total, first in zip(unknown, ("_c", "_p"), ("_fc", "_fp")):
            if x.any():
                missing[total][part], missing[first][part] = x[picks].any(axis=1), x[picks[:, 0]]
    missing["_a"] = missing["_c"] | missing["_p"]
    same = {name: pa.array([row[name].as_py()] * len(rep), row[name].type) for name in (*strata, "_block")}
    sums = {name: pa.array(x, pa.float64(), mask=missing[name]) for name, x in out.items()}
    columns = {**same, "rep": pa.array(rep, pa.int32()), "_m": pa.array(times, pa.int64()), **sums}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
