"""Suffix-array dedup of bytes: a distributed merge sort of suffixes that exchanges front-coded runs and merges them with LCP loser trees."""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.repeats import by_bucket, chosen_minima, packed_windows, places, positions, repeated_hashes, slide
from caseweave.llm.shared import distinct_texts, partitions, store, text_key
from caseweave.llm.words import _byte_values, blocks, rolling

LENGTH = 400
RUN_BYTES = 24 << 20
SAMPLES = 20
# Sorted strings of one partition, before they are front-coded.
PART_BYTES = 64 << 20
# Up to so many different strings with one seed are compared where they have been sorted.
CLASS = 16
AHEAD, BACK, WHOLE = 1, 2, 3
# Follows the first part of a sorted string; not a byte of UTF-8, so first parts of different lengths stay apart.
_STOP = b"\xff"
# Who has a string: key of the text, place of the anchor, bytes ahead of it.
_OWNER = 22
# Added to that number if the run has the string more than once.
_COPIED = 1 << 15
_TAIL = struct.Struct("<iH")
_FOUND = np.dtype([("at", "<i4"), ("ahead", "<u2"), ("back", "<u2"), ("most", "<u2")])
_RECORD = np.dtype([("key", "V16"), ("at", "<i4"), ("ahead", "<u2"), ("back", "<u2"), ("most", "<u2")])
_MATCH = struct.Struct("<HHH")


def seed_length(length: int) -> int:
    return max(1, length * 9 // 25)


# --- Sorted runs ------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    end = min(len(a), len(b))
    while start < end:
        x, y = a[start : start + 64], b[start : start + 64]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return min(end, start + n - (differ.bit_length() + 7) // 8)
        start += 64
    return end


class Run:
    """A front-coded run: for each string the bytes shared with the one before, the rest, and who has it."""

    @staticmethod
    def encode(strings: list[bytes], owners: list[bytes]) -> bytes:
        numbers, rest, before = [], [], b""
        for text, owner in zip(strings, owners):
            shared = common(before, text, 0)
            numbers += [shared, len(text) - shared, len(owner)]
            rest += [text[shared:], owner]
            before = text
        head = struct.pack("<I", len(strings)) + np.array(numbers, np.uint32).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(rest))

    def __init__(self, packed: bytes):
        self.raw = zstandard.ZstdDecompressor().decompress(packed)
        self.count = struct.unpack_from("<I", self.raw)[0]
        self.numbers = np.frombuffer(self.raw, np.uint32, 3 * self.count, 4).tolist()
        self.number, self.place = 0, 4 + 12 * self.count
        self.text, self.owner = b"", b""

    def step(self) -> int:
        """Go to the next string; the bytes it shares with the last, or -1 at the end."""
        if self.number == self.count:
            return -1
        shared, more, owner = self.numbers[3 * self.number : 3 * self.number + 3]
        self.text = self.text[:shared] + self.raw[self.place : self.place + more]
        self.owner = self.raw[self.place + more : self.place + more + owner]
        self.place += more + owner
        self.number += 1
        return shared


def merged(runs: list[Run]):
    """(string, owners, LCP with the string before) of all runs in order, by a loser tree.

    Every loser keeps its LCP with the last winner it met. The longer LCP wins without a look at the strings;
    only equal ones are compared, and only beyond the known prefix.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    known = [run.step() for run in runs] + [-1] * (size - len(runs))
    loser = [0] * size

    def play(a: int, b: int) -> int:
        """The winner; the other gets its LCP with the winner if that became known."""
        if known[a] != known[b]:
            return a if known[a] > known[b] else b
        if known[a] < 0:
            return a
        x, y = runs[a].text, runs[b].text
        shared = common(x, y, known[a])
        first = shared == len(x) or (shared < len(y) and x[shared] < y[shared])
        known[b if first else a] = shared
        return a if first else b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        winner = play(a, b)
        loser[node] = b if winner == a else a
        return winner

    winner = build(1) if size > 1 else 0
    while known[winner] >= 0:
        run = runs[winner]
        yield run.text, run.owner, known[winner]
        known[winner] = run.step()
        node = (winner + size) >> 1
        while node:
            other = loser[node]
            better = play(winner, other)
            if better != winner:
                loser[node], winner = winner, better
            node >>= 1


# --- Distributed sort ---------------------------------------------------------------


def _distinct(runs: list[Run]):
    """(string, all owners, LCP with the string before) of all runs."""
    held = None
    for text, owners, lcp in merged(runs):
        if held and lcp == len(text) == len(held[0]):
            held[1] += owners
            continue
        if held:
            yield held
        held = [text, owners, lcp]
    if held:
        yield held


class _Matches:
    """Takes the different strings of a partition in order and collects what their anchors have in common.

    Strings that begin with the same seed are a class. A class inside the partition that has ``CLASS`` strings at most is
    settled: every pair of its strings is known from their prefixes. Of larger ones, and of those at the ends of the partition,
    every string is held against its two neighbours, one after the other; if some may be repeated with one partner ahead
    and another back, the seed stays open.
    """

    def __init__(self, kind: int, length: int, parts: int):
        self.kind, self.length, self.seed, self.parts = kind, length, seed_length(length), parts
        self.records: dict[int, list[bytes]] = {}
        self.seeds: list[bytes] = []
        self.members: list[tuple] = []
        self.pending = self.match = self.text = None
        self.border = self.by_neighbours = True
        self.open = False

    def put(self, owners: bytes, ahead: int, back: int, most: int) -> None:
        for low in range(0, len(owners), _OWNER):
            one = owners[low : low + 20]
            self.records.setdefault(home(one, self.parts), []).append(one + _MATCH.pack(ahead, back, most))

    def sides(self, text: bytes, owners: bytes) -> tuple[int, int, bytes, bool]:
        """Bytes ahead of the anchor (its own included), bytes back, what the order compares last, and whether it has copies."""
        ahead = int.from_bytes(owners[20:22], "little")
        copied, ahead = len(owners) > _OWNER or ahead >= _COPIED, ahead % _COPIED
        back = len(text) - ahead - 1
        return ahead, back, text[ahead + 1 :] if self.kind == AHEAD else text[self.seed + back + 1 :], copied

    def agree(self, a: tuple, b: tuple, lcp: int) -> tuple[int, int]:
        """How far two anchors agree ahead and back, given the common prefix of what was sorted."""
        if self.kind == AHEAD:
            return min(lcp, a[0], b[0]), common(a[2], b[2], 0)
        return self.seed + common(a[2], b[2], 0), min(lcp - self.seed, a[1], b[1])

    def add(self, text: bytes, owners: bytes, lcp: int) -> None:
        if self.kind == WHOLE:
            if len(owners) > _OWNER:
                self.put(owners, self.length, 0, 0)
            return
        if self.text is not None and lcp < self.seed:
            self.close()
        self.text = text
        member = text, owners, lcp, self.sides(text, owners)
        if self.by_neighbours:
            self.next(member)
            return
        self.members.append(member)
        if len(self.members) > CLASS:
            self.by_neighbours = True
            self.drain()

    def drain(self) -> None:
        for member in self.members:
            self.next(member)
        self.members = []

    def next(self, member: tuple | None) -> None:
        after = None
        if self.pending is not None:
            if member is not None:
                after = self.agree(self.pending[3], member[3], member[2])
            _, owners, _, (ahead, back, _, copied) = self.pending
            matches = [m for m in (self.match, after) if m]
            if copied:
                self.put(owners, ahead, back, back)
            else:
                for match in matches:
                    self.put(owners, *match, back)
                self.open = self.open or (bool(matches) and self.uncovered(back, matches))
        self.pending, self.match = member, after

    def uncovered(self, most: int, matches: list[tuple[int, int]]) -> bool:
        """Whether a string may be repeated that no single one of the partners shows."""
        at = self.length - max(ahead for ahead, _ in matches)
        for first, last in sorted((self.length - ahead, back) for ahead, back in matches):
            if first > at:
                return at <= most
            at = max(at, last + 1)
        return at <= most

    def close(self, at_end: bool = False) -> None:
        """The end of a class."""
        if at_end:
            self.border = self.by_neighbours = True
            self.drain()
        if self.by_neighbours:
            self.next(None)
            if (self.open or self.border) and self.text is not None:
                self.seeds.append(self.text[: self.seed])
        else:
            self.settle()
        self.members, self.border, self.by_neighbours, self.open = [], False, False, False

    def settle(self) -> None:
        for i, (_, owners, shared, own) in enumerate(self.members):
            if own[3]:
                self.put(owners, own[0], own[1], own[1])
            for _, others, lcp, other in reversed(self.members[:i]):
                if not (own[3] and other[3]):
                    ahead, back = self.agree(own, other, shared)
                    if self.length - ahead <= back:
                        for copied, anchors, most in ((own[3], owners, own[1]), (other[3], others, other[1])):
                            if not copied:
                                self.put(anchors, ahead, back, most)
                shared = min(shared, lcp)


def tail(at: int, ahead: int) -> bytes:
    return _TAIL.pack(at, ahead)


def home(owner: bytes, parts: int) -> int:
    return int.from_bytes(owner[:4], "little") % parts


def sorted_matches(source: DataFrame, entries, kind: int, length: int, total: int) -> DataFrame:
    """For every entry how far it agrees with others, from the order of all strings: a stored table.

    ``entries(rows, data, offsets)`` yields (text number, position, bytes ahead, string), ``total`` is their number. A task
    sorts its entries into runs, cuts them at the splitters and sends the pieces front-coded. Of equal strings of a run one
    is sent, since all are known to be repeated; so no string has more owners than there are runs. Splitters
    are strings of a sample of about ``SAMPLES`` for each partition, so a class of suffixes with a long common prefix is
    cut as well; the neighbours across a cut are compared in the end. Rows are packs of records for the partition of their
    texts (``dest``), and seeds that stay open.
    """
    seed = seed_length(length)
    parts = max(partitions(source.sparkSession), total * 2 * length // PART_BYTES)
    # Of a large input every 16th text shows a sample.
    large = total > 64 * SAMPLES * parts
    some = source.filter("pmod(xxhash64(key), 16) = 0") if large else source
    every = max(1, total // (SAMPLES * parts) // (16 if large else 1))

    def sample(batches):
        for part, data, offsets in blocks(batches):
            found = [s for _, _, _, s in entries(part, data, offsets) if every == 1 or hash_of(s) % every == 0]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["string"])

    drawn = sorted(r[0] for r in some.mapInArrow(sample, "string binary").distinct().limit(4 * SAMPLES * parts).collect())
    splitters = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if drawn else []

    def run(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        held.sort()
        known = _Matches(kind, length, parts)
        pieces: dict[int, tuple[list[bytes], list[bytes]]] = {}
        last, owners = None, []
        for text, owner in held:
            if text != last:
                strings, owners = pieces.setdefault(bisect.bisect_right(splitters, text), ([], []))
                strings.append(text)
                owners.append(owner)
                last = text
                continue
            first, ahead = owners[-1], int.from_bytes(owner[20:22], "little")
            back = 0 if kind == WHOLE else len(text) - ahead - 1
            if int.from_bytes(first[20:22], "little") < _COPIED:
                known.put(first, ahead, back, back)
                owners[-1] = first[:20] + struct.pack("<H", ahead + _COPIED)
            known.put(owner, ahead, back, back)
        rows = [(part, Run.encode(*piece), None, None) for part, piece in pieces.items()]
        rows += [(dest, None, dest, b"".join(records)) for dest, records in known.records.items()]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "run", "dest", "records"])

    def sort(batches):
        held, size = [], 0
        for part, data, offsets in blocks(batches):
            keys = part.column(0).to_pylist()
            for number, at, ahead, text in entries(part, data, offsets):
                held.append((text, keys[number] + tail(at, ahead)))
                size += len(text)
                if size > RUN_BYTES:
                    yield run(held)
                    held, size = [], 0
        if held:
            yield run(held)

    def merge(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        found, first, last = _Matches(kind, length, parts), None, None
        for last in _distinct([Run(r) for r in table.column("run").to_pylist() if r is not None]):
            found.add(*last)
            first = first or last
        found.close(at_end=True)
        rows = [(number, dest, records, None, None, None, None, None) for dest, records in zip(*(table.column(c).to_pylist() for c in ("dest", "records"))) if records]
        rows += [(number, dest, b"".join(records), None, None, None, None, None) for dest, records in found.records.items()]
        rows += [(number, None, None, s, None, None, None, None) for s in found.seeds if kind == AHEAD]
        if first and kind != WHOLE:
            rows.append((number, None, None, None, *first[:2], *last[:2]))
        kinds = [pa.int64()] * 2 + [pa.binary()] * 6
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, list(zip(*rows)) or [()] * 8, kinds)})

    schema = "part long, dest long, records binary, seed binary, low binary, low_owners binary, high binary, high_owners binary"
    names = [c.split()[0] for c in schema.split(", ")]
    runs = source.mapInArrow(sort, "part long, run binary, dest long, records binary")
    out = store(runs.groupBy("part").applyInArrow(merge, schema), "suffixes")
    if kind == WHOLE:
        return out.select("dest", "records", "seed")

    # One row for each partition: its first and last string, compared with the neighbours'.
    order = W.orderBy("part")
    beside = [F.lead(c).over(order).alias(f"next_{c}") for c in ("low", "low_owners")] + [F.lag(c).over(order).alias(f"back_{c}") for c in ("high", "high_owners")]
    edges = out.filter("low is not null").select("part", "low", "low_owners", "high", "high_owners", *beside)

    def across(batches):
        for batch in batches:
            found = _Matches(kind, length, parts)
            for _, low, low_owners, high, high_owners, after, after_owners, before, before_owners in zip(*(c.to_pylist() for c in batch.columns)):
                for text, owners, other, others in ((high, high_owners, after, after_owners), (low, low_owners, before, before_owners)):
                    if other is not None and (lcp := common(text, other, 0)) >= seed:
                        own = found.sides(text, owners)
                        found.put(owners, *found.agree(own, found.sides(other, others), lcp), own[1])
            rows = [(dest, b"".join(records)) for dest, records in found.records.items()]
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["dest", "records"])

    more = edges.mapInArrow(across, "dest long, records binary").select("dest", "records", F.lit(None).cast("binary").alias("seed"))
    return out.select("dest", "records", "seed").unionAll(more)


def by_text(matches: DataFrame, name: str) -> DataFrame:
    """key and the packed records of its anchors (``_FOUND``), stored."""

    def unpack(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("records").to_pylist()), _RECORD)
        keys = np.frombuffer(np.ascontiguousarray(rows["key"]).tobytes(), ">u8").reshape(-1, 2)
        order = np.lexsort((rows["at"], keys[:, 1], keys[:, 0]))
        keys, rows = keys[order], rows[order]
        new = np.append(True, (keys[1:] != keys[:-1]).any(1))[: len(keys)]
        edges = np.append(np.flatnonzero(new), len(keys))
        packed = np.empty(len(rows), _FOUND)
        for field in _FOUND.names:
            packed[field] = rows[field]
        return pa.table({
            "key": pa.array([rows["key"][low].tobytes() for low in edges[:-1]], pa.binary()),
            name: pa.array([packed[low:high].tobytes() for low, high in zip(edges[:-1], edges[1:])], pa.binary()),
        })

    packs = matches.filter("records is not null").select("dest", "records")
    return store(packs.groupBy("dest").applyInArrow(unpack, f"key binary, {name} binary"), name)


def hash_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=6).digest(), "little")


# --- Repeated strings ---------------------------------------------------------------


def _mixed(raw: np.ndarray) -> np.ndarray:
    raw = (raw ^ (raw >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.maximum((raw ^ (raw >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25), 1)


_BASE = 0xC6A4A7935BD1E995


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    sums, powers = rolling(_byte_values(0, False)[data], _BASE)
    return _mixed((sums[seed:] - sums[:-seed]) * powers.down[: len(data) - seed + 1])


def _hashes_at(data: np.ndarray, places_: np.ndarray, seed: int) -> np.ndarray:
    """The same for single places."""
    _, powers = rolling(np.zeros(seed, np.uint64), _BASE)
    values = _byte_values(0, False)[data[places_[:, None] + np.arange(seed)]]
    return _mixed((values * powers.up[:seed]).sum(1, dtype=np.uint64))


def _seeds(length: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """Anchors: in every string of ``length`` bytes the place of its least seed hash, the same in equal strings.

    A position is packed with the least and the greatest distance from the start of a string that has its least hash
    there (``_unpacked``). So every string belongs to one anchor, but for equal hashes in it.
    """
    seed, n = seed_length(length), len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64)
    value = _seed_hashes(data, seed)
    edges = np.zeros(n + 1, np.int32)
    full = np.diff(offsets) >= length
    np.add.at(edges, offsets[:-1][full], 1)
    np.add.at(edges, offsets[1:][full] - length + 1, -1)
    alive = np.cumsum(edges)[: n - length + 1] > 0
    span = length - seed + 1
    least = np.where(alive, slide(value, span, np.minimum), np.uint64(0))
    at = np.flatnonzero(chosen_minima(value, least, span))
    text = np.searchsorted(offsets, at, "right") - 1
    value = value[at]

    def smaller(step: int) -> np.ndarray:
        """Distance to the next anchor with a smaller hash, ``span`` at most. Those between the two have none to look at."""
        out, left, hop = np.full(len(at), span), np.arange(len(at)), step
        while len(left):
            left = left[(left + hop >= 0) & (left + hop < len(at))]
            far = np.abs(at[left + hop] - at[left])
            near = (far < span) & (text[left + hop] == text[left])
            left, far = left[near], far[near]
            less = value[left + hop] < value[left]
            out[left[less]] = far[less]
            left, hop = left[~less], hop + step
        return out

    inside = at - offsets[text]
    most = np.minimum(smaller(-1) - 1, inside)
    low = np.maximum(span - smaller(1), np.maximum(0, length - (offsets[1:][text] - at)))
    return text, inside | low << 32 | most << 48, value


def _unpacked(places_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places_ & 0xFFFFFFFF, (places_ >> 32) & 0xFFFF, places_ >> 48


def _starts_inside(places_: np.ndarray, distance: np.ndarray) -> np.ndarray:
    _, low, most = _unpacked(places_)
    return (low <= distance) & (distance <= most)


def _entries(kind: int, length: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """The bytes ahead of each anchor as far as its strings go, and those before it backwards: one way first, then the other."""
    seed = seed_length(length)
    for number, packed in enumerate(positions(part.column(2), "<i8")):
        raw = data[offsets[number] : offsets[number + 1]].tobytes()
        if kind == WHOLE:  # a string may have been found from two anchors with equal hashes
            for at in np.unique(_unpacked(packed)[0]).tolist():
                yield number, at, length, raw[at : at + length]
            continue
        for at, low, most in zip(*(x.tolist() for x in _unpacked(packed))):
            ahead, before = raw[at : at + length - low], raw[at - most : at][::-1]
            text = ahead + _STOP + before if kind == AHEAD else ahead[:seed] + before + _STOP + ahead[seed:]
            yield number, at, len(ahead), text


def _records(columns, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All records of a block of texts, and where their texts begin."""
    rows, begin = [], []
    for column in columns:
        for packed, offset in zip(column.to_pylist(), offsets.tolist()):
            if packed:
                rows.append(packed)
                begin.append(np.full(len(packed) // _FOUND.itemsize, offset))
    none = np.zeros(0, np.int64)
    return np.frombuffer(b"".join(rows), _FOUND), np.concatenate(begin) if begin else none


def _repeated_starts(length: int, rows: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Where the strings start that one partner of some anchor shows to be repeated."""
    first, last = length - rows["ahead"].astype(np.int64), rows["back"].astype(np.int64)
    sure = first <= last
    at = begin[sure] + rows["at"][sure]
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, at - last[sure], 1)
    np.add.at(marks, at - first[sure] + 1, -1)
    return np.cumsum(marks)[:size] > 0


def _gaps(length: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """(anchor in the block, distance) of strings that may be repeated, though no single partner of their anchor shows it.

    Their longest match ahead and their longest match back may lie with different partners.
    """
    ahead, begin = _records([part.column(2)], offsets)
    back, begin_back = _records([part.column(3)], offsets)
    sure = _repeated_starts(length, np.concatenate([ahead, back]), np.concatenate([begin, begin_back]), len(data))
    furthest: dict[int, int] = {}
    for at, much in zip((begin + ahead["at"]).tolist(), ahead["ahead"].tolist()):
        furthest[at] = max(furthest.get(at, 0), much)
    reach: dict[int, int] = {}
    for at, much in zip((begin_back + back["at"]).tolist(), back["back"].tolist()):
        reach[at] = max(reach.get(at, 0), much)
    for at, last in reach.items():
        for distance in range(length - furthest.get(at, 0), last + 1):
            if not sure[at - distance]:
                yield at, distance


def repeated_strings(texts: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """texts with the columns of records from which ``_repeated_starts`` marks every repeated string of ``length`` bytes.

    All anchors whose seed occurs again are sorted by what is ahead of them. Where a string of a large class stays open, the anchors
    of that seed are sorted by what is before them; the few strings that are still open then are sorted whole.
    """
    seed = seed_length(length)
    windows = packed_windows(texts.select("key", "text"), functools.partial(_seeds, length), groups, place="<i8")
    anchors = store(places(windows, repeated_hashes(windows), place="<i8"), "anchors")

    def matches(anchors: DataFrame, kind: int) -> DataFrame:
        total = (anchors.agg(F.sum(F.length("at"))).first()[0] or 0) // 8
        marked = texts.join(anchors, "key").select("key", "text", "at")
        return sorted_matches(marked, functools.partial(_entries, kind, length), kind, length, total)

    ahead = matches(anchors, AHEAD)
    found = by_text(ahead, "ahead")

    def hashed(batches):
        for batch in batches:
            seeds = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)
            value = _hashes_at(seeds, np.arange(batch.num_rows) * seed, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.zeros(len(value), np.int32))], names=["seed", "shift"])

    out = texts.join(found, "key", "left")
    open_seeds = store(ahead.filter("seed is not null").select("seed").mapInArrow(hashed, "seed long, shift int").distinct(), "seeds")
    if open_seeds.isEmpty():
        return out.select("key", "text", "copies", "ahead")
    again = by_bucket(open_seeds, groups).select("bucket", "again")
    back = by_text(matches(store(places(windows, again, place="<i8"), "anchors"), BACK), "back")
    out = out.join(back, "key", "left")

    def open_(batches):
        for part, data, offsets in blocks(batches):
            rows = np.array(list(_gaps(length, part, data, offsets)), np.int64).reshape(-1, 2)
            value = _hashes_at(data, rows[:, 0], seed).view(np.int64) if len(rows) else rows[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(rows[:, 1].astype(np.int32))], names=["seed", "shift"])

    both = texts.join(found, "key").join(back, "key").select("key", "text", "ahead", "back")
    gaps = store(both.mapInArrow(open_, "seed long, shift int").distinct(), "gaps")
    if gaps.isEmpty():
        return out.select("key", "text", "copies", "ahead", "back")
    strings = store(places(windows, by_bucket(gaps, groups), place="<i8", fits=_starts_inside), "anchors")
    whole = by_text(matches(strings, WHOLE), "whole")
    return out.join(whole, "key", "left").select("key", "text", "copies", "ahead", "back", "whole")


def without_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers, judged on the input.

    Suffixes are sorted sparsely: at anchors, one at least in every string of ``length`` bytes and at the same place in
    equal strings, and only at those whose seed occurs again. Copies of a whole text are one text with a count; if
    it is long enough, all of it goes. Matches never cross documents.

    Null text is empty. Repeated rows are copies. An empty table gives no rows; other columns are ignored.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    """
    if not 0 < length < _COPIED:
        raise ValueError(f"length must be below {_COPIED}")
    texts, groups = distinct_texts(docs)
    source = repeated_strings(texts, groups, length)

    def clean(batches):
        for part, data, offsets in blocks(batches):
            n = len(data)
            starts = _repeated_starts(length, *_records(part.columns[3:], offsets), n)
            sums = np.concatenate([np.zeros(length, np.int64), np.cumsum(starts)])
            gone = sums[length:] > sums[:n]
            sizes = np.diff(offsets)
            whole = (part.column(2).to_numpy() > 1) & (sizes >= length)
            gone |= np.repeat(whole, sizes)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = offsets[:-1][sizes > 0]
            begins[edges] = gone[edges]
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, begins))
            kept = data[~gone].tobytes()
            ends = np.cumsum(sizes - removed).tolist()
            digests = [hashlib.sha256(kept[low:high]).hexdigest() for low, high in zip([0, *ends[:-1]], ends)]
            columns = [part.column(0), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cleaned = source.mapInArrow(clean, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return docs.select("doc_id", text_key().alias("key")).join(cleaned, "key").drop("key")
