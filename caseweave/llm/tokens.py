"""Token ids in length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.shared import open_folder, partitions, shared_path, store
from caseweave.llm.words import blocks

END_ID = 0
CACHE_WORDS = 1_000_000
JOINED = 1024
_HEAD = struct.Struct("<qBBH")  # doc_id, 1 if it is null, bytes of an id, reserved
_CHUNK = 64
_MASK = 0xA282EAD8  # fixed value of the record format


# --- CRC-32C of many byte runs at once ------------------------------------------


@lru_cache(maxsize=1)
def _crc_tables() -> np.ndarray:
    """Row d: CRC of each byte value followed by d zero bytes, from a zero start."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    rows = [table]
    for _ in range(_CHUNK - 1):
        rows.append(table[rows[-1] & 0xFF] ^ (rows[-1] >> np.uint32(8)))
    return np.array(rows)


def _shifted(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Apply a linear map of 32 bits, given by the images of single bits."""
    out = np.zeros_like(crc)
    for byte in range(4):
        table = np.zeros(1, np.uint32)
        for bit in range(8):
            table = np.concatenate([table, table ^ columns[8 * byte + bit]])
        out ^= table[(crc >> np.uint32(8 * byte)) & np.uint32(0xFF)]
    return out


def masked_crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of runs of at least four bytes."""
    tables = _crc_tables()
    pieces = -(-lengths // _CHUNK)
    grid = np.zeros(int(pieces.sum()) * _CHUNK, np.uint8)
    ends = np.cumsum(pieces) * _CHUNK
    # Runs end at the end of their last piece; zeros in front do not count.
    shift = np.repeat(ends - lengths - starts, lengths)
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    grid[at + shift] = data[at]
    first = ends - lengths
    for i in range(4):
        grid[first + i] ^= 0xFF
    grid = grid.reshape(-1, _CHUNK)
    crc = np.zeros(len(grid), np.uint32)
    for i in range(_CHUNK):
        crc ^= tables[_CHUNK - 1 - i][grid[:, i]]
    columns = np.array([1 << i for i in range(32)], np.uint32)
    one = tables[0]
    for _ in range(_CHUNK):
        columns = one[columns & 0xFF] ^ (columns >> np.uint32(8))
    while len(pieces) and pieces.max() > 1:
        odd = pieces % 2
        crc = np.insert(crc, (np.cumsum(pieces) - pieces)[odd == 1], 0)
        pieces = (pieces + odd) // 2
        crc = _shifted(crc[0::2], columns) ^ crc[1::2]
        columns = _shifted(columns, columns)
    crc = ~crc
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


# --- Encoding ---------------------------------------------------------------------

_PLAIN = np.zeros(256, bool)  # starts a character that is no white space
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.!?;:")] = True
_WORDLIKE = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _WORDLIKE[_low:_high] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the byte-level pre-tokenizer always starts a new piece.

    These are: starts of texts; a space before a plain character; a line feed before one, and
    the place after it; a stop character after a letter or digit.
    """
    plain_next = np.zeros(len(data), bool)
    plain_next[:-1] = _PLAIN[data[1:]]
    filled = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    plain_next[last] = False
    feed = (data == 0x0A) & plain_next
    cut = ((data == 0x20) & plain_next) | feed
    cut[1:] |= feed[:-1]
    letter = _WORDLIKE[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] |= _STOP[data[1:]] & (letter | latin)[:-1]
    cut[filled] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes whole texts; a piece of text seen before in this worker is looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [str(token.content).encode() for token in added]
        self.cuttable = self.tokenizer.normalizer is None and "ByteLevel" in repr(self.tokenizer.pre_tokenizer)
        self.joinable = not any(b" " in s for s in self.special)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        # A byte-level token has one character for each of its bytes.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and how many each has."""
        found = self._batch([p.decode() for p in pieces])
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found])

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that start with a space and a plain character, encoded as one text: each of them starts anew in it."""
        ids = np.array(self._batch([b"".join(pieces).decode()])[0], np.uint32)
        at = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum([len(p) for p in pieces])
        last = np.minimum(np.searchsorted(at, ends), len(at) - 1)
        if at[-1] != ends[-1] or (at[last] != ends).any():
            return self._each(pieces)
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, pieces: list[bytes]) -> None:
        spaced, others = [], []
        for p in pieces:
            (spaced if self.joinable and p[0] == 0x20 and len(p) > 1 and _PLAIN[p[1]] else others).append(p)
        parts = [(self._joined, spaced[low : low + JOINED]) for low in range(0, len(spaced), JOINED)]
        parts += [(self._each, others[low : low + JOINED]) for low in range(0, len(others), JOINED)]
        for split, part in parts:
            flat, lengths = split(part)
            n, m = len(self.known), len(part)
            while n + m > len(self.start):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.length[n : n + m] = lengths
            self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.known.update(zip(part, range(n, n + m)))

    def _numbers(self, pieces: np.ndarray) -> np.ndarray:
        """Number of each known piece, -1 for others."""
        return np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and where each text's ids end."""
        raw = data.tobytes()
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if not self.cuttable or any(s in raw for s in self.special):
            found = self._batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found])
        at = cuts(data, offsets)
        bounds = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) + len(pieces) > CACHE_WORDS:
            self._clear()
        number = self._numbers(pieces)
        new = np.flatnonzero(number < 0)
        self._learn(pieces[new].tolist())
        number[new] = self._numbers(pieces[new])
        number = number[coded.indices.to_numpy()]
        length = self.length[number]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.start[number] - (ends - length), length) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(at, offsets[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- Files ------------------------------------------------------------------------


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Records: length (8 bytes), its masked CRC, payload, its masked CRC; and their byte lengths."""
    if not payloads:
        return b"", np.zeros(0, np.int64)
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = np.frombuffer(lengths.astype("<u8").tobytes(), np.uint8)
    head_crc = masked_crc32c(heads, np.arange(len(lengths)) * 8, np.full(len(lengths), 8))
    body = np.frombuffer(b"".join(payloads), np.uint8)
    body_crc = masked_crc32c(body, np.cumsum(lengths) - lengths, lengths)
    out = b"".join(
        b"".join((struct.pack("<QI", len(p), h), p, struct.pack("<I", c)))
        for p, h, c in zip(payloads, head_crc.tolist(), body_crc.tolist())
    )
    return out, lengths + 16


def unframe(raw: bytes) -> tuple[list[bytes], int]:
    """Whole records at the start of ``raw``, checked, and the number of bytes they take."""
    at, payloads, crcs = 0, [], []
    while at + 12 <= len(raw):
        length, head = struct.unpack_from("<QI", raw, at)
        if at + 16 + length > len(raw):
            break
        payloads.append(raw[at + 12 : at + 12 + length])
        crcs.append((head, struct.unpack_from("<I", raw, at + 12 + length)[0]))
        at += 16 + length
    if payloads:
        lengths = np.array([len(p) for p in payloads], np.int64)
        heads = np.frombuffer(lengths.astype("<u8").tobytes(), np.uint8)
        body = np.frombuffer(b"".join(payloads), np.uint8)
        found = zip(
            masked_crc32c(heads, np.arange(len(lengths)) * 8, np.full(len(lengths), 8)).tolist(),
            masked_crc32c(body, np.cumsum(lengths) - lengths, lengths).tolist(),
        )
        if list(found) != crcs:
            raise ValueError("a record's checksum does not match")
    return payloads, at


def read_record(uri: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: document and ids. For shuffled reads."""
    system, path = open_folder(uri)
    with system.open_input_file(path) as file:
        file.seek(offset)
        payloads, _ = unframe(file.read(length))
    return _parse(payloads[0])


def _header(doc_id: int | None, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width, 0)


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, missing, width, _ = _HEAD.unpack_from(payload)
    return None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write their ids in ascending doc_id order (null first, then by text).

    Each range of ids becomes one file of records and one index beside it (``.idx``: doc_id, offset and
    length as signed 64-bit integers; a null id is written as the least integer). Files have names of
    their own for every attempt, and only those of attempts that succeeded are in the manifest, which is returned:
    shard, path, records, bytes. Ids take two bytes where the vocabulary allows it. Null text is empty;
    an empty table gives an empty manifest; other columns are ignored; repeated rows are records of their own.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        coder, shard = encoder(tokenizer), TaskContext.get().partitionId()
        system, path = open_folder(folder)
        name = f"ids-{shard:05d}-{uuid.uuid4().hex}"
        records = written = 0
        kind = f"<u{coder.width}"
        with system.open_output_stream(f"{path}/{name}.rec") as out, system.open_output_stream(f"{path}/{name}.idx") as index:
            for part, data, offsets in blocks(batches):
                ids, ends = coder.encode(data, offsets)
                ids = ids.astype(kind)
                closing = np.array([end_id], kind).tobytes()
                doc_ids, payloads, low = part.column(0).to_pylist(), [], 0
                for doc_id, high in zip(doc_ids, ends.tolist()):
                    head = _header(doc_id, coder.width)
                    payloads.append(head + ids[low:high].tobytes() + closing)
                    low = high
                framed, lengths = frame(payloads)
                out.write(framed)
                entries = np.empty((len(lengths), 3), "<i8")
                entries[:, 0] = [-(2**63) if d is None else d for d in doc_ids]
                entries[:, 1] = written + np.cumsum(lengths) - lengths
                entries[:, 2] = lengths
                index.write(entries.tobytes())
                records, written = records + len(lengths), written + len(framed)
        if records:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "records": [records], "bytes": [written]})

    return store(rows.mapInArrow(write, "shard long, path string, records long, bytes long"), "manifest")


def read_tokens(manifest: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """Read record files from start to end, checksums verified: shard, record, doc_id, n_tokens, ids_crc32, before.

    ``before`` counts the ids of all earlier records of the shard.
    """

    def read(frames):
        for frame_ in frames:
            for shard, uri in zip(frame_["shard"], frame_["path"]):
                system, path = open_folder(f"{uri}.rec")
                record, before, rest = 0, 0, b""
                with system.open_input_stream(path) as file:
                    while more := file.read(max(chunk, len(rest))):
                        payloads, used = unframe(rest + more)
                        rest = (rest + more)[used:]
                        out = []
                        for payload in payloads:
                            doc_id, ids = _parse(payload)
                            out.append((shard, record, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                            record, before = record + 1, before + len(ids)
                        columns = ["shard", "record", "doc_id", "n_tokens", "ids_crc32", "before"]
                        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
                if rest:
                    raise ValueError(f"{path} ends within a record")

    spark = manifest.sparkSession
    schema = "shard long, record long, doc_id long, n_tokens long, ids_crc32 long, before long"
    return manifest.select("shard", "path").repartition(partitions(spark), "shard").mapInPandas(read, schema)


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents, read the files back and place every document in the whole stream.

    Returns doc_id, start, n_tokens, ids_crc32; ``start`` counts the ids of all documents before it.
    """
    # Shards are ranges in order, so that only their totals, a row each, are still to be added up.
    read = store(read_tokens(write_tokens(docs, tokenizer, folder)), "records")
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    shift = totals.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("shift"))
    placed = read.join(F.broadcast(shift), "shard")
    return placed.select("doc_id", (F.col("before") + F.col("shift")).cast("long").alias("start"), "n_tokens", "ids_crc32")
