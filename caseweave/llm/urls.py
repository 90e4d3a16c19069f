"""URL filters: rules on hosts and paths, looked up in memory-mapped sorted arrays of 64-bit digests."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.shared import open_folder, shared_path, store

# Stored bytes of one file of the array, and of all files where each executor needs a copy of its own.
SHARD_BYTES = 256 << 20
COPY_BYTES = 8 << 30
SEED = 42  # of Spark's xxhash64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HOST, _RULE = b"H", b"R"


def url_host(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def url_path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(F.col(url), at + F.lit(3))).otherwise(F.lit(""))


class DigestArray:
    """Read-only map from byte strings to byte strings: files of sorted 64-bit keys, each with the strings behind them.

    A file holds the number of entries, the keys, the ends of the entries and the entries (string, NUL, value). Files
    follow each other by key and are memory-mapped, so that a lookup touches a few pages of them and the processes of a
    machine share those. Equal keys of different strings are told apart by the stored strings.
    """

    def __init__(self, paths: Iterable[str]):
        self.parts = []
        for path in paths:
            size = int(np.fromfile(path, np.int64, 1)[0])
            keys = np.memmap(path, np.int64, "r", 8, size)
            ends = np.memmap(path, np.int64, "r", 8 + 8 * size, size)
            data = np.memmap(path, np.uint8, "r", 8 + 16 * size)
            self.parts.append((keys, ends, data))
        self.firsts = np.array([int(keys[0]) for keys, _, _ in self.parts], np.int64)

    def find(self, strings: list[bytes]) -> list[bytes | None]:
        """The value of each string, None if it isn't in the map."""
        found: list[bytes | None] = [None] * len(strings)
        if not strings or not self.parts:
            return found
        wanted = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64).view(np.int64)
        order = np.argsort(wanted, kind="stable")
        part_of = np.searchsorted(self.firsts, wanted[order], "right") - 1
        for number in np.unique(part_of[part_of >= 0]).tolist():
            keys, ends, data = self.parts[number]
            own = order[part_of == number]
            low, high = np.searchsorted(keys, wanted[own], "left"), np.searchsorted(keys, wanted[own], "right")
            for i, first, last in zip(own[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                prefix = strings[i] + b"\0"
                for entry in range(first, last):
                    stored = data[int(ends[entry - 1]) if entry else 0 : int(ends[entry])].tobytes()
                    if stored.startswith(prefix):
                        found[i] = stored[len(prefix) :]
                        break
        return found


@lru_cache(maxsize=2)
def _opened(paths: tuple[str, ...], copied: bool) -> DigestArray:
    return DigestArray(SparkFiles.get(os.path.basename(path)) if copied else path for path in paths)


def store_rules(rules: DataFrame) -> tuple[tuple[str, ...], bool, int]:
    """Write the rules as files of a ``DigestArray`` into the shared folder: their paths, whether executors need copies, longest host.

    ``rules`` has host, path and verdict. Two kinds of strings are stored: every rule with its verdict, and every host
    with the lengths its paths have, so that only lengths that occur are tried. Rows are sorted by key on Spark
    and each range is written by one task; only the names of the files (one for 256 MB) come to the driver. A file
    system that can be mapped is read in place. From any other one every executor gets a copy, of ``COPY_BYTES`` at most.
    """
    spark = rules.sparkSession
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    rules = rules.filter("verdict is not null").select(F.encode(host, "UTF-8").alias("host"), F.encode(path, "UTF-8").alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    nul = F.lit(b"\0")
    single = rules.select(F.concat(F.lit(_RULE), "host", nul, "path").alias("name"), F.encode("verdict", "UTF-8").alias("value"))
    lengths = F.array_join(F.sort_array(F.collect_set(F.length("path"))).cast("array<string>"), ",")
    hosts = rules.groupBy("host").agg(F.encode(lengths, "UTF-8").alias("value"))
    hosts = hosts.select(F.concat(F.lit(_HOST), "host").alias("name"), "value")
    entries = single.unionByName(hosts).select(F.xxhash64("name").alias("digest"), F.concat("name", nul, "value").alias("entry"))
    entries = store(entries, "rules")
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    size = entries.agg(F.sum(F.length("entry") + 16)).first()[0] or 0
    folder = shared_path(spark, "digests")

    def write(batches):
        keys, ends, parts, total = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = batch.column(1).cast(pa.large_binary())
            edges = np.frombuffer(entry.buffers()[1], np.int64)[entry.offset : entry.offset + len(entry) + 1]
            keys.append(batch.column(0).to_numpy())
            ends.append(edges[1:] - edges[0] + total)
            parts.append(np.frombuffer(entry.buffers()[2], np.uint8)[edges[0] : edges[-1]])
            total += int(edges[-1] - edges[0])
        if not keys:
            return
        system, base = open_folder(folder)
        name = f"{uuid.uuid4().hex}.digests"  # a repeated task writes a file of its own
        system.create_dir(base, recursive=True)
        keys = np.concatenate(keys)
        with system.open_output_stream(f"{base}/{name}") as out:
            for array in (np.array([len(keys)], np.int64), keys, np.concatenate(ends), *parts):
                out.write(np.ascontiguousarray(array))
        yield pa.RecordBatch.from_pydict({"first": [int(keys[0])], "name": [name]})

    ranged = entries.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "digest").sortWithinPartitions("digest")
    files = store(ranged.mapInArrow(write, "first long, name string"), "files").orderBy("first").collect()
    system, base = open_folder(folder)
    if isinstance(system, pafs.LocalFileSystem):
        return tuple(f"{base}/{file.name}" for file in files), False, longest
    if size > COPY_BYTES:
        raise ValueError(f"{size} bytes of rules need a shared folder that is mounted on all executors")
    for file in files:
        spark.sparkContext.addFile(f"{folder}/{file.name}")
    return tuple(f"{folder}/{file.name}" for file in files), True, longest


def _suffixes(host: bytes, longest: int) -> list[bytes]:
    """The host and its parent domains, of the length of the longest listed one at most."""
    out = [host] if len(host) <= longest else []
    at = host.find(b".", max(len(host) - longest - 1, 0))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(b".", at + 1)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Which rule decides on each url, and its verdict; ``default`` where none fits: no row is shuffled.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path starts with the rule's.
    Of several the longest (host and path in characters) decides, then the one with the longer host. Null host or path
    of a rule count as empty, rules without a verdict are left out; of equal rules with two verdicts the greater one
    counts ("block" before "allow").

    For every host its parent domains are looked up, then for those listed the prefixes of the path that have a length
    listed there. Lookups go by batches through ``DigestArray``. Memory: one batch and the pages of the files in use.

    ``pages`` has page_id and url, other columns are ignored. A url that is null or has no ``://`` has empty host and
    path. Repeated rows give repeated rows, empty tables none. Returns page_id, host, path, rule (null if none), verdict.
    """
    paths, copied, longest = store_rules(rules)
    parsed = pages.select("page_id", url_host().alias("host"), url_path().alias("path"))

    def judge(batches):
        listed = _opened(paths, copied)
        for batch in batches:
            hosts = [(host or "").encode() for host in batch.column(1).to_pylist()]
            tails = [(path or "").encode() for path in batch.column(2).to_pylist()]
            above = {host: _suffixes(host, longest) for host in set(hosts)}
            names = list({name for group in above.values() for name in group})
            lengths = {n: [int(x) for x in v.split(b",")] for n, v in zip(names, listed.find([_HOST + n for n in names])) if v is not None}
            owner, tried, shown = [], [], []
            for i, (host, tail) in enumerate(zip(hosts, tails)):
                for name in above[host]:
                    for length in lengths.get(name, ()):
                        if length <= len(tail):
                            owner.append(i)
                            tried.append(_RULE + name + b"\0" + tail[:length])
                            shown.append((name, tail[:length]))
            best: dict[int, tuple] = {}
            for i, (name, start), verdict in zip(owner, shown, listed.find(tried)):
                if verdict is not None:
                    text = (name + start).decode()
                    best[i] = max(best.get(i, (-1,)), (len(text), len(name), text, verdict.decode()))
            rule = [best[i][2] if i in best else None for i in range(batch.num_rows)]
            verdict = [best[i][3] if i in best else default for i in range(batch.num_rows)]
            columns = [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parsed.mapInArrow(judge, schema)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
