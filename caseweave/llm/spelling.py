"""Spelling variants: words one edit apart, found by search schemes on FM-indexes of both reading directions."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import partitions, store

_RUN = re.compile("[a-zÀ-ÿ]+")
# Entries of one index: text of about ten code points each, some 50 MB with its arrays.
WORDS_PER_INDEX = 40_000
# Words of one task that are counted before they are sent on.
COUNTED_AT_ONCE = 500_000
# Branches of one block of queries.
BRANCHES = 500_000


def observed_words(docs: DataFrame, least_length: int = 6, drop_every: int = 199) -> DataFrame:
    """(word, n): maximal runs of ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, as the documents hold them.

    If ``drop_every`` divides the CRC-32 of ``<doc_id>:<run>``, its code point at CRC modulo length is deleted first.
    Shorter results than ``least_length`` are left out. Null text has no words, a null id counts as empty. Tasks add up
    what they see, so a frequent word is moved once for each task.
    """

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower() folds A-Z alone.
                for run, times in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if len(run) < least_length:
                        continue
                    code = zlib.crc32(run.encode(), begin)
                    if code % drop_every == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    seen[run] += times
                if len(seen) > COUNTED_AT_ONCE:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


class FmIndex:
    """Suffix-rank intervals over a delimited vocabulary, extended by one symbol for many patterns at once.

    The words stand reversed in the text, each behind its delimiter, so an interval grows by reading a word from its
    beginning; given reversed words, from its end. Two such indexes are a bidirectional one for searches
    that start at either end. Delimiters are ordered by word. Occurrences of a symbol before a rank are counted by binary
    search among the ranks that hold it.
    """

    def __init__(self, words: list[np.ndarray]):
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.alphabet, coded = np.unique(flat, return_inverse=True)
        self.symbols = len(self.alphabet) + 1
        # word i: delimiter, then its symbols from the last to the first
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(starts[-1] + 1, np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[starts[owner] + lengths[owner] - within] = coded + 1
        # The text ends with one more delimiter; the suffix order of delimiters is that of their words.
        ends = starts
        order = self._sorted(text, ends)
        before = text[order - 1]  # of the first suffix: the last delimiter
        self.count = len(words)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.size = len(text)
        places = np.argsort(before, kind="stable")
        self.keys = before[places] * (self.size + 1) + places
        # Which word a suffix begins, for ranks that follow a delimiter.
        self.word = np.searchsorted(starts, order, "right") - 1

    @staticmethod
    def _sorted(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; delimiters are distinct, so suffixes are told apart within their words."""
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-step] = rank[step:] + 1
            order = np.lexsort((ahead, rank))
            new = np.ones(len(rank), bool)
            new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
            rank = np.empty(len(rank), np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                return order
            step *= 2

    def code(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word has."""
        if not len(self.alphabet):
            return np.full(len(flat), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at + 1, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` precedes a suffix among the first ``at``."""
        return np.searchsorted(self.keys, symbol * (self.size + 1) + at) - self.first[symbol]

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol; empty for symbols that no word has."""
        known = np.maximum(symbol, 1)
        new_low = self.first[known] + self.rank(known, low)
        new_high = self.first[known] + self.rank(known, high)
        return new_low, np.where(symbol > 0, new_high, new_low)

    def ended(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that ends where the interval has got to, -1 if none does. Words are distinct, so there is one at most."""
        delimiter = np.zeros(len(low), np.int64)
        first = self.rank(delimiter, low)
        there = self.rank(delimiter, high) > first
        ranks = self.keys[first[there]]  # the delimiter is symbol 0, so its keys are ranks
        out = np.full(len(low), -1, np.int64)
        out[there] = self.word[ranks]
        return out


def one_edit_apart(index: FmIndex, queries: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for words that begin with the first ``exact`` symbols of a query and differ from it by one edit behind them.

    The interval of the beginning is extended symbol by symbol. At every place the other symbols branch off (one
    instead of the query's, one in front of it) and one branch leaves the query's out; branches follow the rest of the query
    without another edit. Everything moves on by one symbol in every turn, so there are as many turns as the longest
    query has symbols; what has an empty interval is dropped.
    """
    lengths = np.array([len(q) for q in queries], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # One more place, so that the end of the last query can be read.
    coded = np.append(index.code(np.concatenate(queries)) if queries else np.zeros(0, np.int64), -1)
    size = len(queries)
    intact = np.arange(size), np.zeros(size, np.int64), np.full(size, index.count + 1, np.int64), np.zeros(size, np.int64)
    edited = tuple(np.zeros(0, np.int64) for _ in range(4))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def step(query, low, high, at):
        low, high = index.extend(low, high, coded[starts[query] + at])
        alive = high > low
        return query[alive], low[alive], high[alive], at[alive] + 1

    def branches(query, low, high, at):
        """One edit at the place reached, by blocks of queries."""
        inside = at < lengths[query]
        yield query[inside], low[inside], high[inside], at[inside] + 1
        block, symbols = max(1, BRANCHES // index.symbols), np.arange(1, index.symbols)
        for start in range(0, len(query), block):
            symbol = np.tile(symbols, len(query[start : start + block]))
            q, lo, hi, p = (np.repeat(x[start : start + block], len(symbols)) for x in (query, low, high, at))
            new_low, new_high = index.extend(lo, hi, symbol)
            inside = p < lengths[q]
            # A symbol equal to the query's is no edit; put in front of it, it gives the word of a later branch.
            other = (new_high > new_low) & ((coded[starts[q] + p] != symbol) | ~inside)
            yield q[other], new_low[other], new_high[other], p[other]
            other &= inside
            yield q[other], new_low[other], new_high[other], p[other] + 1

    while len(intact[0]) or len(edited[0]):
        ready = intact[3] >= exact[intact[0]]
        if ready.any():
            edited = tuple(np.concatenate(part) for part in zip(edited, *branches(*(x[ready] for x in intact))))
        ended = edited[3] == lengths[edited[0]]
        if ended.any():
            query, low, high, _ = (x[ended] for x in edited)
            word = index.ended(low, high)
            found.append((query[word >= 0], word[word >= 0]))
            edited = tuple(x[~ended] for x in edited)
        edited = step(*edited)
        going = intact[3] < lengths[intact[0]]
        intact = step(*(x[going] for x in intact))
    pairs = np.unique(np.stack([np.concatenate(part) for part in zip(*found)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)


def _searched(table: pa.Table) -> pa.Table:
    """One index and its queries: near words of each, counted, and the best of them."""
    rows = table.select(["side", "query", "word", "n"]).to_pydict()
    out = {"word": [], "n_near": [], "form_n": [], "form": []}
    for side in (0, 1):
        listed: dict[str, int] = {}
        asked: list[str] = []
        for s, query, word, n in zip(*rows.values()):
            if s == side and query:
                asked.append(word)
            elif s == side:
                listed[word] = n
        if not asked or not listed:
            continue
        turn = (lambda word: _points(word)) if side == 0 else (lambda word: _points(word)[::-1])
        words = list(listed)
        index = FmIndex([turn(word) for word in words])
        halves = np.array([len(w) // 2 if side == 0 else len(w) - len(w) // 2 for w in asked], np.int64)
        best: dict[int, list] = {}
        for q, w in zip(*(part.tolist() for part in one_edit_apart(index, [turn(word) for word in asked], halves))):
            own, near = asked[q], words[w]
            # What shares the first half is found by the index of beginnings.
            if side == 1 and near.startswith(own[: len(own) // 2]):
                continue
            state = best.setdefault(q, [0, 0, ""])
            state[0] += 1
            if (-listed[near], near) < (-state[1], state[2]):
                state[1:] = listed[near], near
        for q, (count, n, form) in best.items():
            for column, value in zip(out.values(), (asked[q], count, n, form)):
                column.append(value)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): number of words exactly one inserted, deleted or replaced code point away, and the most frequent.

    Of one edit, either the first half of a word or the second is free, so each word asks the index of
    words that begin with its first half and the one of words that end with its second. Halves are dealt by hash; a word
    is listed under the halves of every length that a neighbour of it can have, two on each side. A half that
    more than ``WORDS_PER_INDEX`` words share is cut into several indexes by word, each asked by all its queries.

    ``words`` is a stored table of distinct (word, n) with at least two code points. Words without a neighbour are left out.
    """
    spark = words.sparkSession
    length = F.length("word")

    def half(side: int, whole):
        return F.expr(f"substring(word, 1, {whole})") if side == 0 else F.expr(f"substring(word, -({whole}), {whole})")

    def placed(side: int, size, query: bool) -> DataFrame:
        return words.select(F.lit(side).alias("side"), F.lit(query).alias("query"), F.xxhash64(half(side, size)).alias("half"), "word", "n")

    # First halves have length div 2 code points, second ones the rest.
    sizes = [("greatest(length(word) - 1, 2) div 2", "(length(word) + 1) div 2"), ("length(word) div 2", "(length(word) + 2) div 2")]
    listed = [placed(side, size, False) for side in (0, 1) for size in sizes[side]]
    entries = listed[0]
    for more in listed[1:]:
        entries = entries.unionByName(more)
    entries = entries.distinct()
    asked = placed(0, "length(word) div 2", True).unionByName(placed(1, "(length(word) + 1) div 2", True))

    hot = entries.groupBy("side", "half").agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > WORDS_PER_INDEX)
    # One for each WORDS_PER_INDEX entries at most.
    hot = store(hot.select("side", "half", F.ceil(F.col("entries") / WORDS_PER_INDEX).alias("parts")), "halves")
    total = words.count()
    buckets = max(partitions(spark), -(-4 * total // WORDS_PER_INDEX))
    cut = F.coalesce("parts", F.lit(1))
    entries = entries.join(F.broadcast(hot), ["side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), cut))
    asked = asked.join(F.broadcast(hot), ["side", "half"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    rows = entries.unionByName(asked).withColumn("bucket", F.pmod(F.xxhash64("side", "half", "part"), F.lit(buckets)))
    found = rows.select("bucket", "side", "query", "word", "n").groupBy("bucket").applyInArrow(_searched, "word string, n_near long, form_n long, form string")
    # Largest n first, then the smallest word: min of (-n, word).
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """Words of the documents with the frequent word that each is a variant of.

    Words are those of ``observed_words`` with ``least_count`` occurrences. The form of a word is its most frequent near word
    (``near_words``; ties: smallest by code points) if that has at least ``ratio`` times its occurrences. Root is the end
    of the chain of forms. A form is ``ratio`` times as frequent as its word, so chains are as short as the logarithm of the
    largest count; they are halved by joins until none is left.

    ``docs`` has doc_id and text; other columns are ignored. Repeated rows count each. An empty table gives no rows.
    Returns word, form (null if none), root (the word itself if none), n, n_near, form_n.
    """
    if ratio < 2:
        raise ValueError("chains of forms end for ratios of 2 or more only")
    words = store(observed_words(docs, least_length).filter(F.col("n") >= least_count), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    table = joined.select(
        "word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("form_n")).alias("form_n"),
    )
    table = store(table, "variants")
    links = store(table.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        links = store(links.join(ahead, "root", "left").select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")), "links")
        if not links.filter("_moved").head(1):
            break
        links = links.select("word", "root")
    rooted = table.join(links.select("word", "root"), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
