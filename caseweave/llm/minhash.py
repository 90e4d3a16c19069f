"""Near-duplicates by ProbMinHash signatures of weighted word shingles, banding and exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.components import components
from caseweave.llm.shared import distinct_texts, join_groups, store, text_key, unused
from caseweave.llm.words import Words, blocks, mix, words_of

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
GROUP = 256
SMALL = 24
_INF = np.inf


def weighted_shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) sorted by text and hash; the weight is the number of occurrences.

    A text of fewer words than ``width`` is one shingle of all its words.
    """
    hashes = words.hashes()
    at, value = words.windows(hashes, width)
    text = words.text_of[at]
    for short in range(1, width):
        if len(few := np.flatnonzero(words.counts == short)):
            at, other = words.windows(hashes, short)
            here = np.isin(words.text_of[at], few)
            text, value = np.append(text, words.text_of[at][here]), np.append(value, other[here])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))[: len(text)])
    return text[first], value[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash: each register keeps the element whose Poisson process reached it first.

    An element of weight w arrives at exponential gaps of rate w, each time at a uniformly chosen register; both
    follow from its hash alone. It is done once its next arrival is later than all registers of its text. Two texts
    agree at a register with probability equal to their probability Jaccard similarity.
    """
    best = np.full(texts * size, _INF)
    held = np.zeros(texts * size, np.uint64)
    limit = np.full(texts, _INF)
    text, value, rate, time = text.copy(), value, weight.astype(float), np.zeros(len(text))
    turn = 0
    while len(text):
        turn += 1
        gap = mix(value + np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        time = time - np.log(((gap >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        alive = time < limit[text]
        text, value, rate, time, gap = text[alive], value[alive], rate[alive], time[alive], gap[alive]
        slot = text * size + (mix(gap ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)
        better = np.flatnonzero(time < best[slot])
        # The earliest arrival at a register is written last.
        better = better[np.argsort(-time[better], kind="stable")]
        best[slot[better]] = time[better]
        held[slot[better]] = value[better]
        changed = np.unique(text[better])
        if len(changed):
            limit[changed] = best.reshape(texts, size)[changed].max(1)
    return held.reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key ^ parts[:, :, i]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(key)


def jaccard(value_a, weight_a, value_b, weight_b) -> float:
    """The larger of the probability Jaccard similarity and the plain one of the shingle sets."""
    _, in_a, in_b = np.intersect1d(value_a, value_b, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    a, b = weight_a[in_a].astype(float), weight_b[in_b].astype(float)
    only_a, only_b = weight_a.sum() - a.sum(), weight_b.sum() - b.sum()
    # For a shared i: 1 / sum over all j of max(a_j / a_i, b_j / b_i), by the order of the ratios b / a.
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    below = np.append(0, np.cumsum(a))[np.searchsorted(ratio, ratio, "right")] + only_a
    above = b.sum() - np.append(0, np.cumsum(b))[np.searchsorted(ratio, ratio, "right")] + only_b
    weighted = float((1.0 / (below / a + above / b)).sum())
    return max(weighted, len(a) / (len(value_a) + len(value_b) - len(a)))


@dataclass
class Duplicates:
    """``classes``: (key, component) of distinct texts in a class of more than one; ``links``: verified links, at least a spanning tree of each class."""

    links: DataFrame
    classes: DataFrame


def _with_plain(keys: np.ndarray, text: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, band key) sorted by text: the given keys, and where a shingle occurs again also those of the plain set.

    A pair that is alike by its plain sets alone has no common weighted band. The plain signature is that of weights
    of 1, so it meets the only one of a text without repeats. Keys that both signatures have are listed once.
    """
    texts, bands = keys.shape
    owner, repeated = np.repeat(np.arange(texts), bands), np.unique(text[weight > 1])
    if not len(repeated):
        return owner, keys.reshape(-1)
    here = np.isin(text, repeated)
    number = np.searchsorted(repeated, text[here])
    plain = band_keys(signatures(number, value[here], np.ones(len(number)), len(repeated), bands * rows), bands, rows)
    other = plain != keys[repeated]
    owner = np.append(owner, np.repeat(repeated, bands).reshape(-1, bands)[other])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.append(keys.reshape(-1), plain[other])[order]


def _bands(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    def sign(batches):
        for part, data, offsets in blocks(batches):
            words = words_of(data, offsets)
            text, value, weight = weighted_shingles(words)
            some = np.flatnonzero(words.counts > 0)
            if not len(some):
                continue
            number = np.searchsorted(some, text)
            keys = band_keys(signatures(number, value, weight, len(some), bands * rows), bands, rows)
            owner, keys = _with_plain(keys, number, value, weight, rows)
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(some))))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), listed], names=["key", "bands"])

    signed = store(texts.select("key", "text").mapInArrow(sign, "key binary, bands array<bigint>"), "signatures")
    return signed.select("key", F.explode("bands").alias("band"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of keys whose texts are similar enough, by their whole shingles.

    The pairs of one ``a`` are cut into groups of about ``GROUP``, each of which gets the text of ``a`` once, so a
    text with very many partners is no single task. Only texts that are in a pair are moved.
    """
    many = store(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")), "centres")
    pairs = join_groups(pairs, many, "a", "partners")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.expr("partners div %d" % GROUP) + 1).cast("int"))
    wanted = pairs.select("a", "part", F.col("b").alias("key")).withColumn("member", F.lit(True))
    wanted = wanted.unionAll(pairs.select("a", "part").distinct().select("a", "part", F.col("a").alias("key"), F.lit(False)))
    rows = wanted.join(texts.select("key", "text"), "key").repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def compare(batches):
        centre, of = None, None
        for part, data, offsets in blocks(batches):
            words = words_of(data, offsets)
            text, value, weight = weighted_shingles(words)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            a, b, similar = [], [], []
            columns = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())
            for i, (key, group, number, member) in enumerate(columns):
                own = value[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]
                if not member:
                    centre, of = own, (group, number)
                    continue
                if of != (group, number):
                    raise ValueError("a group without its first text")
                score = jaccard(*centre, *own)
                if score >= least - 1e-9:
                    a.append(group)
                    b.append(key)
                    similar.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])

    return rows.select("key", "a", "part", "member", "text").mapInArrow(compare, "a binary, b binary, similarity double")


def _block_links(left: list, right: list, least: float) -> list[tuple[bytes, bytes, float]]:
    """Links between two bounded lists of (key, component, values, weights), one at most for each pair of components.

    Counts of common shingles come from matrix products over the shingles that occur on both sides, some at a time.
    They give the plain similarity and a bound of the weighted one; what passes is computed exactly.
    """
    sides = []
    for members in (left, right):
        size = [len(m[2]) for m in members]
        share = [m[3] / m[3].sum() if len(m[3]) else m[3] for m in members]
        sides.append((np.repeat(np.arange(len(members)), size), np.concatenate([m[2] for m in members]), np.concatenate(share), np.array(size)))
    common = np.intersect1d(sides[0][1], sides[1][1])
    shape = (len(left), len(right))
    count, mass_a, mass_b = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for low in range(0, len(common), 4096):
        part, dense = common[low : low + 4096], []
        for row, value, share, size in sides:
            at = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[at] == value
            here, held = np.zeros((len(size), len(part)), np.float32), np.zeros((len(size), len(part)), np.float32)
            here[row[hit], at[hit]] = 1
            held[row[hit], at[hit]] = share[hit]
            dense.append((here, held))
        (a, pa_), (b, pb) = dense
        count += a @ b.T
        mass_a += pa_ @ b.T
        mass_b += a @ pb.T
    plain = count / np.maximum(sides[0][3][:, None] + sides[1][3][None, :] - count, 1)
    root = {m[1]: m[1] for m in [*left, *right]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    # With the shares a and b of both texts that lie in common shingles, the weighted one is 1 / (1/a + 1/b - 1) at most.
    weighted = 1 / (1 / np.maximum(mass_a, 1e-9) + 1 / np.maximum(mass_b, 1e-9) - 1)
    for i, j in np.argwhere((plain >= least - 1e-6) | (weighted >= least - 1e-4)):
        x, y = left[i], right[j]
        low, high = find(x[1]), find(y[1])
        if low != high and (score := jaccard(*x[2:], *y[2:])) >= least - 1e-9:
            root[low] = high
            out.append((x[0], y[0], score))
    return out


def _linked_in_blocks(open_: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between components that share a large bucket.

    Of each bucket, what is outside its largest component is compared with everything in it, in blocks of about
    ``GROUP`` by ``GROUP`` texts that meet in one group of rows: no pair of texts is ever a row, and a single stray
    in a bucket of copies costs one comparison with each.
    """
    inside = open_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("held"))
    buckets = inside.groupBy("band").agg(
        F.sum("held").alias("all"), F.max("held").alias("most"), F.max(F.struct("held", "component"))["component"].alias("main")
    )
    rows = open_.join(buckets, "band")
    outside = F.expr("cast((all - most) / %d as int) + 1" % GROUP)
    total = F.expr("cast(all / %d as int) + 1" % GROUP)
    rows = rows.withColumns({"outside": outside, "total": total, "stray": F.col("component") != F.col("main")})
    own = F.pmod(F.xxhash64("key"), F.col("total"))
    right = rows.select(
        "band", F.explode(F.expr("sequence(0, outside - 1)")).alias("i"), own.cast("int").alias("j"), "key", "component", F.lit(True).alias("right")
    )
    left = rows.filter("stray").select(
        "band", F.pmod(F.xxhash64("key", F.lit(1)), F.col("outside")).cast("int").alias("i"),
        F.explode(F.expr("sequence(0, total - 1)")).alias("j"), "key", "component", F.lit(False).alias("right"),
    )
    wanted = left.unionAll(right).join(texts.select("key", "text"), "key")
    wanted = wanted.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "right")
    wanted = wanted.select("key", "component", "band", "i", "j", "right", "text")

    def compare(batches):
        group, sides = None, ([], [])

        def links():
            found = _block_links(*sides, least) if sides[0] and sides[1] else []
            a, b, score = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

        for part, data, offsets in blocks(batches):
            words = words_of(data, offsets)
            text, value, weight = weighted_shingles(words)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i, (key, component, *place, right) in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)))):
                if place != group:
                    if group is not None:
                        yield links()
                    group, sides = place, ([], [])
                sides[right].append((key, component, value[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]))
        if group is not None:
            yield links()

    return wanted.mapInArrow(compare, "a binary, b binary, similarity double")


def near_duplicates(texts: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> Duplicates:
    """Classes of similar texts among distinct ``texts`` (key, text).

    Texts that share a band meet in a bucket. First every member is compared with one text of the bucket, the one
    that meets most others in all its bands; this settles most groups of copies with a pair for each member. Buckets
    that still hold several components are compared in full, small ones (up to ``SMALL`` texts) pair by pair, each
    pair once whatever the number of its buckets, large ones in blocks. So no link between components is lost.
    """
    band = _bands(texts, bands, rows)
    sizes = band.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = store(band.join(sizes, "band"), "buckets")
    fame = shared.groupBy("key").agg(F.sum("members").alias("fame"))
    ranked = shared.join(fame, "key")
    centres = ranked.groupBy("band").agg(F.max(F.struct("fame", "key"))["key"].alias("a"))
    first = store(shared.join(centres, "band").filter("key != a").select("a", F.col("key").alias("b")).distinct(), "pairs")
    links = store(_verified(first, texts, least), "links")
    found = components(links)

    member = shared.join(found.withColumnRenamed("node", "key"), "key", "left")
    member = member.select("band", "key", "members", F.coalesce("component", "key").alias("component"))
    # Buckets of one component are done.
    open_ = member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    member = store(member.join(open_.select("band"), "band", "left_semi"), "open")
    small = member.filter(F.col("members") <= SMALL)
    other = small.select("band", F.col("key").alias("key2"), F.col("component").alias("component2"))
    rest = small.join(other, "band").filter("component < component2")
    rest = rest.select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct()
    tried = first.unionAll(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = store(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _verified(rest, texts, least)
    blocked = _linked_in_blocks(member.filter(F.col("members") > SMALL).drop("members"), texts, least)
    links = store(links.unionAll(more).unionAll(blocked), "links")
    return Duplicates(links, components(links))


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size, kept, key (of its text).

    Two texts are linked when their shingles of five words (a shorter text is one shingle) have a probability
    Jaccard similarity, or a plain one, of at least ``least``; copies of a text belong together. A class is a connected
    component; ``class_id`` is its least doc_id (null if it has none), and the document with this id stays.
    Candidates come from 24 bands of 5 ProbMinHash registers, for texts that repeat a shingle also from those of their
    plain sets: a pair at 0.8 in either similarity is missed with probability 7e-5.

    Documents without words (null, empty or white space only) have no shingles: one text of them is a class.
    Of rows repeated with the same id one is kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", text_key().alias("key"))
    found = near_duplicates(distinct_texts(docs)[0], least)
    classes = found.classes.withColumnRenamed("node", "key")
    # Rows are summed for each text first, then for each class: no group of copies meets in one task.
    members = rows.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    members = members.join(classes, "key", "left")
    members = members.withColumn("component", F.coalesce("component", "key"))
    members = store(members.select("doc_id", "key", "component", "times"), "members")
    groups = members.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("times").alias("class_size"), F.count(F.lit(1)).alias("rows"))
    # A kept row is one of the texts with the least id, should several texts carry it.
    one = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
    groups = store(groups.join(one, "component"), "groups")
    out = join_groups(members, groups, "component", "rows").withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    kept = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("key") == F.col("one.key"))
    return out.select("doc_id", "class_id", "class_size", kept.alias("kept"), F.col("key"))


def without_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class of ``near_duplicate_classes``, columns as they came; of repeated rows one stays."""
    key, own, of = unused(docs, "key"), unused(docs, "id"), unused(docs, "of")
    chosen = near_duplicate_classes(docs, least).filter("kept").select(F.col("doc_id").alias(own), F.col("key").alias(of))
    rows = docs.withColumn(key, text_key())
    found = rows.join(chosen, (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    return found.dropDuplicates(["doc_id", key]).drop(key)
