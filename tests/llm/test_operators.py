"""Every operator against a brute-force version on a table of edge cases, and on an empty one."""

import collections
import functools
import hashlib
import itertools
import operator
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseweave.llm import components, decontaminate, exact, html_text, langid, minhash, mixing, repeats, substrings, suffixes, tokens, warc, words

BPE = public_tokenizers.path("byte_bpe_50k.json")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def listed(df):
    return [tuple(r) for r in df.collect()]


def same(left, right):
    assert collections.Counter(left) == collections.Counter(right)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact(edge_docs, no_docs):
    rows = pairs(edge_docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want, seen = [], set()
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        first = (i, t) not in seen
        seen.add((i, t))
        want.append((i, keep, len(groups[t]), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
    same(listed(exact.exact_duplicates(edge_docs)), want)
    # A filter that is full of collisions changes no result.
    same(listed(exact.exact_duplicates(edge_docs, max_slots=4)), want)
    assert exact.exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("window,first", [(35, 9), (7, 9), (5, 1)])
def test_substrings(edge_docs, no_docs, window, first):
    rows = [(i, split(t), t) for i, t in pairs(edge_docs)]
    count = collections.Counter(tuple(w[k : k + window]) for _, w, _ in rows for k in range(len(w) - window + 1))
    want = []
    for i, w, _ in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    same(listed(substrings.without_repeated_windows(edge_docs, window, first)), want)
    assert substrings.without_repeated_windows(no_docs).count() == 0


@pytest.mark.parametrize("length", [400, 25])
def test_suffixes(edge_docs, no_docs, length):
    rows = [(i, t.encode()) for i, t in pairs(edge_docs)]
    count = collections.Counter(hash(b[k : k + length]) for _, b in rows for k in range(len(b) - length + 1))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if count[hash(b[k : k + length])] > 1:
                gone[k : k + length] = 1
        spans = int((np.diff(np.append(0, gone)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    same(listed(suffixes.without_repeated_strings(edge_docs, length)), want)
    assert suffixes.without_repeated_strings(no_docs).count() == 0


def test_strings_whose_matches_lie_with_different_partners(spark):
    """A match back with one partner and ahead with another is no repeated string; short matches between anchors are found."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcd"), 40)) for _ in range(12)]
    texts = ["".join(pool[k] for k in rng.integers(0, 12, 6)) + "".join(rng.choice(list("xyz"), 3)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (50, 61, 83):
        count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        want = {}
        for i, t in enumerate(texts):
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - length + 1):
                if count[t[k : k + length]] > 1:
                    gone[k : k + length] = True
            want[i] = int(gone.sum())
        assert {r.doc_id: r.n_removed for r in suffixes.without_repeated_strings(docs, length).collect()} == want


@pytest.mark.parametrize("alphabet", ["ab", "abcd"])
def test_strings_with_repeated_seeds(spark, alphabet):
    """Short words of few letters: large classes, equal seeds in one string, and strings found from two anchors."""
    rng = np.random.default_rng(11)
    pool = ["".join(rng.choice(list(alphabet), 14)) for _ in range(5)]
    texts = ["".join([*(pool[k] for k in rng.integers(0, 5, 5)), *rng.choice(list(alphabet), 8), *(pool[k] for k in rng.integers(0, 5, 4))]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for length in (25, 40):
        count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        want = {}
        for i, t in enumerate(texts):
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - length + 1):
                if count[t[k : k + length]] > 1:
                    gone[k : k + length] = True
            want[i] = int(gone.sum())
        assert {r.doc_id: r.n_removed for r in suffixes.without_repeated_strings(docs, length).collect()} == want


def test_loser_tree():
    rng = np.random.default_rng(0)
    runs = [sorted({bytes(rng.integers(97, 99, rng.integers(1, 12)).tolist()) for _ in range(30)}) for _ in range(5)]
    coded = [suffixes.Run(suffixes.Run.encode(r, [b"%d" % i] * len(r))) for i, r in enumerate(runs)]
    found = list(suffixes.merged(coded))
    assert [t for t, _, _ in found] == sorted(itertools.chain(*runs))
    before = b""
    for text, _, lcp in found:
        assert lcp == suffixes.common(before, text, 0)
        before = text


def shingles(text):
    w = split(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    return collections.Counter(grams)


def weighted_jaccard(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a | b) for i in a & b)


def test_near_duplicates(edge_docs, no_docs):
    rows = pairs(edge_docs)
    texts = sorted({t for _, t in rows})
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if set(x) & set(y) and max(weighted_jaccard(x, y), len(set(x) & set(y)) / len(set(x) | set(y))) >= 0.8:
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[find(t)].append(i)
    found = minhash.near_duplicate_classes(edge_docs)
    ids = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    same(listed(found.select("doc_id", "class_id", "class_size")), [(i, ids[find(t)], len(groups[find(t)])) for i, t in rows])
    assert found.filter("kept").count() == len(groups)
    assert found.filter("kept and not doc_id <=> class_id").count() == 0
    left = minhash.without_near_duplicates(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == len(groups)
    assert minhash.near_duplicate_classes(no_docs).count() == 0


def test_large_buckets_equal_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 100, rng.integers(0, 9)):
            w[k] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(shingles(t)) for _, t in rows]
    root = list(range(120))
    for _ in range(120):
        for i, j in itertools.combinations(range(120), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in range(120)):
            break
    for small in (1000, 3):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "GROUP", 16)
        found = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
        assert found == dict(enumerate(root))


def test_pairs_alike_by_their_plain_sets_alone(spark):
    rows = []
    for i in range(8):
        line, rest, other = (" ".join(f"{kind}{i}x{k}" for k in range(n)) for kind, n in (("l", 10), ("r", 90), ("o", 4 if i >= 4 else 0)))
        # The last four repeat unequal lines on both sides.
        rows += [(2 * i, f"{line} {line} {rest} {f'{other} ' * (12 if other else 0)}"), (2 * i + 1, f"{f'{line} ' * 31}{rest} {f'{other} ' * (2 if other else 0)}")]
    for (_, a), (_, b) in zip(rows[::2], rows[1::2]):
        x, y = shingles(a), shingles(b)
        assert len(set(x) & set(y)) >= 0.95 * len(set(x) | set(y)) and weighted_jaccard(x, y) < 0.45
    found = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    same(listed(found.select("doc_id", "class_id", "class_size")), [(i, i // 2 * 2, 2) for i, _ in rows])


def test_signatures_estimate_similarity():
    a, b = {1: 3, 2: 1, 3: 1, 4: 2}, {1: 1, 2: 1, 3: 4, 5: 2}
    text = np.repeat([0, 1], [4, 4])
    value = words.mix(np.array([*a, *b], np.uint64))
    found = minhash.signatures(text, value, np.array([*a.values(), *b.values()]), 2, 4000)
    want = weighted_jaccard(collections.Counter(a), collections.Counter(b))
    assert abs((found[0] == found[1]).mean() - want) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (2, 1)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    same(listed(found), [(i, 1) for i in range(2, 41)] + [(101, 100), (102, 100)])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, edge_docs, no_docs):
    items = [(1, words_part(2, 60, 5, 40)), (2, "ONE two"), (3, None), (4, ""), (5, words_part(1, 120, 0, 30) + " other end words here"), (6, "absent words only in here"), (2, "ONE two"), (None, words_part(7, 20_000, 9_000, 9_030))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(text, width):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(text)]
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    want = []
    for i, t in pairs(edge_docs):
        for item, text in items:
            width = min(5, len(split(text)))
            need = grams(text, width) if width else set()
            hits = len(need & grams(t, width)) if width else 0
            if need and hits >= 0.8 * len(need):
                want.append((i, item, len(need), hits))
    found = decontaminate.contained_items(edge_docs, bench)
    same(listed(found.select("doc_id", "item_id", "item_shingles", "shared")), want)
    assert len(want) >= 5
    # Small blocks of items, one pass for each, give the same.
    small = decontaminate.contained_items(edge_docs, bench, limit=20)
    same(listed(small.select("doc_id", "item_id", "item_shingles", "shared")), want)
    clean = decontaminate.without_items(edge_docs, bench)
    hit = {i for i, *_ in want}
    same(listed(clean.select("doc_id")), [(i,) for i, _ in pairs(edge_docs) if i not in hit])
    assert decontaminate.contained_items(no_docs, bench).count() == 0
    assert decontaminate.contained_items(edge_docs, bench.limit(0)).count() == 0
    assert decontaminate.without_items(edge_docs, bench.limit(0)).count() == edge_docs.count()


def words_part(seed, n, low, high):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))[:] if (low, high) == (0, n) else " ".join(
        f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(low, high)
    )


def test_sketches_lose_no_item():
    for n in range(1, 400):
        size, need = decontaminate.sketch_size(n)
        missing = n - decontaminate.least_shared(n)
        assert 1 <= need <= max(1, size - missing) and size <= n


def test_mixing(edge_docs, no_docs):
    mixture = mixing.mix_sources(edge_docs, block_words=8, shard_slots=64)
    rows = mixing.taken_words(mixture).collect()
    same([(r.doc_id, r.size) for r in rows], [(i, len(split(t))) for i, t in pairs(edge_docs)])
    assert all(r.taken <= 3 * r.size for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(n for n in by if n is not None) + [None]
    sizes = [sum(r.size for r in by[n]) for n in names]
    targets = mixing.capped_targets(sizes, [1.0 + i % 3 for i in range(len(names))])
    for name, size, target in zip(names, sizes, targets):
        assert {r.source_size for r in by[name]} == {size} and abs(by[name][0].target - target) < 1e-6
        assert abs(sum(r.taken for r in by[name]) - target) <= 16
    again = mixing.taken_words(mixing.mix_sources(edge_docs, block_words=8, shard_slots=64))
    same(listed(again), [tuple(r) for r in rows])
    assert mixing.taken_words(mixing.mix_sources(no_docs)).count() == 0
    mixed = mixing.mixed_documents(edge_docs, block_words=8, shard_slots=64)
    assert mixed.columns == edge_docs.columns
    total = sum(len(split(r.text)) for r in mixed.collect())
    assert total == sum(r.taken for r in rows)


def test_permutation_and_targets():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.capped_targets([10, 100], [9, 1]) == [30.0, 80.0]
    assert mixing.capped_targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_languages(spark, no_docs):
    rng = np.random.default_rng(1)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["str", "ung", "ö"], "zz": ["eau", "é", "ch"]}
    rows = [(i, lang, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(30))) for i, lang in enumerate(list(syllables) * 60)]
    rows += [(1000, None, None), (1001, "xx", "12 !?"), (None, "xx", "kalo mi"), (1002, "yy", "strung" * 50_000), (1002, "yy", "strung" * 50_000)]
    docs = spark.createDataFrame([(i, t, lang, "x") for i, lang, t in rows], "doc_id long, text string, lang string, score string")
    found = langid.identify(docs)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and found.count() == len(rows)
    marked = found.withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    judged = [r for r in marked if r.held and r.doc_id < 1000]
    assert judged and all(r.lang_pred == r.lang for r in judged)
    assert all(0 <= r.score <= 1 for r in marked)
    assert {r.lang_pred for r in marked if r.doc_id in (1000, 1001)} == {"und"}
    assert langid.identify(no_docs).count() == 0 and langid.identified_only(no_docs, 0.3).count() == 0


def test_the_language_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    rows = [(7, f"{a} text number {'x' * (i % 17 + 1)}", a) for i in range(150) for a in ("aa", "bb")] + [(7, "12", "aa")] * 3
    rows += [(i, f"{a} other {'y' * i}", a) for i, a in enumerate(["aa", "bb"] * 10, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda found, languages: seen.append(languages))
    learned = {a: len({i for i, _, lang in rows if lang == a and zlib.crc32(str(i).encode()) % 5}) for a in ("aa", "bb")}
    assert zlib.crc32(b"7") % 5 and min(learned.values()) > 4
    for most in (4, 400):
        langid.train(docs, most)
        assert collections.Counter(seen.pop()) == {a: min(n, most) for a, n in learned.items()}


def test_tokens(edge_docs, no_docs):
    coder = Tokenizer.from_file(BPE)
    rows = sorted(pairs(edge_docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for i, t in rows:
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = tokens.write_tokens(edge_docs, BPE)
    same(listed(tokens.token_table(edge_docs, BPE)), want)
    path = manifest.first().path
    index = np.fromfile(path.removeprefix("file:") + ".idx", "<i8").reshape(-1, 3)
    for doc_id, offset, length in index:
        found, ids = tokens.read_record(path + ".rec", int(offset), int(length))
        assert ids[-1] == 0 and (found == doc_id or found is None)
    assert tokens.token_table(no_docs, BPE).count() == 0


def test_pieces_are_encoded_as_in_the_whole():
    plain, coder = Tokenizer.from_file(BPE), tokens.Encoder(BPE)
    texts = ["", " ", "a  b\n\nc \n d", "x, y. z", "don't, 'll go. 12.5 ×,÷.", "  a \n b", "é.É,ü;ß:!?…", "tab\t end ", "a\n", "\r\n x \x1c y", "<|endoftext|> q", "日本, 語.\nは"]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("ab é,.\n\t '1 ×!"), 40)) for _ in range(300)]
    raw = [t.encode() for t in texts]
    for part in (texts[:10], texts[12:]):
        raw = [t.encode() for t in part]
        ids, ends = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        for t, low, high in zip(part, np.append(0, ends[:-1]), ends):
            assert ids[low:high].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_are_checked():
    assert tokens.masked_crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == (((0xE3069283 >> 15) | (0xE3069283 << 17 & 0xFFFFFFFF)) + 0xA282EAD8) % 2**32
    framed, lengths = tokens.frame([b"a" * n for n in (4, 63, 64, 65, 1000)])
    assert [len(p) for p in tokens.unframe(framed + b"abc")[0]] == [4, 63, 64, 65, 1000] and lengths.sum() == len(framed)
    with pytest.raises(ValueError):
        tokens.unframe(framed[:14] + b"b" + framed[15:])


def test_word_hashes_take_little_memory():
    """Sums of a few bytes at a time; a word longer than such a piece is one of its own."""
    rng = np.random.default_rng(5)
    texts = [b"a" * 300_000 + b" b", *[bytes(rng.choice(list(b"abcdef  "), 400_000).astype(np.uint8)) for _ in range(4)]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    found = words.words_of(data, offsets)
    tracemalloc.start()
    hashes = found.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(hashes) + 40 * 300_000
    alone = [words.words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)])).hashes() for t in texts]
    assert (hashes == np.concatenate(alone)).all()
    assert len(set(hashes.tolist())) == len({w for t in texts for w in t.split()})


@pytest.mark.parametrize("size", [1, 400, 1 << 20])
def test_hashes_of_a_bucket_are_not_sent_with_every_pack(spark, monkeypatch, size):
    """They go once to each slice of its packs, and every slice finds the same."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", size, raising=False)
    again = np.arange(10, 2010, 2, dtype="<u8")
    packs = [(b, b % 2, 56, np.array([5, 10 + b], "<u8").tobytes(), np.array([1, 1], "<i4").tobytes(), bytes([b] * 16), bytes(8), np.array([3, b], "<i4").tobytes()) for b in range(40)]
    packed = spark.createDataFrame(packs, "block long, bucket long, size long, hashes binary, counts binary, keys binary, texts binary, at binary")
    known = spark.createDataFrame([(0, again.tobytes()), (1, b"")], "bucket long, again binary")
    frame, sent = type(packed), []
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, f=frame.mapInArrow, **k: sent.append(self) or f(self, *a, **k))
    found = {bytes(r["key"])[0]: np.frombuffer(r["at"], "<i4").tolist() for r in repeats.places(packed, known).collect()}
    assert found == {b: [b] for b in range(0, 40, 2)}
    binary = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in sent[0].dtypes if kind == "binary"]
    moved = sent[0].agg(F.sum(functools.reduce(operator.add, binary))).first()[0]
    assert moved <= 40 * 56 + -(-20 * 56 // size) * again.nbytes


def test_new_pieces_are_encoded_as_one_text():
    """Pieces not seen before go to the tokenizer joined, and come back as if encoded alone."""
    plain, coder, sent = Tokenizer.from_file(BPE), tokens.Encoder(BPE), []
    batch = coder._batch
    coder._batch = lambda texts: sent.append(len(texts)) or batch(texts)
    pieces = [f" x{i}yé" for i in range(500)] + [f" {i}'s" for i in range(200)] + [f" '{i}" for i in range(50)] + [f' "--{i}\t\u00a0 ' for i in range(50)]
    texts = [p.encode() for p in ["".join(pieces), "".join(reversed(pieces)) + "  ", "a b\n c\n\nd  e. f"]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ids, ends = coder.encode(data, np.append(0, np.cumsum([len(t) for t in texts])))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert sum(sent) < 100


def test_warc(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (5, "http://a/5", big), (3, None, big), (7, "u v", "small"), (8, "u", "small"), (9, "u", None), (None, "u", big), (10, "", ""), (11, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.archived_pages(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id in (1, 3, 5))
    assert kinds == [(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (5, "revisit", 5)]
    assert all(r.record_type == "response" for r in found if r.page_id not in (1, 3, 5))
    assert warc.archived_pages(pages.limit(0)).count() == 0
    packed = warc.record(1, "u", b"abc", None)
    with pytest.raises(ValueError):
        warc.verified(zlib.decompress(packed, 31).replace(b"abc", b"abd"))


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<b> b </b>c", "a b c"),
    ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<script>x</script><p hidden>h</p><p style='display: none'>n</p>v", "v"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a   bbb\ncc  d"), ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<title>t</title><h1>H</h1>x &amp; y", "H\n\nx & y"), ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("</p></div>x</table>", "x"), ("<b>" * 5000 + "deep", "deep"), ("<details><summary>s</summary>no</details>", "s"),
])
def test_html(html, text):
    assert html_text.html_text(html) == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, "c"), (None, "<p>x", "c"), (2, "<td>" * 3000 + "y", "c"), (3, "<table><tr><td>" * 400 + "z", "c")], "page_id long, html string, text string")
    found = {r.page_id: (r.text, r.n_chars, r.n_lines) for r in html_text.page_texts(pages).collect()}
    assert found == {1: ("", 0, 0), None: ("x", 1, 1), 2: ("y", 1, 1), 3: ("z", 1, 1)}
    assert html_text.page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html,text", [
    ("<table><tr><form><td>x</td></form></tr></table>", "x"), ("<table>text<tr><td>x</table>", "text\n\nx"), ("<table><div>text</div><tr><td>x</table>", "text\n\nx"),
    ("<table><tr><a>text</a><td>x</table>", "text\n\nx"), ("<table><tr><td>x</td>text</tr><b>b</b></table>y", "textb\n\nx\n\ny"), ("<table><tr><td>a<td>b</tr><table><tr><td>c</table>", "a  b\n\nc"),
    ("<table><div>a<tr><td>x<td>y</div>z</table>", "a\n\nx  yz"), ("<table><td>a<td>b</table>", "a  b"), ("<form><table><tr><td>a</form><td>b</table></form>c", "a  b\n\nc"),
    ("<table><tr><td><table>t<tr><td>x</table><td>y</table>", "t  y\n\nx"), ("<table><caption>c<p>p</caption>t<colgroup>u<col><tr><td>x</table>", "tu\n\nc\n\np\nx"),
    ("<table><tr><td>x<template><tr><td>no</template><td>y</table>", "x  y"), ("<ul><li>a<table><tr><li>b</li><td>x</table></ul>", None),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b  c\nd     e\nf  g"),
    ("<table><tr><td>a<p>b</p><td>c<tr><td>d</table>", "a  c\n\nb\nd"), ("<table><tr><td><br><tr><td>x</table>", "x"),
])
def test_no_text_of_a_table_is_lost(html, text):
    found = html_text.html_text(html)
    assert found == text or text is None
    shown = re.sub(r"<template>.*</template>", "", html)
    assert sorted(re.sub(r"<[^>]*>|\s", "", shown)) == sorted(re.sub(r"[\s-]", "", found))


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>T</title><p>Hello <b>x</b>", "Hello x"), ("<head><meta charset=utf-8><style>s</style> text <p>p", "text\n\np"), ("<head><script>s</script>text", "text"),
    ("<head><title>T</title><h1>a</h1><body><p>b</body>", "a\n\nb"), ("<head>\n<title>T</title>\n</head><p>a", "a"), ("<head><title>T</title><body>a", "a"),
    ("<head><noscript><link></noscript><template><p>no</template><link><div>a</div>", "a"), ("<head><title>T</title><br>a<title>U</title>", "a"),
    ("<head><noscript><link><body>a", "a"),
])
def test_an_open_head_ends_where_text_begins(html, text):
    assert html_text.html_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<button><svg class='i'/>Buy</button> now", "Buy now"), ("<svg/>rest<p>of it", "rest\n\nof it"), ("<svg><path d=''/><title>no</title><g/><text>A</text><text>B<tspan>C</tspan></text>x</svg>y", "A BC y"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"), ("<svg><defs><text>no</text></defs><desc>no</desc><metadata>no</metadata><foreignObject><div/>in</div></foreignObject></svg>", "in"),
    ("<svg><g><p>out</svg>after", "outafter"), ("<svg><style/><script/><text>t</text></svg>", "t"), ("<math><mtext>a<b/>c</b></mtext><mspace/><mi/>d</math>e", "acde"),
    ("<table><tr><svg/><td>x<svg><text>l</text></svg></table>", "x l"), ("<svg hidden><text display=none>no</text></svg><desc>d</desc>", "d"), ("<div/>a<p>b", "a\n\nb"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math>", "1 2"), ("<svg><a><text><a><a><a>deep", "deep"), ("<svg><title>no<b>no</b></title><text>t</text></svg>", "t"),
])
def test_text_of_svg_and_math(html, text):
    assert html_text.html_text(html) == text
