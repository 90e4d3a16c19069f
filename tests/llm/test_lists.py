"""URL rules, filter audit and spelling variants against brute force on tables of edge cases, and on empty ones."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caseweave.llm import audit, spelling, urls


def same(left, right):
    assert collections.Counter(left) == collections.Counter(right)


def listed(df):
    return [tuple(r) for r in df.collect()]


# --- URL rules


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def judged(url, rules):
    host, path = parsed(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "https://EXAMPLE.org/es/1?x=/de/", "http://a.example.org/es", "http://a.EXAMPLE.Org/en/19#top",
    "http://badexample.org/es/", "http://x.com/de/", "http://x.com/DE/", "http://com/fr/é", "http://user@a.b.com:80/de/1", "http://x.com./de/", "http://x.com?q=/de/", "http://x.com#/de/",
    "http://a.org/http://b.com/de/", "http://example.org/en/2", "http://é.org/ÉÉ", "http://" + "a." * 5000 + "com/de/" + "x" * 50_000, "http://x.com/de/\nline", "x://y.com/fr/ z",
]


def test_urls(spark):
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(URLS)] + [(None, URLS[7], "c", None, "c"), (7, URLS[7], "c", "c", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, html string").repartition(3)
    got = urls.judge_urls(pages, urls.rule_table(spark, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    same(listed(got), [(r[0], *judged(r[1], RULES)) for r in rows])
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark, RULES)).count() == 0
    # Without rules everything has the default verdict.
    none = urls.judge_urls(pages, urls.rule_table(spark, []), "block").select("rule", "verdict").distinct()
    assert listed(none) == [(None, "block")]


def test_many_url_rules_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    hosts = [".".join(rng.choices(["a", "b", "cc", "é"], k=k)) for k in (1, 2, 3, 3) for _ in range(12)]
    paths = ["", "/", *["/" + "".join(rng.choices("xyé/", k=rng.randint(1, 5))) for _ in range(30)]]
    rules = {(h, p): rng.choice(["allow", "block"]) for h, p in zip(rng.choices(hosts, k=300), rng.choices(paths, k=300))}
    rules = [(*k, v) for k, v in rules.items()]
    # Equal rules count once, with the greater verdict; no verdict is no rule; null counts as empty.
    extra = [(*rules[0][:2], "allow"), ("a", "/x", None), (None, None, "block")]
    made = [f"http://{rng.choice(hosts)}{rng.choice(['', '.', '.a', 'x'])}{rng.choice(paths)}{rng.choice(['', 'x', '/y', '?q'])}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    paths_of, copied, longest = urls.store_rules(urls.rule_table(spark, rules))
    assert len(paths_of) > 1 and not copied and longest == max(len(h.encode()) for h, _, _ in rules)
    want = [(i, *judged(u, [*rules, ("", "", "block")])) for i, u in enumerate(made)]
    # A host that ends with a dot is a subdomain of the empty host.
    same(listed(urls.judge_urls(pages, urls.rule_table(spark, rules + extra))), want)


def test_digest_array_confirms_strings(tmp_path):
    key = xxhash.xxh64_intdigest(b"asked", urls.SEED)
    entries = [b"other\0one", b"asked\0two", b"last\0three"]
    with open(tmp_path / "x", "wb") as out:
        for array in (np.array([3]), np.full(3, np.uint64(key)).view(np.int64), np.cumsum([len(e) for e in entries])):
            out.write(array.astype(np.int64).tobytes())
        out.write(b"".join(entries))
    found = urls.DigestArray([str(tmp_path / "x")])
    assert found.find([b"asked", b"absent", b""]) == [b"two", None, None]
    assert urls.DigestArray([]).find([b"asked"]) == [None]


def test_digest_is_the_one_of_spark(spark):
    names = ["", "R", "Rexample.org/é", "x" * 100]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.xxhash64(F.encode("n", "UTF-8")).alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(r.n.encode(), urls.SEED)).view(np.int64) == r.h for r in rows)


# --- filter audit


def audited(docs, labels):
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, source, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ("A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
                 + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t]))
        parts[source or ""].append((set(fails), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        steps = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                all_fail = [r for r in rows if f in r[0]]
                steps["".join(order), step] = [len(left), len(gone), len(all_fail) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        share = collections.Counter()
        for (order, step), values in steps.items():
            share[order[step - 1]] += values[1]
        out += [(part, order, step, *values, share[order[step - 1]]) for (order, step), values in steps.items()]
    return out


def test_audit(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, 0, "x"), (3, None, 1, "x"), (None, 1, 1, "x"), (5, 1, None, "x"), (6, 1, 1, None), (999, 1, 1, "x"), (11, 1, 0, "x"), (12, 0, 0, "x")],
        "doc_id int, quality int, toxic int, text string",
    )
    more = spark.createDataFrame([(40 + i, t, None, s, 1) for i, (t, s) in enumerate([
        ("A b c# " * 300, "a"), ("x y " * 200, "b"), (" ".join(f"w{i}" for i in range(250)), "a"), (" ".join(f"w{i}" for i in range(250)), "b"),
        (" ".join(f"W{i}" for i in range(250)), "a"), ("é|" * 300, "ø"), ("AB" + "é" * 98, "a"), ("ABC" + "é" * 97, "a"),
    ])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    got = audit.audit_filters(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = audited(rows, [tuple(r)[:3] for r in labels.collect()])
    same(listed(got), want)
    # Labels carry over from one Arrow batch to the next.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        same(listed(audit.audit_filters(docs, labels)), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert audit.audit_filters(no_docs, labels).count() == 0
    same(listed(audit.audit_filters(docs, labels.limit(0))), audited(rows, []))


def test_union_sizes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(5)]
        marked = [np.unique(rng.integers(0, 60, 20))]
        sizes = audit.union_sizes(lists, marked)
        for chosen in range(32):
            union = set().union(*[set(x.tolist()) for k, x in enumerate(lists) if chosen >> k & 1])
            assert sizes[:, chosen].tolist() == [len(union), len(union & set(marked[0].tolist()))]


# --- spelling variants


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(docs, least=5, ratio=5):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(seed, size):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeÀéÿ×", k=rng.randint(5, 11))) for _ in range(size)]
    bag = []
    for w in base:
        bag += [w] * rng.choice([1, 6, 40, 210])
        for _ in range(5):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            bag += [w[:at] + (rng.choice("abcdeÀéÿ×") if kind else "") + w[at + (kind != 1) :]] * rng.choice([1, 5, 8, 41])
    rng.shuffle(bag)
    cut = max(len(bag) // 20, 1)
    return [(i, rng.choice([" ", "\n", "-1"]).join(bag[i * cut : (i + 1) * cut])) for i in range(21)]


@pytest.mark.parametrize("words_per_index", [40_000, 7])
def test_spelling(spark, monkeypatch, words_per_index):
    # With tiny indexes, common halves are cut into several of them.
    monkeypatch.setattr(spelling, "WORDS_PER_INDEX", words_per_index)
    rows = spelled(4, 60) + [(None, "Straße STRASSE"), (None, None), (3, ""), (5, "abcdefabcdef " * 9), (5, "abcdefabcdef " * 9), (6, "aaaaaa aaaaaaa aaaaaaaa " * 30), (7, "x" * 3000 + " " + "x" * 2999), (8, "chained " * 5 + "chaine " * 30 + "chainex " * 900 + "chainx " * 30 + "thainx " * 5)]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows)
    assert any(r[2] != r[1] for r in want if r[1]) and sum(r[1] is not None for r in want) > 20
    same(listed(got), want)
    same(listed(spelling.spelling_variants(docs, least_count=1)), variants(rows, 1))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_counts_in_pieces(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_AT_ONCE", 3)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    same(listed(spelling.spelling_variants(edge_docs)), variants(rows))
    with pytest.raises(ValueError):
        spelling.spelling_variants(edge_docs, ratio=1)
