"""Limits that must not change results: languages, hot keys, names of columns, stored tables, and the pipeline on edge cases."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseweave.llm import decontaminate, exact, langid, minhash, mixing, shared, substrings
from conftest import words

SYLLABLES = {"ww": ["ka", "lo", "mi"], "xx": ["str", "ung", "ör"], "yy": ["eau", "éc", "chi"], "zz": ["wy", "prz", "szo"]}


def phrases(seed, syllables, n=40):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(syllables, 4)) for _ in range(n))


@pytest.mark.parametrize("languages", [2, 3, 4])
def test_strangers_are_rejected_whatever_the_number_of_languages(spark, languages):
    rows = [(i, phrases(i, SYLLABLES[a]), a) for i, a in enumerate(list(SYLLABLES)[:languages] * 15)]
    strange = [(1000, "привет мир " * 30, None), (1001, "東京都 大阪府 " * 30, None), (1002, "3f0a 9bcd 77qx vvqj " * 30, None), (1003, "12 34", None), (1004, None, None)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.identified_only(docs, corpus_pipeline.LEAST_MARGIN).collect()}
    assert kept == {r[0] for r in rows}


def test_one_language_keeps_what_has_a_letter(spark):
    docs = spark.createDataFrame([(i, phrases(i, SYLLABLES["ww"]), "ww") for i in range(9)] + [(99, "12", "ww")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.identified_only(docs, 0.15).collect()} == set(range(9))


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 9)
    monkeypatch.setattr(langid, "LANDMARKS", 6)
    rows = [(i, phrases(i, SYLLABLES[a]), a) for i, a in enumerate(["ww", "xx", "yy"] * 12)] + [(500 + i, phrases(i, SYLLABLES["zz"]), f"junk{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["ww", "xx", "yy"] and len(model.landmarks) == 6
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert all(found[i] == a for i, _, a in rows[:36])


def test_kernel_ridge_equals_the_dense_one(spark):
    """With all texts as landmarks, the Nyström form is ridge regression on features whose products are the kernel."""
    texts = [phrases(i, SYLLABLES[a], 12) for i, a in enumerate(list(SYLLABLES) * 6)]
    labels = list(SYLLABLES) * 6
    grams = [{t.lower()[i : i + k] if t.lower()[i : i + k].isalpha() else "".join(c if c.isalpha() else " " for c in t.lower()[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1)} for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    found = langid.presence(texts)
    model = langid.fit(found, labels, per_language=6)
    order = np.concatenate([np.flatnonzero(np.array(labels) == a) for a in SYLLABLES])
    dense = model.kernel(found).astype(float)[:, np.argsort(order)]
    assert np.allclose(dense, kernel, atol=0.02)  # hashed n-grams may share a bucket
    n, target = len(texts), np.where(np.array(labels)[:, None] == np.array(list(SYLLABLES)), 1.0, -1.0)
    # Dual form with a free intercept: alpha sums to 0 for each language.
    system = np.block([[dense + langid.RIDGE * n * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([target, np.zeros((1, 4))]))
    assert np.allclose(dense @ solved[:-1] + solved[-1], model.scores(found), atol=5e-3)


def test_mixture_equals_plain_python(spark):
    """Blocks, multinomial counts and permutations again, word by word."""
    rows = [(i, words(i, 20 + 7 * (i % 9)), "abc"[i % 3]) for i in range(40)] + [(99, None, "a"), (98, "", None), (97, words(97, 33), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = mixing.mix_sources(docs, block_words=16, shard_slots=4)
    pieces = [r.asDict() for r in mixture.pieces.collect()]
    got = {r.doc_id: r.taken for r in mixing.taken_words(mixture).collect()}
    sources = sorted({s for _, _, s in rows if s}) + [None]
    size = {i: len((t or "").split()) for i, t, _ in rows}
    totals = [sum(size[i] for i, _, s in rows if s == name) for name in sources]
    targets = mixing.capped_targets(totals, [1.0, 2.0, 3.0, 1.0], 3)
    assert sum(targets) == pytest.approx(min(sum(totals), 3 * sum(totals)))
    taken = collections.Counter()
    for number, name in enumerate(sources):
        ids = sorted(i for i, _, s in rows if s == name and size[i])
        order = [(i, k) for i in ids for k in range(size[i])]
        blocks = -(-len(order) // 16)
        slots = min(round(targets[number] * blocks / totals[number]), 3 * blocks)
        for j in range(slots):
            turn = j // blocks
            key = mixing.SEED + 1_000_003 * number + 7_919 * turn
            block = int(mixing.permuted(np.array([j % blocks]), blocks, key)[0])
            for i, _ in order[16 * block : 16 * block + 16]:
                taken[i] += 1
        for turn in range(-(-slots // blocks)):
            key = mixing.SEED + 1_000_003 * number + 7_919 * turn
            assert sorted(mixing.permuted(np.arange(blocks), blocks, key).tolist()) == list(range(blocks))
    assert got == {i: taken[i] for i, _, _ in rows}
    # The slots of a source are dealt to shards without a gap.
    for number in {p["source_no"] for p in pieces}:
        slots = {(p["slot"], p["shard"]) for p in pieces if p["source_no"] == number}
        assert [s for s, _ in sorted(slots)] == list(range(len(slots)))


def test_mixture_gathers_neither_blocks_nor_documents_on_the_driver(spark, monkeypatch):
    """Rows of a source are broadcast to documents, draws and slots, never those to them; slots meet blocks by a shuffle."""
    docs = spark.createDataFrame([(i, words(i, 200), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    ran, store = [], mixing.store
    monkeypatch.setattr(mixing, "store", lambda df, name: ran.append(df) or store(df, name))
    ran.append(mixing.mix_sources(docs, block_words=8, shard_slots=64).pieces)
    plans = []
    for df in ran:
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
    # Rows meet the totals of their range by (_range, source_no); of a few rows and totals, either side may be smaller.
    assert not [line for plan in plans for line in plan.splitlines() if "BuildLeft" in line and "_range#" not in line]
    assert re.search(r"SortMergeJoin.*\[source_no#\d+L?, block#", plans[-1]) and not re.search(r"HashJoin.*block#", plans[-1])


def test_mixture_stage_joins_slots_and_blocks_by_a_shuffle(spark):
    docs = spark.createDataFrame([(i, words(i, 200), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    plan = corpus_pipeline.mixture(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin.*\[source_no#\d+L?, block#", plan) and not re.search(r"HashJoin.*block#", plan)


def test_hot_groups_of_exact_copies(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows}


def test_join_groups_deals_hot_and_other_keys_alike(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 700}", None) for i in range(4000)] + [(9, None, None)], "i int, k string, x string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least")).filter("k is not null and n > 3")
    got = shared.join_groups(rows, groups, "k", "n").select("i", "k", "n", "least")
    want = rows.join(groups, "k", "left").select("i", "k", "n", "least")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 4001


@pytest.mark.parametrize("kind", ["long", "int", "short", "string"])
def test_items_with_ids_of_any_type_and_copies(spark, kind):
    item = words(3, 30)
    docs = spark.createDataFrame([(1, words(9, 50) + " " + item), (2, words(8, 40))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (7, item), (9, words(4, 20))], "item_id int, text string").select(F.col("item_id").cast(kind).alias("item_id"), "text")
    found = decontaminate.contained_items(docs, items, limit=10)
    assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert sorted((r.doc_id, int(r.item_id), r.shared) for r in found.collect()) == [(1, 7, 26), (1, 7, 26), (1, 8, 26)]


def test_full_windows_have_two_hashes(spark):
    docs = spark.createDataFrame([(1, words(1, 80)), (2, words(2, 30) + " " + " ".join(words(1, 80).split()[10:60]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.without_repeated_windows(docs).collect()} == {1: 50, 2: 50}


def test_internal_names_do_not_clash(spark):
    rows = [(1, words(1, 40), "a", "k1", "x"), (2, words(1, 40), "a", "k2", "y"), (3, words(2, 40), "b", "k3", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, taken string")
    docs = docs.withColumns({name: F.col("row") for name in ("__row", "__taken", "__key", "__id", "__of", "key", "id", "of", "turn")})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and all(r.row == r["__row"] == r["__key"] == f"k{r.doc_id}" for r in mixed.collect())
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r["__key"], r["of"]) for r in left.collect()) == [(1, "k1", "k1"), (3, "k3", "k3")]


def test_scratch_removes_folders_and_tables(spark):
    from pathlib import Path
    before = {t.name for t in spark.catalog.listTables()}
    with shared.scratch(spark) as folder:
        docs = spark.createDataFrame([(1, words(1, 80)), (2, words(1, 80))], "doc_id long, text string")
        assert substrings.without_repeated_windows(docs).count() == 2
        assert {t.name for t in spark.catalog.listTables()} > before
        place = Path(folder.removeprefix("file:"))
        assert place.is_dir()
    assert {t.name for t in spark.catalog.listTables()} == before and not place.exists()


def test_pipeline_on_empty_repeated_and_clashing_input(spark, tmp_path, monkeypatch):
    fields = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, offset string, __row string"
    texts = {i: (phrases(i, SYLLABLES[a]), a) for i, a in enumerate(list(SYLLABLES) * 8)}
    rows = [(i, t, a, "s", len(t), "k", "c", "o", "r") for i, (t, a) in texts.items()]
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None, None), (50, "", "ww", None, 0, "k", None, "o", "r"), (51, "ka" * 50_000, "ww", "long", 1, "k", "c", "o", "r")]
    item = spark.createDataFrame([(1, words(5, 30)), (2, None)], "item_id long, text string")
    for name, some in (("full", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, fields).write.parquet(f"{folder}/documents.parquet")
        item.write.parquet(f"{folder}/benchmark.parquet")
        monkeypatch.setattr(corpus_pipeline, "shared_path", lambda spark, stage, folder=folder: f"{folder}/{stage}")
        out = corpus_pipeline.run(spark, folder)
        assert [f.split()[0] for f in fields.split(", ")] == spark.read.parquet(f"{folder}/pipeline-mixture").columns
        if name == "empty":
            assert out.count() == 0
            continue
        for stage in ("language", "near_duplicates", "decontamination"):
            ids = sorted(r.doc_id for r in spark.read.parquet(f"{folder}/pipeline-{stage}").collect())
            assert set(ids) == {*texts, 51} and (stage == "language") == (len(ids) != len(set(ids)))
        assert {r.doc_id for r in out.collect()} <= {*texts, 51} and out.count() > 10
