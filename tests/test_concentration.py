"""Curves, indices, running totals and resampling against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseweave.operators import concentration, resample, smoothing
from caseweave.operators.running import running_totals

SCHEMA = "s string, u string, c double, p double"


def brute(cases, pops, origin=True, names=None):
    names = names or [str(i) for i in range(len(cases))]
    order = sorted(range(len(cases)), key=lambda i: (-(cases[i] / pops[i]), names[i]))
    c = np.cumsum([cases[i] for i in order]) / sum(cases)
    p = np.cumsum([pops[i] for i in order]) / sum(pops)
    if origin:
        c, p = np.r_[0, c], np.r_[0, p]
    if len(c) < 2:
        return None
    return float(np.sum((p[1:] - p[:-1]) * (c[1:] + c[:-1])) - 1)


def pairwise(cases, pops):
    total = sum(abs(a * q - b * p) for a, p in zip(cases, pops) for b, q in zip(cases, pops))
    return total / (2 * sum(cases) * sum(pops))


def random_units(seed, strata=4, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(strata):
        for i in range(n if s else 4 * n):
            rows.append((f"s{s}", f"u{i:04d}", float(rng.integers(0, 12)) / 2, float(rng.choice([100.0, 250.0, 333.0]))))
    return rows


def by_stratum(rows):
    groups = {}
    for s, u, c, p in rows:
        groups.setdefault(s, []).append((u, c, p))
    return groups


@pytest.mark.parametrize("origin", [True, False])
def test_gini_equals_brute_force(spark, origin):
    rows = random_units(1)
    out = concentration.gini(spark.createDataFrame(rows, SCHEMA), ["s"], "c", "p", ["u"], origin)
    for r in out.collect():
        u, c, p = zip(*by_stratum(rows)[r.s])
        assert r.g == pytest.approx(brute(c, p, origin, u), abs=1e-12)
        if origin:
            assert r.g == pytest.approx(pairwise(c, p), abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 1000)), min_size=1, max_size=12).filter(lambda x: sum(a for a, _ in x) > 0))
def test_gini_properties(spark, pairs):
    c, p = [float(a) for a, _ in pairs], [float(b) for _, b in pairs]
    rows = [("plain", str(i), a, b) for i, (a, b) in enumerate(zip(c, p))]
    rows += [("scaled", str(i), 3 * a, 7 * b) for i, (a, b) in enumerate(zip(c, p))]
    rows += [("equal", str(i), b / 8, b) for i, b in enumerate(p)]
    rows += [("one", str(i), 5.0 if i == 0 else 0.0, b) for i, b in enumerate(p)]
    df = spark.createDataFrame(rows, SCHEMA)
    g = {r.s: r.g for r in concentration.gini(df, ["s"], "c", "p").collect()}
    assert g["plain"] == pytest.approx(pairwise(c, p), abs=1e-9)
    assert g["scaled"] == pytest.approx(g["plain"], abs=1e-9)
    assert g["equal"] == pytest.approx(0, abs=1e-9)
    assert g["one"] == pytest.approx(1 - p[0] / sum(p), abs=1e-9)
    without = {r.s: r.g for r in concentration.gini(df, ["s"], "c", "p", ["u"], origin=False).collect()}
    assert without["plain"] is None or without["plain"] <= g["plain"] + 1e-12


def test_degenerate_strata(spark):
    rows = [("single", "u", 3.0, 10.0), ("zero", "u", 0.0, 10.0), ("zero", "v", 0.0, 5.0),
            ("unknown", "u", 1.0, None), ("unknown", "v", 1.0, 5.0), ("nobody", "u", 1.0, 0.0), ("nobody", "v", 1.0, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    g = {r.s: r.g for r in concentration.gini(df, ["s"], "c", "p", ["u"]).collect()}
    assert g["single"] == pytest.approx(0) and g["zero"] is None and g["unknown"] is None
    assert g["nobody"] == pytest.approx(0.5)
    without = {r.s: r.g for r in concentration.gini(df, ["s"], "c", "p", ["u"], origin=False).collect()}
    assert without["single"] is None
    shares = concentration.lorenz(df, ["s"], "c", "p", ["u"], origin=False)
    assert {r.s for r in shares.collect() if r.c_i is None} == {"zero", "unknown"}


def test_percent_is_rounded_before_scaling(spark):
    out = spark.createDataFrame([(0.12345,)], "g double").select(concentration.as_percent("g").alias("o")).first()
    assert out.o == pytest.approx(12.3)


@pytest.mark.parametrize("strata", [["s"], []])
def test_blocked_running_totals_equal_one_window(spark, strata):
    rows = random_units(2) + [(None, f"n{i}", 1.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("c").desc(), F.col("s").asc(), F.col("u").asc()]
    one, blocked = (
        {(r.s, r.u): (r.run, r.whole) for r in running_totals(
            df, strata, order, {"run": F.col("p")}, {"whole": F.lit(1)}, block_rows=size).collect()}
        for size in (10_000, 17)
    )
    assert len(one) == len(rows) and one == blocked


def test_lorenz_blocks_ties_and_origin(spark):
    rows = random_units(3)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = concentration.lorenz(df, ["s"], "c", "p", ["u"])
    blocked = concentration.lorenz(df, ["s"], "c", "p", ["u"], block_rows=11)
    key = lambda r: (r.s, r.u)
    a, b = ({key(r): (r.c_i, r.p_i) for r in d.collect()} for d in (plain, blocked))
    assert a.keys() == b.keys() and a[("s0", None)] == (0.0, 0.0)
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)
    # Ties advance row by row: no two units of a stratum share a population share.
    points = [v[1] for k, v in a.items() if k[0] == "s1"]
    assert len(set(points)) == len(points)


def test_pareto_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"y{i % 2}", None if u == 7 else f"u{u}") for i, u in enumerate(rng.zipf(1.5, 3000) % 200)]
    df = spark.createDataFrame([(y, u) for y, u in rows], "y string, u string")
    for strata in (["y"], []):
        a = concentration.pareto(df, "u", strata).orderBy(*strata, "cumsum").collect()
        b = concentration.pareto(df, "u", strata, block_rows=9).orderBy(*strata, "cumsum").collect()
        assert a == b
        assert max(r.cumprop for r in a) == pytest.approx(100.0)
        assert sum(r.n for r in a) == 3000


def boot(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return resample.bootstrap_gini(df, ["s"], "c", "p", ["u"], replicates=20, **options)


def xxh64(value, seed):
    import struct

    import xxhash
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed)


def word(*values):
    h = 42
    for value in values:
        h = xxh64(value, h)
    return h


def binomial(key, count, left, size, node):
    """The splitting of draws as stated: bits of a uniform number against those of left / size."""
    if left >= size or left <= 0:
        return count if left >= size else 0
    u, s, r = count, 0, left
    for j in range(1, 64):
        bits = [word(key, node, j, i) & (2**64 - 1 if i < u // 64 else 2 ** (u % 64) - 1) for i in range(u // 64 + 1)]
        k = sum(b.bit_count() for b in bits)
        u, s, r = (u - k, s + k, 2 * r - size) if 2 * r >= size else (k, s, 2 * r)
    return s


def drawn_units(stratum, rep, n, block_units, seed=13):
    """Numbers of the units that a replicate draws."""
    import hashlib
    key = int(hashlib.md5(f"{seed}|{stratum}|{rep}".encode()).hexdigest()[:15], 16)
    blocks = -(-n // block_units)
    counts, depth = [n], (blocks - 1).bit_length()
    for t in range(depth):
        width, out = 1 << (depth - t), []
        for q, c in enumerate(counts):
            low, mid, high = (min(n, int(x * block_units)) for x in (q * width, q * width + width // 2, (q + 1) * width))
            k = binomial(key, c, mid - low, high - low, (1 << t) + q) if high > low else 0
            out += [k, c - k] if high > low else [0, 0]
        counts = out
    picks = []
    for b, m in enumerate(counts):
        size = min(block_units, n - b * block_units)
        picks += [b * block_units + (word(key, (b << 32) + d) >> 1) % size for d in range(m)]
    return picks


@pytest.mark.parametrize("origin", [True, False])
@pytest.mark.parametrize("block_units", [4096, 16, 7])
def test_bootstrap_equals_brute_force_splitting(spark, origin, block_units):
    rows = random_units(4, strata=3, n=30)
    got = {(r.s, r.rep): r.g for r in boot(spark, rows, origin=origin, block_units=block_units).collect()}
    assert len(got) == 60
    for s, group in by_stratum(rows).items():
        ranked = sorted(group, key=lambda x: (-(x[1] / x[2]), x[0]))
        for rep in range(20):
            picks = drawn_units(s, rep, len(ranked), block_units)
            assert len(picks) == len(ranked)
            names = [f"{i:05d}" for i in sorted(picks)]
            c, p = ([ranked[i][k] for i in sorted(picks)] for k in (1, 2))
            assert got[(s, rep)] == pytest.approx(brute(c, p, origin, names), abs=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = {(r.s, r.rep): r.g for r in boot(spark, rows, origin=origin, block_units=block_units).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == pytest.approx(got, abs=1e-12)


def test_split_counts_have_the_shares_of_their_blocks(spark):
    """Mean and variance of the draws a block gets, against the binomial ones."""
    rows = spark.range(4000).select(F.xxhash64("id").alias("_key"), F.lit(1000).cast("long").alias("n"), F.lit(7).alias("b"))
    counts = np.array([r[0] for r in rows.select(resample.block_counts("n", "b", 150)).collect()])
    assert (counts.sum(1) == 1000).all() and (counts[:, 7:] == 0).all()
    share = np.array([150] * 6 + [100]) / 1000
    error = np.sqrt(1000 * share * (1 - share) / 4000)
    assert (np.abs(counts.mean(0)[:7] - 1000 * share) < 4.5 * error).all()
    assert np.allclose(counts.var(0)[:7], 1000 * share * (1 - share), rtol=0.12)


def test_bootstrap_has_no_row_for_a_draw(spark):
    rows = random_units(4, strata=2, n=40)
    plan = boot(spark, rows)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and plan.count("Generate explode") <= 2 * 3


def test_bootstrap_without_broadcast(spark, monkeypatch):
    rows = random_units(6, strata=2, n=20)
    expected = {(r.s, r.rep): r.g for r in boot(spark, rows).collect()}
    monkeypatch.setattr(resample, "BROADCAST_UNITS", 0)
    assert {(r.s, r.rep): r.g for r in boot(spark, rows).collect()} == pytest.approx(expected, abs=1e-12)


def test_bootstrap_of_unknown_values_and_single_units(spark):
    rows = [("one", "u", 3.0, 10.0), ("zero", "u", 0.0, 10.0), ("zero", "v", 0.0, 5.0), ("unknown", "u", None, 5.0), (None, "u", 1.0, 5.0), (None, "v", 4.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for origin in (True, False):
        out = resample.bootstrap_gini(df, ["s"], "c", "p", ["u"], replicates=9, origin=origin).collect()
        g = {s: [r.g for r in out if r.s == s] for s in ("one", "zero", "unknown", None)}
        assert all(len(v) == 9 for v in g.values()) and set(g["zero"]) == {None} == set(g["unknown"])
        assert g["one"] == [pytest.approx(0) if origin else None] * 9
        assert all(x is not None for x in g[None])


def test_bootstrap_equals_brute_force_draws(spark):
    rows = random_units(7, strata=2, n=15)
    out = {(r.s, r.rep): r.g for r in boot(spark, rows, draw=resample.digest_draw).collect()}
    import hashlib
    for s, group in by_stratum(rows).items():
        ranked = sorted(group, key=lambda x: (-(x[1] / x[2]), x[0]))
        for rep in (0, 7, 19):
            picks = [int(hashlib.md5(f"13|{s}|{rep}|{d}".encode()).hexdigest()[:8], 16) % len(ranked) for d in range(len(ranked))]
            c, p = [ranked[i][1] for i in picks], [ranked[i][2] for i in picks]
            assert out[(s, rep)] == pytest.approx(brute(c, p), abs=1e-12)


def test_digests_are_made_for_whole_blocks():
    """Of texts of any length, with places and replicates of one to eleven digits, in one or two blocks of MD5."""
    import hashlib
    rep, place = np.array([0, 9, 10, 255, 1000, 9999]), np.array([*range(120), 9_999, 10_000, 9_999_999_999, (3 << 32) - 1, 3 << 32])
    for text in ("", "13|2019|Papua|P. falciparum", "é" * 40, *["z" * k for k in range(30, 70)]):
        got = resample.digest_draw(text.encode(), place)(rep, rep, slice(5, len(place)))
        want = [[int(hashlib.md5(f"{text}|{r}|{p}".encode()).hexdigest()[:8], 16) for p in place[5:]] for r in rep]
        assert got.tolist() == want


def test_draws_are_arrays_of_a_block_and_many_replicates(spark):
    """No expression is evaluated for a draw: replicates of a block are one row of work."""
    rows = random_units(9, strata=2, n=30)
    for draw in (resample.hashed_draw, resample.digest_draw):
        plan = boot(spark, rows, draw=draw, block_units=7)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "collect_list" in plan and "sort_array" not in plan


@pytest.mark.parametrize("origin", [True, False])
def test_digest_draws_of_many_blocks_equal_brute_force(spark, monkeypatch, origin):
    import hashlib
    rows = [(s, u, None if (s, u) == ("s1", "u0003") else c, p) for s, u, c, p in random_units(9, strata=2, n=8)]
    monkeypatch.setattr(resample, "REPLICATES_PER_COPY", 6)
    options = {"draw": resample.digest_draw, "block_units": 7, "origin": origin}
    got = {(r.s, r.rep): r.g for r in boot(spark, rows, **options).collect()}
    monkeypatch.setattr(resample, "BROADCAST_UNITS", 0)
    assert {(r.s, r.rep): r.g for r in boot(spark, rows, **options).collect()} == pytest.approx(got, abs=1e-12)
    for s, group in by_stratum(rows).items():
        ranked = sorted(group, key=lambda x: (x[1] is None, -((x[1] or 0) / x[2]), x[0]))
        for rep in range(20):
            picks = []
            for b, m in enumerate(np.bincount([u // 7 for u in drawn_units(s, rep, len(ranked), 7)])):
                size = min(7, len(ranked) - 7 * b)
                picks += [7 * b + int(hashlib.md5(f"13|{s}|{rep}|{(b << 32) + d}".encode()).hexdigest()[:8], 16) % size for d in range(m)]
            c, p = ([ranked[i][k] for i in sorted(picks)] for k in (1, 2))
            want = None if None in c else brute(c, p, origin, [f"{i:05d}" for i in sorted(picks)])
            assert got[(s, rep)] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert len(got) == 40 and None in got.values() and set(map(type, got.values())) == {float, type(None)}


def test_sums_of_a_block_and_its_first_unit_equal_a_loop(monkeypatch):
    """Replicates with unequal numbers of draws, pieces of a few draws, an unknown unit; the first unit is what is left out without origin."""
    import pyarrow as pa
    from caseweave.operators import draws
    cases, people = [5.0, 3.0, None, 0.0, 1.5], [2.0, 7.0, 4.0, None, 1.0]
    times = [1, 4, 2, 9, 30, 3]
    struct = pa.struct([("rep", pa.int32()), ("_key", pa.int64()), ("_m", pa.int64())])
    work = [{"rep": 8 + i, "_key": 0, "_m": m} for i, m in enumerate(times)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None, "a"]), pa.array([0, 3]), pa.array(["13", "13|a"]), pa.array([work, work], pa.list_(struct)), pa.array([cases] * 2), pa.array([people] * 2)],
        ["s", "_block", "_text", "_draws", "_cs", "_ps"],
    )
    results = []
    for chunk in (draws.CHUNK, 4):
        monkeypatch.setattr(draws, "CHUNK", chunk)
        results.append([row for out in draws.block_sums([batch], draws.digest_draw, ["s"]) for row in out.to_pylist()])
    assert results[0] == results[1] and len(results[0]) == 12
    for row in results[0]:
        text = "13" if row["s"] is None else "13|a"
        place = (row["_block"] << 32) + np.arange(row["_m"])
        picks = np.sort(draws.digest_draw(text.encode(), place)(np.array([row["rep"]]), None, slice(0, row["_m"]))[0] % 5).tolist()
        c, p = ([values[i] for i in picks] for values in (cases, people))
        assert (row["_fc"], row["_fp"]) == (c[0], p[0])
        assert row["_c"] == (None if None in c else sum(c)) and row["_p"] == (None if None in p else sum(p))
        known = None not in c + p
        assert row["_a"] == (sum(p[i] * (2 * sum(c[:i]) + c[i]) for i in range(len(c))) if known else None)
    assert any(row["_a"] is not None and row["_m"] > 1 for row in results[0])


def test_interval_brackets_the_median(spark):
    rows = random_units(8, strata=2, n=40)
    reps = boot(spark, rows)
    ends = resample.percentile_interval(reps, ["s"], "g").collect()
    g = {}
    for r in reps.collect():
        g.setdefault(r.s, []).append(r.g)
    for r in ends:
        assert r.lci == pytest.approx(100 * np.quantile(g[r.s], 0.025))
        assert r.uci == pytest.approx(100 * np.quantile(g[r.s], 0.975))


def test_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(9)
    values = [float(v) for v in rng.normal(0.5, 0.05, 500)] + [1.7, -0.2]
    df = spark.createDataFrame([("s", v) for v in values], "s string, v double")
    out = smoothing.density(df, ["s"], "v").orderBy("x").collect()
    assert len(out) == 512
    kept = np.array([v for v in values if 0 <= v <= 1])
    bw = 0.9 * min(np.std(kept, ddof=1), (np.quantile(kept, 0.75) - np.quantile(kept, 0.25)) / 1.34) * len(kept) ** -0.2
    below = np.floor(kept * 2047)
    share = kept * 2047 - below
    for row in out[150:350:20]:
        def kernel(v):
            return np.exp(-0.5 * ((row.x - v) / bw) ** 2) / (bw * np.sqrt(2 * np.pi))
        binned = np.mean((1 - share) * kernel(below / 2047) + share * kernel((below + 1) / 2047))
        assert row.density == pytest.approx(binned, rel=1e-9)
        assert row.density == pytest.approx(np.mean(kernel(kept)), rel=1e-3, abs=1e-3)
    assert sum(r.density for r in out) / 511 == pytest.approx(1, abs=0.01)


def test_local_fit_reproduces_a_parabola(spark):
    x = np.logspace(0, 2, 40)
    rows = [("s", float(v), float(0.1 + 0.05 * np.log10(v) + 0.1 * np.log10(v) ** 2)) for v in x] + [("s", 1e6, 0.5), ("s", 5.0, 2.0)]
    out = smoothing.local_fit(spark.createDataFrame(rows, "s string, x double, y double"), ["s"], "x", "y").collect()
    assert len(out) == 80
    for r in out:
        assert r.fit == pytest.approx(0.1 + 0.05 * r.log10_x + 0.1 * r.log10_x**2, abs=1e-8)


def test_line_fit_and_band(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(0.5, 200, 30)
    y = np.clip(0.3 + 0.1 * np.log10(x) + rng.normal(0, 0.02, 30), 0, 1)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "s string, x double, y double")
    out = smoothing.line_fit(df, ["s"], "x", "y").orderBy("log10_x").collect()
    lx = np.log10(x)
    slope, intercept = np.polyfit(lx, y, 1)
    sigma = np.sqrt(np.sum((y - intercept - slope * lx) ** 2) / 28)
    r = out[10]
    half = 2.048407 * sigma * np.sqrt(1 / 30 + (r.log10_x - lx.mean()) ** 2 / np.sum((lx - lx.mean()) ** 2))
    assert r.slope == pytest.approx(slope) and r.fit == pytest.approx(intercept + slope * r.log10_x)
    assert r.upper - r.fit == pytest.approx(half, rel=1e-5)


@pytest.mark.parametrize("degrees,expected", [(1, 12.7062), (2, 4.3027), (5, 2.5706), (30, 2.0423), (120, 1.9799), (500, 1.9647)])
def test_t_quantile(spark, degrees, expected):
    out = spark.createDataFrame([(float(degrees),)], "d double").select(smoothing.t_975(F.col("d")).alias("t")).first().t
    assert out == pytest.approx(expected, abs=1e-4)


def test_blocks_of_unknown_values_equal_one_window(spark):
    """NULLs at the start, whole blocks of NULLs, ties and a NULL stratum: the block path gives the window's totals."""
    rows = [("a", i, None if i < 9 or 20 <= i < 31 else float(i % 4)) for i in range(40)]
    rows += [(None, i, None if i % 3 else 1.0) for i in range(15)] + [("b", i, None) for i in range(10)]
    df = spark.createDataFrame(rows, "s string, u int, v double")
    order = [F.col("u").asc()]
    one, blocked = (
        {(r.s, r.u): (r.run, r.whole) for r in running_totals(
            df, ["s"], order, {"run": F.col("v")}, {"whole": F.col("v")}, block_rows=size).collect()}
        for size in (1000, 4)
    )
    assert len(one) == len(rows) and one == blocked
    assert one["a", 8] == (None, sum(v for s, _, v in rows if s == "a" and v is not None))


def test_density_width_comes_from_values_as_they_are(spark):
    values = [0.5 + 1e-7 * k for k in range(20)]
    df = spark.createDataFrame([("s", v) for v in values], "s string, v double")
    peak = max(r.density for r in smoothing.density(df, ["s"], "v", limits=(0.499999, 0.500003)).collect())
    bw = 0.9 * min(np.std(values, ddof=1), (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.34) * 20**-0.2
    grid = np.linspace(0.499999, 0.500003, 512)
    exact = np.exp(-0.5 * ((grid[:, None] - values) / bw) ** 2).mean(axis=1) / (bw * np.sqrt(2 * np.pi))
    assert peak == pytest.approx(exact.max(), rel=1e-2)


def test_t_quantile_where_the_expansion_takes_over(spark):
    rows = spark.range(190, 230).select("id", smoothing.t_975(F.col("id").cast("double")).alias("t")).collect()
    # The expansion is within 1e-8 of the exact quantile from 200 degrees on.
    assert all(abs(r.t - smoothing.t_quantile(r.id)) < 1e-8 for r in rows)
    # Published table values.
    assert [round(smoothing.t_quantile(d), 3) for d in (1, 5, 10, 30, 120)] == [12.706, 2.571, 2.228, 2.042, 1.980]
