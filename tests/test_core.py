import math
import random
from collections import Counter
from functools import reduce
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import hashing, prefix, sizing
from tallyweave.functions.sizing import Grid
from tallyweave.operators import counters, exact, experiments, linear, metrics, sampling
from tallyweave.sources import files, pageviews, reports, streams, synthetic

ROWS = [("a", 2), ("b", 5), ("c", 1), ("d", 4), ("a", 3)]
ODD = ['comma, "quoted"', "back\\slash", "", "日本語", "naïve", "x" * 300]


def make(spark, rows):
    return spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(rows)], "key string, weight long, ord long")


def counted(spark, rows):
    return exact.frequencies(make(spark, rows))


def as_dict(df, key="key", value="estimate"):
    return {r[key]: r[value] for r in df.collect()}


# --- exact ------------------------------------------------------------------------------


def test_frequencies_top_and_heavy(spark):
    rows = ROWS + [(k, 1) for k in ODD]
    c = counted(spark, rows)
    assert as_dict(c, value="total") == {"a": 5, "b": 5, "c": 1, "d": 4} | {k: 1 for k in ODD}
    assert [r["key"] for r in exact.top_k(c, 3).collect()] == ["a", "b", "d"]
    assert as_dict(exact.heavy_hitters(c, 0.2), value="total") == {"a": 5, "b": 5}  # ceil(0.2 * 21) = 5


def test_empty_stream(spark):
    c = exact.frequencies(spark.createDataFrame([], "key string, weight long, ord long"))
    assert exact.total_weight(c).first()["n"] == 0
    assert exact.heavy_hitters(c, 0.1).count() == 0
    assert linear.count_min(c, Grid(2, 8)).count() == 0
    assert counters.misra_gries_offline(c, 3).count() == 0


def test_streams_leave_out_nulls_and_refuse_negative_weights(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "k string, w double")
    assert [tuple(r) for r in streams.stream(df, F.col("k"), F.col("w")).collect()] == [("a", 1, 0)]
    bad = spark.createDataFrame([("a", -1)], "k string, w long")
    with pytest.raises(Exception, match="negative weight"):
        streams.stream(bad, F.col("k"), F.col("w")).collect()


def test_diagnose(spark):
    true = spark.createDataFrame([("a", 5), ("x", 9), ("c", 4)], "key string, total long")
    found = {r["key"]: r["state"] for r in exact.diagnose(true, counted(spark, ROWS), 0.2).collect()}
    assert found == {"a": "heavy", "x": "never", "c": "below"}


def test_prefix_sums_equal_a_plain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ord long, v long").withColumn("r", F.shiftright("ord", 4))
    found = {r["ord"]: r["before"] for r in prefix.prefix_sums(df, ["k"], "r", ["ord"], "v", "before").collect()}
    sums = Counter()
    for k, i, v in rows:
        assert found[i] == sums[k]
        sums[k] += v


# --- linear sketches -----------------------------------------------------------------------


def test_count_min_never_below_and_merges_without_loss(spark):
    rng = random.Random(1)
    rows = [(f"k{int(rng.paretovariate(1))}", rng.randrange(5)) for _ in range(800)] + [(k, 3) for k in ODD]
    grid = Grid(3, 64)
    c = counted(spark, rows)
    cells = linear.count_min(c, grid)
    true, found = as_dict(c, value="total"), as_dict(linear.count_min_estimates(c, cells, grid))
    assert found.keys() == true.keys() and all(found[k] >= true[k] for k in true)
    halves = [linear.count_min(counted(spark, part), grid) for part in (rows[:300], rows[300:])]
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(linear.merge(*halves)) == order(cells) == order(linear.merge(*halves[::-1]))
    unseen = spark.createDataFrame([("never",)], "key string")
    assert linear.count_min_estimates(unseen, cells, grid).first()["estimate"] >= 0


@pytest.mark.parametrize("rows,f2", [([("a", 2), ("b", 5), ("c", 1)], 30), ([("A", 50), ("B", 30), ("C", 20)], 3800)])
def test_second_moment_of_small_streams(spark, rows, f2):
    c = counted(spark, rows)
    wide = linear.second_moment(linear.count_sketch(c, Grid(7, 4096))).first()["f2"]
    assert abs(wide - f2) <= 0.1 * f2
    state = linear.ams(c, Grid(5, 400))
    assert abs(linear.ams_second_moment(state, Grid(5, 400)).first()["f2"] - f2) <= 0.3 * f2


def test_count_sketch_split_merges_to_whole_and_drops_zero_cells(spark):
    grid = Grid(5, 32)
    whole = linear.count_sketch(counted(spark, ROWS), grid)
    parts = [linear.count_sketch(counted(spark, ROWS[:3]), grid), linear.count_sketch(counted(spark, ROWS[3:]), grid)]
    assert sorted(map(tuple, linear.merge(*parts).filter("cell <> 0").collect())) == sorted(map(tuple, whole.collect()))
    assert whole.filter("cell = 0").count() == 0


def test_ams_merge_repeat_and_estimates(spark):
    grid = Grid(5, 64)
    whole = linear.ams(counted(spark, ROWS), grid)
    split = linear.merge_ams(linear.ams(counted(spark, ROWS[:3]), grid), linear.ams(counted(spark, ROWS[3:]), grid))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    one = linear.ams(counted(spark, [("wiki", 3), ("wiki", 5)]), grid)
    assert {abs(r["x"]) for r in one.collect()} == {8}
    assert linear.ams_estimates(counted(spark, [("wiki", 8)]), one, grid).first()["estimate"] == 8


def test_signs_are_balanced_and_independent(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    signs = df.select(*(hashing.sign(hashing.hash_pair(F.lit(r), F.col("key"), family)["lo"]).alias(f"s{family}{r}") for r in (0, 1) for family in hashing.FAMILIES))
    means = signs.agg(*(F.avg(c) for c in signs.columns), F.avg(F.col("sportable0") * F.col("sportable1")), F.avg(F.col("snative0") * F.col("snative1"))).first()
    assert all(abs(m) < 0.06 for m in means)
    with pytest.raises(ValueError):
        hashing.hash_pair(F.lit(0), F.lit("a"), "other")


def test_candidate_pool_has_every_heavy_hitter(spark):
    rng = random.Random(5)
    stream = make(spark, [(f"k{int(rng.paretovariate(0.9))}", 1) for _ in range(500)])
    true = {r["key"] for r in exact.heavy_hitters(exact.frequencies(stream), 0.02).collect()}
    pool = {r["key"] for r in linear.candidate_pool(stream, Grid(3, 128), 0.02, shift=4).collect()}
    assert true <= pool


def test_upper_median(spark):
    values = spark.createDataFrame([([3, 1, 2, 4],), ([5, 9, 1],)], "v array<long>")
    assert [r[0] for r in values.select(linear.upper_median(F.col("v"))).collect()] == [3, 5]


# --- counters --------------------------------------------------------------------------------


def slow_misra_gries(rows, capacity):
    state = {}
    for key, left in rows:
        while left:
            if key in state or len(state) < capacity:
                state[key] = state.get(key, 0) + left
                break
            step = min(left, min(state.values()))
            state = {k: v - step for k, v in state.items() if v > step}
            left -= step
    return state


def slow_space_saving(rows, capacity):
    state = {}
    for key, w in rows:
        if not w:
            continue
        if key in state:
            state[key] = (state[key][0] + w, state[key][1])
        elif len(state) < capacity:
            state[key] = (w, 0)
        else:
            old = min(state, key=lambda k: (state[k][0], k))
            least = state.pop(old)[0]
            state[key] = (least + w, least)
    return state


def feed(summary, rows):
    for k, w in rows:
        summary.update(k, w)
    return {k: (e, x) for k, e, x in summary.entries()}


def test_hand_traces():
    assert feed(counters.MisraGries(2), [("a", 5), ("b", 3), ("c", 4)]) == {"a": (2, 0), "c": (1, 0)}
    assert feed(counters.SpaceSaving(2), [("a", 5), ("b", 3), ("c", 4)]) == {"a": (5, 0), "c": (7, 3)}
    assert feed(counters.LossyCounting(4), [("a", 1), ("b", 1), ("c", 1), ("d", 2)]) == {"d": (2, 0)}


@pytest.mark.parametrize("seed", range(60))
def test_folds_equal_plain_ones_and_keep_their_bounds(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefghij"), rng.randrange(6)) for _ in range(rng.randrange(1, 120))]
    true, n, m = Counter(), 0, rng.randrange(1, 6)
    for k, w in rows:
        true[k] += w
        n += w
    mg = {k: e for k, (e, _) in feed(counters.MisraGries(m), rows).items()}
    assert mg == slow_misra_gries(rows, m) and len(mg) <= m
    assert all(true[k] - n / (m + 1) <= mg.get(k, 0) <= true[k] for k in true)
    ss = feed(counters.SpaceSaving(m), rows)
    assert ss == slow_space_saving(rows, m)
    assert all(e - x <= true[k] <= e <= true[k] + n / m for k, (e, x) in ss.items())
    lc = feed(counters.LossyCounting(m), rows)
    assert all(true[k] - n / m <= lc.get(k, (0, 0))[0] <= true[k] for k in true)


@pytest.mark.parametrize("seed", range(40))
def test_blocks_keep_their_bounds(seed):
    """Whatever the blocks: estimates lie within the bounds that a summary states."""
    rng = random.Random(seed)
    rows = [(f"k{int(rng.paretovariate(0.7)) % 40}", rng.randrange(6)) for _ in range(rng.randrange(1, 400))]
    size = rng.randrange(1, 9)
    true, n = Counter(), 0
    for k, w in rows:
        true[k] += w
        n += w
    kinds = {}
    for kind in (counters.MisraGriesBlock, counters.SpaceSavingBlock, counters.LossyCountingBlock):
        state, at = kind(size), 0
        while at < len(rows):
            step = rng.randrange(1, 60)
            sums = Counter()
            for k, w in rows[at : at + step]:
                sums[k] += w
            state.absorb(pa.table({"key": list(sums), "w": pa.array(list(sums.values()), pa.int64())}))
            at += step
        t = state.table()
        kinds[kind] = state, dict(zip(t["key"].to_pylist(), zip(t["w"].to_pylist(), t["e"].to_pylist())))
        assert state.total == n and state.floor <= n / size
    mg, found = kinds[counters.MisraGriesBlock]
    assert len(found) <= size and mg.floor <= n / (size + 1)
    assert all(true[k] - mg.floor <= found.get(k, (0, 0))[0] <= true[k] for k in true)
    ss, found = kinds[counters.SpaceSavingBlock]
    assert len(found) <= size and all(e - x <= true[k] <= e <= true[k] + ss.floor for k, (e, x) in found.items())
    assert all(true[k] <= ss.floor for k in true if k not in found)
    lc, found = kinds[counters.LossyCountingBlock]
    assert all(e <= true[k] <= e + x for k, (e, x) in found.items()) and all(true[k] <= lc.floor for k in true if k not in found)


def test_bounds_and_pools(spark):
    rows = spark.createDataFrame([("a", 7, 3)], "key string, estimate long, error long")
    assert counters.with_bounds(rows, "space_saving").first()[3:] == (4, 7)
    assert counters.with_bounds(rows, "lossy_counting").first()[3:] == (7, 10)
    stream = make(spark, [("a", 5), ("b", 1), ("c", 1), ("a", 1)])
    assert {r["key"] for r in counters.arrival_pool(stream, lambda: counters.MisraGries(9), 0.5).collect()} == {"a"}


def test_folds_of_many_partitions_refuse_negative_weights(spark):
    bad = spark.createDataFrame([("a", -1), ("b", 3)], "key string, weight long")
    with pytest.raises(Exception, match="negative weight"):
        counters.misra_gries(bad, 4).collect()
    assert counters.misra_gries(bad.limit(0), 4).count() == 0


def test_negative_weights_and_bad_sizes_are_refused():
    for summary in (counters.MisraGries(1), counters.SpaceSaving(1), counters.LossyCounting(1)):
        with pytest.raises(ValueError):
            summary.update("a", -1)
    for kind in (counters.MisraGries, counters.SpaceSaving, counters.LossyCounting):
        with pytest.raises(ValueError):
            kind(0)


@pytest.mark.parametrize("parts", [1, 3, None])
def test_distributed_folds_lose_no_heavy_hitter(spark, parts):
    """``parts`` None: the partitions as they lie, in blocks."""
    rng = random.Random(parts or 5)
    stream = make(spark, [(f"k{int(rng.paretovariate(0.8))}", rng.randrange(1, 4)) for _ in range(900)]).repartition(5)
    c = exact.frequencies(stream)
    true = sorted(map(tuple, exact.heavy_hitters(c, 0.02).collect()))
    eps = 0.005
    mg = counters.heavy_lower(counters.added(counters.misra_gries(stream, sizing.misra_gries_capacity(eps), parts)), c, 0.02, eps)
    ss = counters.heavy_upper(counters.merge_upper(counters.space_saving(stream, sizing.space_saving_capacity(eps), parts)), c, 0.02)
    lc = counters.heavy_lower(counters.added(counters.lossy_counting(stream, sizing.lossy_window(eps), parts)), c, 0.02, eps)
    for candidates in (mg, ss, lc):
        assert sorted(map(tuple, exact.verified(candidates, c, 0.02).collect())) == true
    upper = as_dict(counters.merge_upper(counters.space_saving(stream, 20, parts)))
    weights = as_dict(c, value="total")
    assert all(upper[k] >= weights[k] for k in upper)


def test_merged_misra_gries_stays_within_capacity_and_bound(spark):
    rows = [(f"k{i % 37}", i % 5) for i in range(400)]
    c = counted(spark, rows)
    n = sum(w for _, w in rows)
    found, true = as_dict(counters.misra_gries_offline(c, 10)), as_dict(c, value="total")
    assert len(found) <= 10 and all(true[k] - n / 11 <= e <= true[k] for k, e in found.items())


def test_lossy_counting_closed_form(spark):
    rng = random.Random(9)
    for window in (3, 17, 60):
        rows = [(f"k{i}", rng.randrange(1, 12)) for i in range(120)]
        fold = {k: e for k, (e, _) in feed(counters.LossyCounting(window), rows).items()}
        assert as_dict(counters.lossy_counting_unique(make(spark, rows), window, 3)) == fold


def test_memory_bytes(spark):
    entries = spark.createDataFrame([("ab", 1), ("日本語", 2)], "key string, estimate long")
    assert counters.memory_bytes(entries, "misra_gries").first()["entries"] == 2
    assert counters.memory_bytes(entries, "misra_gries").first()["bytes"] == 2 * 56 + 2 * 5
    assert counters.memory_bytes(entries, "reservoir", 100).first()["bytes"] == 800 + 2 * 56 + 2 * 5


# --- samples -------------------------------------------------------------------------------------


def test_samples_hold_their_size_and_are_exact_when_all_fits(spark):
    c = counted(spark, ROWS + [("zero", 0)])
    true = {"a": 5, "b": 5, "c": 1, "d": 4}
    assert as_dict(sampling.concise_estimates(sampling.concise(c, 15))) == true
    small = sampling.concise(c, 6).collect()
    assert sum(r["sample_count"] for r in small) <= 6 and {r["t"] for r in small} <= {2, 4, 8, 16}
    assert as_dict(sampling.reservoir_estimates(sampling.reservoir(c, 100), c)) == true
    drawn = sampling.reservoir(c, 7).collect()
    assert sum(r["sample_count"] for r in drawn) == 7 == drawn[0]["m"]
    again = sampling.reservoir(c.repartition(3), 7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    with pytest.raises(ValueError):
        sampling.reservoir(c, 0)


def test_samples_are_about_unbiased(spark):
    c = counted(spark, [("heavy", 3000), ("light", 1000)])
    concise = sampling.averaged(sampling.concise_estimates(sampling.concise(c, 500, sampling.SEEDS)), 5)
    assert abs(as_dict(concise)["heavy"] - 3000) < 450
    assert abs(as_dict(sampling.reservoir_estimates(sampling.reservoir(c, 500), c))["heavy"] - 3000) < 300


def test_samples_of_huge_weights(spark):
    """A weight of 10**12 makes no more rows than the sample needs."""
    c = counted(spark, [("huge", 10**12), ("big", 10**11), ("one", 1)])
    units = sampling.arrivals(c, 200)
    assert 200 <= units.count() < 20 * sampling.enough(200)
    drawn = {r["key"]: r["sample_count"] for r in sampling.reservoir(c, 200).collect()}
    assert sum(drawn.values()) == 200 and 150 < drawn["huge"] < 198
    estimate = as_dict(sampling.concise_estimates(sampling.concise(c, 200)))
    assert abs(estimate["huge"] / 10**12 - 1) < 0.4


def test_samples_follow_the_law_of_unit_draws(spark):
    """Counts of one key among the first units over many seeds, against the hypergeometric
    law, by chi-square; and the level at which a concise sample of many units fits."""
    n, heavy, size, seeds = 4000, 1600, 12, 1500
    c = counted(spark, [("a", heavy), ("b", n - heavy)])
    found = Counter(0 if r["c"] is None else r["c"] for r in sampling.reservoir(c, size, tuple(range(seeds))).groupBy("seed").agg(F.max(F.when(F.col("key") == "a", F.col("sample_count"))).alias("c")).collect())
    law = [math.comb(heavy, k) * math.comb(n - heavy, size - k) / math.comb(n, size) for k in range(size + 1)]
    kept = [k for k in range(size + 1) if law[k] * seeds >= 8]
    rest = 1 - sum(law[k] for k in kept)
    chi = sum((found[k] - law[k] * seeds) ** 2 / (law[k] * seeds) for k in kept)
    chi += (seeds - sum(found[k] for k in kept) - rest * seeds) ** 2 / max(rest * seeds, 1)
    assert chi < 35  # 9 classes: exceeded once in 20,000
    units = sampling.arrivals(c, 2, tuple(range(300)))  # pieces of several units
    assert units.select("least").first()[0] > 3
    expected = n * 2.0 ** -units.select("least").first()[0] * 300
    assert abs(units.count() - expected) < 6 * expected**0.5
    at = units.filter(F.col("key") == "a").count()
    assert abs(at - expected * heavy / n) < 6 * expected**0.5


def test_merged_samples_are_samples_of_the_whole(spark):
    parts = [counted(spark, [("a", 300), ("b", 100)]), counted(spark, [("a", 100), ("c", 500)])]
    units = sampling.arrivals(parts[0], 50, (1,), 1).unionByName(sampling.arrivals(parts[1], 50, (1,), 2))
    drawn = {r["key"]: r["sample_count"] for r in sampling.reservoir_of(units, 50).collect()}
    assert sum(drawn.values()) == 50 and drawn["c"] > drawn["b"]
    assert sampling.concise_of(units, 50).agg(F.sum("sample_count")).first()[0] <= 50


# --- metrics, sizing, sources ------------------------------------------------------------------------


def test_set_quality(spark):
    reported = spark.createDataFrame([("a", 12), ("b", 5), ("x", 3)], "key string, estimate long")
    true = spark.createDataFrame([("a", 10), ("b", 5), ("c", 4)], "key string, total long")
    r = metrics.set_quality(reported, true).first()
    assert (r["tp"], r["fp"], r["fn"], r["max_abs_error"]) == (2, 1, 1, 2)
    assert r["precision_pct"] == r["recall_pct"] == r["f1_pct"] == pytest.approx(66.666667)
    assert (r["mean_rel_error_pct"], r["max_rel_error_pct"]) == (10.0, 20.0)
    empty = metrics.set_quality(reported.filter("key = 'x'"), true.limit(0)).first()
    assert (empty["precision_pct"], empty["recall_pct"], empty["f1_pct"], empty["mean_rel_error_pct"]) == (0, 0, 0, 0)


def test_sizing_rules():
    assert sizing.count_min_grid(1e-6, 1e-3) == Grid(7, 2718282)
    assert sizing.count_sketch_for(128) == Grid(7, 2340) and sizing.count_min_for(128) == Grid(5, 3276)
    assert sizing.misra_gries_for(128)[0] == 1024 and sizing.space_saving_for(128)[0] == 963 and sizing.sample_for(128) == 1024
    assert sizing.misra_gries_capacity(1e-5) in (99999, 100000) and sizing.threshold(1e-4, 44_367_267) == 4437
    assert sizing.gated_ams_for(128)[0].width == 1310
    with pytest.raises(ValueError):
        sizing.count_min_grid(1.5, 0.1)


def test_pageview_lines(spark):
    lines = ["en Main web all 12 x", "en Short web all 5", "en - web all 7 x", "en Bad web all many x", "de\tTab   web all\t3 y z", "  fr Lead web all 1 x"]
    rows = pageviews.parse_pageviews(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")).collect()
    assert [(r["key"], r["views"]) for r in rows] == [("en/Main", 12), ("de/Tab", 3), ("fr/Lead", 1)]


def test_zipf_totals_and_tags(spark):
    rows = synthetic.zipf_stream(spark, 1.5, 1000, 10_000).collect()
    h = sum(i**-1.5 for i in range(1, 1001))
    assert rows[0]["weight"] == round(10_000 / h) and all(r["weight"] > 0 for r in rows)
    assert synthetic.zipf_stream(spark, 0.6, 1000, 10_000, 50).count() == 50
    assert (synthetic.tag(1.0), synthetic.tag(0.6)) == ("10", "06")


def test_reports_keep_odd_keys(spark, tmp_path):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(ODD) if k], "key string, total_views long")
    reports.write_report(rows, str(tmp_path / "r"))
    assert sorted(map(tuple, reports.read_report(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, rows.collect()))


def test_metrics_upsert(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *x: spark.createDataFrame(list(x), "algorithm string, f1 double")
    reports.upsert_metrics(rows(("cms", 1.0), ("mg", 2.0)), path)
    reports.upsert_metrics(rows(("mg", 3.0)), path)
    assert sorted((r["algorithm"], r["f1"]) for r in spark.read.parquet(path).collect()) == [("cms", 1.0), ("mg", 3.0)]
    assert "f1: 3.0" in reports.as_text(rows(("mg", 3.0))).first()["report"]


def test_metrics_upsert_by_parameters(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *x: spark.createDataFrame(list(x), "algorithm string, kb int, f1 double")
    reports.write_comparison(rows(("cms", 1, 1.0), ("cms", 2, 2.0), ("mg", 1, 3.0)), path, ("algorithm", "kb"))
    reports.write_comparison(rows(("cms", 2, 9.0)), path, ("algorithm", "kb"))
    found = spark.read.option("header", True).csv(f"{path}/comparison").collect()
    assert sorted((r["algorithm"], r["kb"], r["f1"]) for r in found) == [("cms", "1", "1.0"), ("cms", "2", "9.0"), ("mg", "1", "3.0")]


def test_files(spark, tmp_path, monkeypatch):
    source = tmp_path / "lines.txt"
    source.write_text("\n".join(map(str, range(30))))
    target = files.fetch(f"file://{source}", str(tmp_path / "copy.txt"))
    assert files.peek(spark, target, 3) == ["0", "1", "2"]
    with pytest.raises(OSError):
        files.fetch("file:///nowhere/at/all", str(tmp_path / "none.txt"), tries=2, wait=0)
    assert not list(tmp_path.glob("none*"))
    monkeypatch.setenv(files.ROOT, str(tmp_path))
    assert files.resolve("x/y") == str(tmp_path / "x/y") and files.resolve("/a") == "/a" and files.resolve("x", "/r") == "/r/x"
    (tmp_path / "zipf_10").mkdir()
    (tmp_path / "pageviews").mkdir()
    assert files.variants(str(tmp_path)) == {"zipf_10": (1.0, f"{tmp_path}/zipf_10"), "pageviews": (None, f"{tmp_path}/pageviews")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    files.size_scans(spark)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) == files.SPLIT_BYTES
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_k_fold_signs_are_independent(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    for family in hashing.FAMILIES:
        signed = df.select(hashing.signs(F.lit(3), F.col("key"), 4, family).alias("s"), hashing.sign(hashing.hash_pair(F.lit(3), F.col("key"), family)["lo"]).alias("one"))
        assert signed.filter(F.col("s")[0] != F.col("one")).isEmpty()
        products = [F.avg(reduce(lambda a, b: a * b, (F.col("s")[i] for i in some))) for k in (1, 2, 3, 4) for some in combinations(range(4), k)]
        assert all(abs(x) < 0.07 for x in signed.agg(*products).first())


def test_words_without_a_place_are_refused(spark):
    df = spark.createDataFrame([(1 << 40, "a b")], "n long, text string")
    with pytest.raises(Exception, match="no place in the order"):
        streams.words(df, number=F.col("n")).collect()


def test_estimates_by_arrays_equal_those_by_joins(spark, monkeypatch):
    c = counted(spark, [(f"k{i}", 1 + i % 9) for i in range(300)])
    grids = {1: Grid(3, 32), 2: Grid(2, 64)}
    for build, score in ((linear.count_min, linear.count_min_estimates), (linear.count_sketch, linear.count_sketch_estimates)):
        cells = build(c, grids)
        keys = c.unionByName(spark.createDataFrame([("never", 0)], "key string, total long"))
        dense = sorted(map(tuple, score(keys, cells, grids).collect()))
        monkeypatch.setattr(linear, "DENSE", 0)
        assert dense == sorted(map(tuple, score(keys, cells, grids).collect()))
        monkeypatch.undo()
    with pytest.raises(Exception, match="outside the grid"):
        linear.merge(cells, grids={1: Grid(3, 32), 2: Grid(2, 16)}).collect()


def test_long_streams_are_summed_in_levels(spark):
    """Places far apart, so that sums pass every level."""
    rng = random.Random(7)
    rows = sorted({(rng.randrange(1 << rng.randrange(1, 62))) for _ in range(300)})
    df = spark.createDataFrame([(x, i % 5) for i, x in enumerate(rows)], "ord long, v long").withColumn("r", F.shiftright("ord", 3))
    found = {r["ord"]: r["before"] for r in prefix.prefix_sums(df, [], "r", ["ord"], "v", "before").collect()}
    assert found == {x: sum(j % 5 for j in range(i)) for i, x in enumerate(rows)}


def test_partitioned_linear_sketches_do_not_drift(spark):
    stream = make(spark, [(f"k{i % 50}", 1 + i % 3) for i in range(600)])
    rows = experiments.partition_sweep(stream, (1, 2, 4), kb=1, k=10).collect()
    assert len(rows) == 6 and all(r["max_abs_diff"] == 0 for r in rows)
    lossy = experiments.counter_partition_sweep(stream, (1, 4), kb=1, k=10).collect()
    assert {r["partitions"] for r in lossy} == {1, 4}


def test_mergeable_contract(spark):
    from tallyweave.operators import mergeable

    keys = counted(spark, ROWS).select("key")
    for kind in (mergeable.CountMin(Grid(3, 64)), mergeable.CountSketch(Grid(5, 64)), mergeable.Ams(Grid(5, 64)), mergeable.MisraGries(10, 2), mergeable.SpaceSaving(10), mergeable.LossyCounting(50)):
        whole = kind.estimate(kind.build(make(spark, ROWS)), keys)
        parts = mergeable.merged(kind, kind, kind.build(make(spark, ROWS[:3])), kind.build(make(spark, ROWS[3:])))
        assert as_dict(kind.estimate(parts, keys)) == as_dict(whole)
    for kind in (mergeable.Concise, mergeable.Reservoir, lambda size, part: mergeable.MisraGries(size), lambda size, part: mergeable.SpaceSaving(size), lambda size, part: mergeable.LossyCounting(size)):
        halves = [mergeable.summarise(kind(30, part=i), make(spark, rows)) for i, rows in enumerate((ROWS[:3], ROWS[3:]))]
        both = halves[0].merge(halves[1])
        assert both.weight.first()["n"] == 15 and as_dict(both.estimate(keys)) == {"a": 5, "b": 5, "c": 1, "d": 4}
    with pytest.raises(ValueError):
        halves[0].merge(mergeable.summarise(mergeable.SpaceSaving(31), make(spark, ROWS)))
    with pytest.raises(ValueError):
        other = mergeable.CountMin(Grid(3, 64), seed=1)
        mergeable.merged(mergeable.CountMin(Grid(3, 64)), other, keys, keys)


def test_batched_ams(spark):
    c, grid = counted(spark, [("wiki", 3), ("wiki", 5)]), Grid(3, 2000)
    state = linear.ams_batched(c, grid)
    assert state.count() == 6000 and {abs(r["x"]) for r in state.collect()} == {8}
    assert linear.ams_batched_estimates(c, state, grid).first()["estimate"] == 8
    many = counted(spark, [(f"k{i}", 1 + i % 4) for i in range(200)])
    f2 = many.agg(F.sum(F.col("total") * F.col("total"))).first()[0]
    whole = linear.ams_batched(many, grid)
    assert abs(linear.ams_second_moment(whole, grid).first()["f2"] - f2) < 0.15 * f2
    halves = [linear.ams_batched(many.filter(F.crc32(F.col("key").cast("binary")) % 2 == p), grid) for p in (0, 1)]
    assert sorted(map(tuple, linear.merge_ams(*halves).collect())) == sorted(map(tuple, whole.collect()))


def test_batched_ams_equals_brute_force(spark):
    """State, estimates and the sweep's row, from signs worked out in whole numbers."""
    import xxhash

    mask, rows = (1 << 64) - 1, [(f"k{i}", 1 + (i * i) % 37) for i in range(40)]

    def sign(key, copy):
        x = xxhash.xxh64_intdigest(key, 42) ^ ((copy + 1) * 0x9E3779B97F4A7C15 & mask)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return 1 if x >> 63 else -1

    def estimate(key, state, grid):
        means = [math.trunc(sum(sign(key, r * grid.width + c) * state[r * grid.width + c] for c in range(grid.width)) / grid.width) for r in range(grid.rows)]
        return sorted(means)[grid.rows // 2]

    c, kb = counted(spark, rows), 1
    for grid in (Grid(3, 20), sizing.gated_ams_for(kb)[1]):
        state = [sum(w * sign(k, i) for k, w in rows) for i in range(grid.rows * grid.width)]
        made = linear.ams_batched(c, grid)
        assert [r["x"] for r in made.orderBy("row", "copy").collect()] == state
        expected = {k: estimate(k, state, grid) for k, _ in rows}
        assert as_dict(linear.ams_batched_estimates(c, made, grid)) == expected
    found = experiments.memory_sweep(make(spark, rows), (kb,), 0.03, ("ams_batched",)).first()
    limit = math.ceil(0.03 * sum(w for _, w in rows))
    true, told = {k for k, w in rows if w >= limit}, {k for k, e in expected.items() if e >= limit}
    assert (found["reported_count"], found["true_count"], found["tp"], found["fp"]) == (len(told), len(true), len(true & told), len(told - true))


def test_timed_builds(spark):
    stream = make(spark, ROWS)
    rows = experiments.timed(lambda p: linear.by_partition(exact.frequencies(stream), p, Grid(2, 8)), (1, 2), 5)
    assert rows[0]["speedup"] == 1 and all(r["rows_a_second"] > 0 for r in rows)
