import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.functions import ranks
from tractwise.operators import features as fe
from tractwise.operators import split as sp


def frame(spark, sets):
    rows = [(name, i, float(v)) for name, values in sets.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, pos int, delta double")


def test_first_usable_values_in_file_order(spark):
    values = [0, 1, float("nan"), 2, float("inf"), 3, -4, 5]
    df = frame(spark, {"a": values, "b": [1, 2]})
    got = fe.usable_deltas(df, first_n=4, min_rows=3).orderBy("rank").collect()
    assert [(r["dataset"], r["pos"], r["delta"]) for r in got] == [
        ("a", 1, 1.0), ("a", 3, 2.0), ("a", 5, 3.0), ("a", 6, -4.0)]
    used = fe.usable_deltas(df, first_n=4, min_rows=3)
    assert [r["dataset"] for r in fe.skipped_datasets(df, used).collect()] == ["b"]
    kept = fe.usable_deltas(df, 100, 1, drop_zeros=False)
    assert kept.filter("dataset = 'a'").count() == 6


def expected(d):
    s = np.sort(d)
    cut = int(len(d) * 0.1)
    mad = np.median(np.abs(d - np.median(d))) * 1.4826
    m = d - d.mean()
    return {
        "mean_delta": d.mean(), "trimmed_mean": s[cut:len(d) - cut].mean(), "median_delta": np.median(d),
        "sd_delta": d.std(ddof=1), "mad_delta": mad, "skew_delta": (m ** 3).mean() / (m ** 2).mean() ** 1.5,
        "iqr_delta": np.quantile(d, .75) - np.quantile(d, .25), "mean_abs": np.abs(d).mean(),
        "prop_pos": (d > 0).mean(), "prop_neg": (d < 0).mean(), "prop_neutral": (np.abs(d) <= .005).mean(),
        "prop_strong_pos": (d >= .05).mean(), "prop_strong_neg": (d <= -.05).mean()}


def test_robust_features(spark):
    rng = np.random.default_rng(2)
    sets = {f"s{i}": rng.normal(0.01 * i, 0.05, 30 + 7 * i) for i in range(6)}
    got = {r["dataset"]: r for r in fe.robust_features(fe.usable_deltas(frame(spark, sets))).collect()}
    for name, d in sets.items():
        for key, value in expected(d).items():
            assert got[name][key] == pytest.approx(value), (name, key)


def test_constant_series(spark):
    df = frame(spark, {"c": [0.2] * 40, "two": [0.1, 0.3] * 20})
    got = {r["dataset"]: r for r in fe.dataset_features(df).collect()}
    assert got["c"]["skew_delta"] == 0.0 and got["c"]["mix_k"] == 1.0
    assert got["c"]["mix_mu1"] == pytest.approx(0.2) and got["c"]["mix_mu2"] is None
    assert got["two"]["skew_delta"] == 0.0
    assert got["c"]["true_label"] == "expansion"


def test_mixture_finds_two_groups_and_one_group(spark):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(-1, .1, 60), rng.normal(2, .1, 40)])
    rng.shuffle(two)
    df = frame(spark, {"two": two, "one": rng.normal(0, 1, 100)})
    got = {r["dataset"]: r for r in fe.mixture_features(fe.usable_deltas(df)).collect()}
    r = got["two"]
    assert r["mix_k"] == 2.0 and r["mix_mu1"] == pytest.approx(-1, abs=.1)
    assert (r["mix_pi1"], r["mix_pi2"]) == pytest.approx((.6, .4))
    assert r["mix_sep"] == pytest.approx((r["mix_mu2"] - r["mix_mu1"]) / two.std(ddof=1))
    assert r["mix_entropy"] == pytest.approx(-.6 * np.log(.6) - .4 * np.log(.4))
    assert got["one"]["mix_k"] == 1.0 and got["one"]["mix_entropy"] == 0.0


def test_em_steps_raise_the_likelihood_and_rows_are_independent():
    rng = np.random.default_rng(6)
    rows = [rng.normal(size=50), np.concatenate([rng.normal(-2, 1, 20), rng.normal(2, .5, 15)])]
    x, ok = np.zeros((2, 50)), np.zeros((2, 50), bool)
    for i, r in enumerate(rows):
        x[i, :len(r)], ok[i, :len(r)] = r, True
    for equal in (True, False):
        best = [fe.two_component_fits(x, ok, equal, 0.0, steps)[2] for steps in (1, 3, 10, 40)]
        assert (np.diff(np.array(best), axis=0) >= -1e-9).all()
        alone = fe.two_component_fits(x[1:, :35], ok[1:, :35], equal)
        both = fe.two_component_fits(x, ok, equal)
        assert both[2][1] == pytest.approx(alone[2][0])
        assert both[0][:, 1] == pytest.approx(alone[0][:, 0])


def test_exact_quantiles_and_running_sums(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([np.repeat(0.5, 400), rng.normal(size=333)])
    rows = [("a", float(v)) for v in values] + [("b", 1.0), ("b", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranks.exact_quantiles(df, "k", "v", [0.5, 0.1]).collect()}
    assert got["a"]["q0"] == pytest.approx(np.median(values))
    assert got["a"]["q1"] == pytest.approx(np.quantile(values, .1))
    assert got["b"]["q0"] == 2.5

    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    cuts = ranks.cut_points(counts, "v", 8)
    cum = ranks.running_sums(counts.withColumn("b", ranks.bucket_of(F.col("v"), cuts)), [], "v", "b", ["n"])
    every = np.sort([r[1] for r in rows])
    for r in cum.collect():
        assert r["cum_n"] == (every <= r["v"]).sum()


def test_hash_rank_is_a_permutation_in_md5_order(spark):
    import hashlib
    df = spark.range(500).withColumn("k", F.col("id") % 3)
    got = ranks.hash_rank(df, ["k"], "id", "r").collect()
    for k in range(3):
        order = [r["id"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["r"])]
        assert order == sorted(range(k, 500, 3), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


@pytest.mark.parametrize("sizes", [(50, 30, 20), (9, 1, 0), (0, 0, 7), (3, 3, 0), (1, 0, 0), (5, 5, 1)])
def test_split_sizes(spark, sizes):
    labels = [n for n, k in zip(("expansion", "contraction", "neutral"), sizes) for _ in range(k)]
    df = spark.createDataFrame(list(enumerate(labels)), "dataset long, true_label string")
    got = sp.stratified_split(df).collect()
    n = len(labels)
    want = max(1, int(.8 * n))
    assert sorted(r["dataset"] for r in got) == list(range(n))
    assert sum(r["split"] == "train" for r in got) == want
    for name, k in zip(("expansion", "contraction"), sizes):
        taken = sum(r["split"] == "train" and r["true_label"] == name for r in got)
        assert taken >= min(k, round(want * (k / n)))


def test_split_ignores_row_order(spark):
    df = spark.range(200).select(F.col("id").alias("dataset"), F.when(F.col("id") % 2 == 0, "expansion")
                                 .otherwise("neutral").alias("true_label"))
    a = {tuple(r) for r in sp.stratified_split(df).collect()}
    b = {tuple(r) for r in sp.stratified_split(df.orderBy(F.rand(3)).repartition(7)).collect()}
    assert a == b


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, None), ("c", float("nan"), None),
                                ("d", 10.0, None)], "dataset string, u double, v double")
    got = {r["dataset"]: r for r in sp.impute_median(df, ["u", "v"]).collect()}
    assert got["c"]["u"] == 3.0 and all(r["v"] == 0.0 for r in got.values())
    filled = sp.impute_median(df, ["u", "v"])
    z = sp.standardise(filled, sp.column_stats(filled, ["u", "v"]), ["u", "v"])
    u = np.array([1, 3, 3, 10.0])
    assert sorted(r["u"] for r in z.collect()) == pytest.approx(sorted((u - u.mean()) / u.std(ddof=1)))
    assert {r["v"] for r in z.collect()} == {0.0}


def test_distribution_counts_all(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    got = {r["bin"]: r["n"] for r in fe.equal_width_counts(df, "v", 20).collect()}
    assert sum(got.values()) == 101 and set(got) == set(range(1, 21)) and got[20] == 6
