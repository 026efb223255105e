import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.functions.columns import file_group, sample_name
from tractwise.operators import delta, histograms, reads


def hist(spark, samples):
    rows = [("d", g, s, i, float(x), float(n)) for (g, s), pairs in samples.items()
            for i, (x, n) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "dataset string, grp string, sample string, pos int, repeat_length double, reads double")


def test_group_marks_are_tested_in_order(spark):
    names = ["untreated_1.csv", "s_d0.rest.histogram", "s_D42.csv", "s_day_42.csv", "day42_1.csv",
             "Day0_x.csv", "plain.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(file_group(F.col("n"))).collect()]
    assert got == ["treated", "Day0", "treated", "treated", "Day0", "Day0", "Day0"]
    assert df.select(file_group(F.col("n"), "treated")).collect()[6][0] == "treated"


def test_sample_name(spark):
    names = {"/a/s1_d0.rest.histogram": "s1_d0", "s1.v2.per.histogram": "s1.v2", "a.b.csv": "a.b",
             "x.histogram": "x"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(sample_name(F.col("n"))).collect()] == list(names.values())


def test_repeat_length_both_strands_and_profiles(spark):
    other = {"A": "T", "C": "G", "G": "C", "T": "A"}
    forward = "AT" + "CAG" * 7 + "CAA" + "CAG" * 2 + "TT" + "CAG" * 3
    reverse = "".join(other[c] for c in reversed(forward))
    rows = [(forward,), (reverse,), (forward.lower(),), ("ACGT",), ("",)]
    df = spark.createDataFrame(rows, "s string").select(
        reads.repeat_length(F.col("s")), reads.repeat_length(F.col("s"), profile="permissive"))
    assert [tuple(r) for r in df.collect()] == [(7, 10)] * 3 + [(0, 0)] * 2


def test_repeat_length_against_brute_force(spark):
    def units(seq, motif, permissive):
        best = 0
        for start in range(len(seq)):
            n, used, i, tail = 0, not permissive, start, 0
            while i + 3 <= len(seq):
                unit = seq[i:i + 3]
                if unit == motif:
                    n += 1
                    tail = n
                elif not used and n and sum(a != b for a, b in zip(unit, motif)) == 1:
                    used, n = True, n + 1
                else:
                    break
                i += 3
            best = max(best, tail)
        return best

    rng = np.random.default_rng(1)
    seqs = []
    for _ in range(300):
        parts = rng.choice(["CAG", "CAG", "CAG", "CTG", "CAA", "A", "GTC", "CGG"], 25)
        seqs.append("".join(parts))
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", reads.repeat_length(F.col("s")).alias("a"),
                    reads.repeat_length(F.col("s"), profile="permissive").alias("b")).collect()
    for row in got:
        assert row["a"] == max(units(row["s"], m, False) for m in ("CAG", "CTG"))
        assert row["b"] == max(units(row["s"], m, True) for m in ("CAG", "CTG"))


def test_overlapping_motif(spark):
    df = spark.createDataFrame([("ATATAATA",)], "s string")
    assert df.select(reads.repeat_length(F.col("s"), "ATA")).first()[0] == 2


def test_histogram_range(spark):
    df = spark.createDataFrame([("d", "g", "s", n) for n in (0, 3, 3, 500, 501)],
                               "dataset string, grp string, sample string, repeat_length int")
    got = {r["repeat_length"]: r["reads"] for r in reads.build_histogram(df).collect()}
    assert got == {0.0: 1.0, 3.0: 2.0, 500.0: 1.0}


def test_normalise_drops_flat_and_infinite_samples(spark):
    df = hist(spark, {("Day0", "a"): [(1, 2), (2, 4), (3, 6)], ("Day0", "flat"): [(1, 5), (2, 5)],
                      ("Day0", "inf"): [(1, 1), (2, float("inf"))]})
    got = histograms.normalise(df).orderBy("pos").collect()
    assert [r["y"] for r in got] == [0.0, 0.5, 1.0]
    assert {r["sample"] for r in histograms.valid_samples(df).collect()} == {"a"}
    percent = histograms.normalise(df, "percent").agg(F.sum("y")).first()[0]
    assert percent == pytest.approx(100)
    with pytest.raises(ValueError):
        histograms.require_valid(df.filter("sample = 'flat'"))


def test_coerce_drops_text_and_nan(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "1"), ("2", "abc"), ("3", ""), ("4", "NaN"),
                                ("5", None), (" 6 ", "1e2")], "x string, y string")
    got = histograms.coerce_numbers(df, ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.5), (6.0, 100.0)]


def test_instability_uses_positions_and_first_peak(spark):
    # a gap in the lengths does not count; the first of two equal peaks is the main allele
    df = hist(spark, {("Day0", "a"): [(10, 50), (11, 100), (20, 100), (21, 1)]})
    row = histograms.instability(df).first()
    assert row["mode"] == 11.0
    assert row["instability_index"] == pytest.approx((-50 + 100) / 250)
    assert row["contraction_index"] == pytest.approx(-50 / 250)
    assert row["expansion_index"] == pytest.approx(100 / 250)
    # exactly five percent of the peak is not kept
    edge = hist(spark, {("Day0", "a"): [(1, 5), (2, 100)]})
    assert histograms.instability(edge).first()["instability_index"] == 0.0


def test_index_is_the_sum_of_its_sides(spark):
    rng = np.random.default_rng(0)
    df = hist(spark, {("Day0", f"s{i}"): [(x, rng.integers(0, 50)) for x in range(40)]
                      for i in range(20)})
    for r in histograms.instability(df).collect():
        assert r["instability_index"] == pytest.approx(r["contraction_index"] + r["expansion_index"])


def replicate_frame(spark):
    # min-max leaves values in [0, 1]; the middle length has Day0 0.25/0.75 and treated 0.5/0.5
    return hist(spark, {
        ("Day0", "a"): [(1, 0), (2, 1), (3, 4)], ("Day0", "b"): [(1, 0), (2, 3), (3, 4)],
        ("treated", "a"): [(1, 0), (2, 2), (3, 4), (4, 1)], ("treated", "b"): [(1, 0), (2, 2), (3, 4)]})


def test_alignment_and_delta(spark):
    table = {r["x"]: r for r in delta.delta_table(replicate_frame(spark)).collect()}
    assert set(table) == {1.0, 2.0, 3.0}
    assert table[2.0]["day0_avg"] == 0.5 and table[2.0]["delta"] == 0.0


def test_replicate_error_counts_the_mean_as_a_replicate(spark):
    groups = delta.aligned_groups(histograms.normalise(replicate_frame(spark))).filter("x = 2")
    def err(*args):
        return delta.replicate_error(groups, *args).first()["err"]

    values = np.array([0.25, 0.75, 0.5])
    assert err("sd") == pytest.approx(values.std(ddof=1))
    assert err("sem") == pytest.approx(values.std(ddof=1) / np.sqrt(3))
    assert err("sd", False) == pytest.approx(values[:2].std(ddof=1))
    assert err("sem", False) == pytest.approx(values[:2].std(ddof=1) / np.sqrt(2))


def test_single_replicate_error(spark):
    one = replicate_frame(spark).filter("sample = 'a'")
    groups = delta.aligned_groups(histograms.normalise(one)).filter("x = 2")
    assert delta.replicate_error(groups, "sd").first()["err"] == 0.0
    assert delta.replicate_error(groups, "sd", False).first()["err"] is None


def test_missing_group_gives_nothing(spark):
    assert delta.delta_table(replicate_frame(spark).filter("grp = 'Day0'")).count() == 0


def set_frame(spark):
    rows = [(1, s, float(x), d) for s, start in ((1, 1), (2, 2)) for x, d in
            [(start + i, s * 0.1 * i) for i in range(5)]]
    return spark.createDataFrame(rows, "pair int, set_id int, x double, delta double")


def test_between_sets_after_independent_thinning(spark):
    # thinned: set 1 keeps 1, 3, 5 and set 2 keeps 2, 4, 6, so nothing is shared
    assert delta.between_sets(set_frame(spark)).count() == 0
    shared = {r["x"]: r for r in delta.between_sets(set_frame(spark), bin_size=1).collect()}
    assert set(shared) == {2.0, 3.0, 4.0, 5.0}
    gap = abs(0.2 - 0.2 * 1)
    assert shared[3.0]["sd"] == pytest.approx(gap / np.sqrt(2), abs=1e-12)
    assert shared[5.0]["sem"] == pytest.approx(abs(0.4 - 0.6) / 2)


def test_wide_table_has_delta_last(spark):
    names = ["Day0_a", "Day0_b", "treated_a", "treated_b"]
    wide = delta.wide_delta(replicate_frame(spark), names)
    assert wide.columns == ["dataset", "repeat length", *names, "Day0_avg", "treated_avg", "delta"]
    assert wide.filter("`repeat length` = 2").first()["Day0_b"] == 0.75


def test_two_sets_have_no_replicate_error(spark):
    groups = delta.aligned_groups(histograms.normalise(replicate_frame(spark)))
    both = groups.withColumn("pair", F.lit(1)).withColumn("set_id", F.explode(F.array(F.lit(1), F.lit(2))))
    err = [r["err"] for r in delta.delta_plot(both, "sd", 1).collect()]
    assert err == [0.0] * 6  # identical sets
    one = both.filter("set_id = 1")
    assert max(r["err"] for r in delta.delta_plot(one, "sd", 1).collect()) > 0
    assert {r["err"] for r in delta.delta_plot(one, None, 1).collect()} == {None}


@pytest.mark.parametrize("motif", ["ATA", "GGC", "AT", "CAGCA"])
def test_other_motifs_against_brute_force(spark, motif):
    def units(seq):
        n = len(motif)
        best = 0
        for start in range(len(seq)):
            k = 0
            while seq[start + k * n:start + (k + 1) * n] == motif:
                k += 1
            best = max(best, k)
        return best

    other = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice([motif, motif, other, *motif, "A", "C"], 25)) for _ in range(200)]
    flip = str.maketrans("ACGT", "TGCA")
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select(
        "s", reads.repeat_length(F.col("s"), motif).alias("n")).collect()
    for row in got:
        assert row["n"] == max(units(row["s"]), units(row["s"][::-1].translate(flip)))
