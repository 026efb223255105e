import numpy as np
import pytest

from tractwise.operators.histograms import instability
from tractwise.plans.counting import count_fasta
from tractwise.plans.profiles import profile_batch


def long_frame(spark, x, name):
    rows = [(f"{name}{i}", float(j + 1), float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "file string, x double, delta double")


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_profile_batch(spark, method):
    rng = np.random.default_rng(21)
    shape = np.array([.4, .4, .2, -.2, -.4, -.4])

    def sample(n):
        return np.concatenate([shape + rng.normal(0, .02, (n, 6)), -shape + rng.normal(0, .02, (n, 6))])

    batch = profile_batch(long_frame(spark, sample(8), "a"), long_frame(spark, sample(2), "b"), method,
                          k=2, auto_select_k=False, n_start=5)
    rows = {r["file"]: r for r in batch.metrics.collect()}
    assert set(rows) == {"b0", "b1", "b2", "b3"}
    assert all(r["auc_exp"] == 1.0 and r["auc_con"] == 1.0 for r in rows.values())
    assert rows["b0"]["assigned_cluster"] == rows["b1"]["assigned_cluster"] != rows["b2"]["assigned_cluster"]
    overall = {r["side"]: r for r in batch.overall().collect()}
    assert overall["expansion"]["auc"] == overall["contraction"]["auc"] == 1.0
    assert overall["expansion"]["n_pos"] == 12
    ends = batch.overall_curve().filter("side = 'expansion'").orderBy("fpr", "tpr").collect()
    assert (ends[0]["fpr"], ends[0]["tpr"]) == (0, 0) and (ends[-1]["fpr"], ends[-1]["tpr"]) == (1, 1)
    assert batch.assignments.count() == 16 and batch.centers.count() == 2
    curves = batch.curves().filter("side = 'contraction' AND file = 'b2'").orderBy("fpr", "tpr").collect()
    assert (curves[0]["fpr"], curves[0]["tpr"]) == (0, 0) and (curves[-1]["fpr"], curves[-1]["tpr"]) == (1, 1)


def test_cluster_panel(spark):
    rng = np.random.default_rng(22)
    shape = np.array([.4, .4, .2, -.2, -.4, -.4, -.4])
    train = np.concatenate([shape + rng.normal(0, .02, (8, 7)), -shape + rng.normal(0, .02, (8, 7))])
    test = shape + rng.normal(0, .02, (1, 7))
    batch = profile_batch(long_frame(spark, train, "a"), long_frame(spark, test, "b"), "kmeans", k=2, n_start=5)
    rows = batch.panel.orderBy("layer", "x").collect()
    got = {layer: [r for r in rows if r["layer"] == layer] for layer in ("signal", "bin mean", "predicted")}
    y = test[0]
    line = [y[i - 2:i + 3].mean() if 2 <= i < 5 else y[i] for i in range(7)]
    assert [r["x"] for r in got["signal"]] == list(range(1, 8))
    assert [r["value"] for r in got["signal"]] == pytest.approx(line)
    mids = batch.model.grid.mids
    assert [r["x"] for r in got["bin mean"]] == mids
    assert [r["value"] for r in got["bin mean"]] == pytest.approx([*y, *[0.0] * (len(mids) - 7)])
    steps = got["predicted"]
    assert steps[0]["x"] == mids[0] and steps[-1]["x_end"] == mids[-1]
    assert all(a["x_end"] == b["x"] for a, b in zip(steps, steps[1:]))
    own = int(np.argmin([abs(c[0] - y[0]) for c in batch.model.centers]))
    assert [r["value"] for r in steps] == pytest.approx(list(batch.model.centers[own]))
    (caption,) = {r["caption"] for r in rows}
    shares = [float(p.split("=")[1].rstrip("%")) for p in caption.split("posteriors: ")[1].split(", ")]
    assert caption.startswith(f"Cluster {own + 1} (") and len(shares) == 2 and sum(shares) == pytest.approx(100, abs=.2)
    assert shares[own] == max(shares)


def test_fasta_to_index(spark, tmp_path):
    text = "".join(f">r{i}_{n}\nAT{'CAG' * n}TT\n" for n, k in ((20, 10), (21, 4), (19, 2)) for i in range(k))
    (tmp_path / "s1_d0.fasta").write_text(text)
    hist = count_fasta(spark, str(tmp_path))
    assert [(r["pos"], r["repeat_length"], r["reads"]) for r in hist.orderBy("pos").collect()] == [
        (0, 19.0, 2.0), (1, 20.0, 10.0), (2, 21.0, 4.0)]
    row = instability(hist).first()
    assert (row["sample"], row["grp"], row["mode"]) == ("s1_d0", "Day0", 20.0)
    assert row["instability_index"] == pytest.approx((4 - 2) / 16)


def test_a_batch_counts_only_when_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from tractwise.sources import sinks

    path = str(tmp_path / "out")
    one = spark.createDataFrame([("a, \"b\"", 1.5, None), ("line\ntwo", None, 3)], "name string, x double, n long")
    sinks.write_batch({"metrics.csv": one, "none.csv": one.limit(0)}, path)
    broken = one.withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        sinks.write_batch({"metrics.csv": one.limit(1), "segments.csv": broken}, path)
    found = sinks.read_batch(spark, path)
    assert set(found) == {"metrics.csv", "none.csv"} and found["none.csv"].count() == 0
    assert found["metrics.csv"].schema == one.schema
    assert {r["name"]: (r["x"], r["n"]) for r in found["metrics.csv"].collect()} == {'a, "b"': (1.5, None), "line\ntwo": (None, 3)}


def test_no_valid_file_fails_in_the_plan(spark):
    from tractwise.operators import delta

    rows = [("d", g, f"{g}_{r}", float(x), reads, x) for g in ("Day0", "treated") for r in range(2) for x, reads in ((1, 4.0), (2, 4.0))]
    junk = spark.createDataFrame(rows, "dataset string, grp string, sample string, repeat_length double, reads double, pos int")
    with pytest.raises(Exception, match="No valid files"):
        delta.delta_table(junk, strict=True).collect()
    good = junk.withColumn("reads", junk.reads + junk.repeat_length)
    assert sorted(delta.delta_table(good, strict=True).collect()) == sorted(delta.delta_table(good).collect()) != []
