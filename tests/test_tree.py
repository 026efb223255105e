import numpy as np
import pytest

from tractwise.plans.tree import tree_batch


@pytest.fixture(scope="module")
def batch(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(30):
        shift = .1 if i < 14 else -.1 if i < 28 else 0.0
        rows += [(f"s{i:02d}", j, float(v)) for j, v in enumerate(rng.normal(shift, .02, 40))]
    rows += [("short", 0, 0.5)]
    series = spark.createDataFrame(rows, "dataset string, pos int, delta double")
    return tree_batch(series, neutral_tau=0.02)


def test_split_and_clusters(batch):
    train = {r["dataset"]: r for r in batch.train.collect()}
    assert len(train) == 24
    for name, r in train.items():
        if int(name[1:]) < 28:
            assert r["cluster_name"] == ("expansion" if int(name[1:]) < 14 else "contraction")
    assert batch.merges.count() == 23


def test_test_scores(batch):
    assert batch.auc.first()["auc"] == 1.0
    table = {(r["true_label"], r["pred_cluster"]): r["n"] for r in batch.confusion.collect()}
    assert len(table) == 4 and table[("expansion", "contraction")] == 0
    assert all(-1 <= r["width"] <= 1 for r in batch.silhouette.collect())


def test_result_table_keeps_every_dataset(batch):
    rows = {r["dataset"]: r for r in batch.results.collect()}
    assert len(rows) == 30 and "short" not in rows
    assert all((r["score"] is None) == (r["split"] == "train") for r in rows.values())
    z = batch.z_all.first().asDict()
    assert " / " in z["split_label"]
