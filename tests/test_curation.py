import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import curation as C
from quillon.operators import diagnostics as D
from quillon.operators import ensemble as E
from quillon.operators import relational as L
from quillon.operators import resample as B
from quillon.operators import rules as RU
from quillon.operators import scoring as Y
from quillon.sources.predictions import conformed, read_predictions, write_predictions


def codes(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (20, 64))
    bits = base[rng.integers(0, 20, n)] ^ (rng.random((n, 64)) < 0.05)
    values = [int("".join(map(str, b)), 2) for b in bits]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    return spark.createDataFrame(list(enumerate(values)), "id long, code long"), bits


def test_hamming_pairs_and_components(spark):
    df, bits = codes(spark)
    d = (bits[:, None] != bits[None]).sum(2)
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if d[i, j] <= 6}
    pairs = C.hamming_pairs(df, df, 6)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    got = {r.id: r.label for r in C.connected_components(df, pairs.select("a", "b")).collect()}
    assert got == {i: find(i) for i in range(len(bits))}


def test_folds_keep_groups_together(spark):
    rows = [(i % 40, int(i % 11 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "group_id long, label_int int")
    f = C.group_folds(df, 2, 5)
    assert f.groupBy("repeat", "group_id").count().where("count > 1").count() == 0 and f.count() == 80
    checks = {r.check: r for r in C.verify_folds(df.join(f.where("repeat = 0"), "group_id"), "fold").collect()}
    assert checks["leaks"].holds


def test_constraints_fail_when_computed(spark):
    df = spark.createDataFrame([(1, 2), (1, 2)], "k int, v int")
    checks = C.unique_key(df, ["k"])
    assert checks.first().violations == 1
    with pytest.raises(Exception, match="not unique"):
        C.require(df, checks, "not unique").collect()
    with pytest.raises(Exception, match="differ"):
        L.aligned_join(df.withColumn("k", F.monotonically_increasing_id()), df.withColumn("k", F.lit(7)), ["k"], "v").collect()


def test_dump_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "c", "x", 1, None, "g", 0, 1, 2, 0.123456789012345)], "filepath string, centre string, class_label string, label_int int, visibility string, group_id_v2 string, repeat int, fold int, seed int, logit double")
    write_predictions(df, f"file://{tmp_path}/d")
    assert read_predictions(spark, f"file://{tmp_path}/d").first().logit == 0.123456789012345
    with pytest.raises(Exception, match="not finite"):
        conformed(df.withColumn("logit", F.lit(float("nan")))).collect()


def test_acceptance_fails_without_a_bar(spark):
    rows = [("a", 0.1, 0.2, 0.05, 0.05), ("a", 0.15, 0.16, 0.05, 0.05), ("b", 0.1, 0.2, None, None), ("b", 0.1, 0.2, None, None)]
    pairs = spark.createDataFrame(rows, "arm string, treatment double, control double, iqr_treatment double, iqr_control double")
    pairs = pairs.withColumn("median_treatment", F.col("treatment")).withColumn("median_control", F.col("control"))
    assert {r.arm: r.accepted for r in RU.component_acceptance(pairs, ["arm"]).collect()} == {"a": True, "b": False}


def test_fill_and_tail(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, None), (3, 1.0)], "i int, s double").withColumn("g", F.lit(0))
    got = [r.s for r in Y.fill_unscored(df, ["g"], "i", "s").orderBy("i").collect()]
    assert got == pytest.approx([2.0, 0.0, -1e-6, 1.0])
    p = spark.createDataFrame([(3, 16, 45, 158)], "k int, n int, g int, t int").select(D.hypergeometric_tail(F.col("k"), F.col("n"), F.col("g"), F.col("t")).alias("p")).first().p
    from math import comb

    assert p == pytest.approx(sum(comb(45, x) * comb(113, 16 - x) for x in range(3, 17)) / comb(158, 16))


def test_bootstrap_holds_the_point_estimate(spark):
    rng = np.random.default_rng(3)
    rows = [(f"n{i}", 0, float(x)) for i, x in enumerate(rng.normal(0, 1, 500))] + [(f"p{i}", 1, float(x)) for i, x in enumerate(rng.normal(1.5, 1, 60))]
    df = spark.createDataFrame(rows, "filepath string, label_int int, logit double")
    s = {r.metric: r for r in B.summary(B.prevalence_bootstrap(df, draws=100), ["roc_auc", "ap", "ppv"]).collect()}
    y, v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    auc = (v[y == 1][:, None] > v[y == 0][None]).mean()
    assert s["roc_auc"].lo <= auc <= s["roc_auc"].hi and s["ppv"].n == 100


def test_ensemble_needs_all_members(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)], "id string, seed long, logit double")
    assert E.mean_ensemble(df.where("id = 'a'"), ["id"], "logit", 2).first().logit == 1.5
    with pytest.raises(Exception, match="lacks a member"):
        E.mean_ensemble(df, ["id"], "logit", 2).collect()
