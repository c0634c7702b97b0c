"""Tail probabilities, models, settings and reports against known or brute-force values."""

import itertools
import math
from dataclasses import asdict, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import tails as T
from quillon.operators import models as MO
from quillon.operators.diagnostics import mann_whitney_z
from quillon.sources import reports, settings


def test_tails():
    assert T.correlation_p(0.5, 10) == pytest.approx(0.14111328125, abs=1e-9)  # t with 8 degrees: a polynomial
    assert T.correlation_p(1.0, 5) == 0.0 and T.correlation_p(float("nan"), 5) is None and T.correlation_p(0.3, 2) is None
    assert T.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert T.incomplete_gamma_tail(1.0, 2.5) == pytest.approx(math.exp(-2.5)) and T.incomplete_gamma_tail(0.5, 0.5 * 3.841458820694124) == pytest.approx(0.05, abs=1e-9)
    assert T.fisher_p(8, 2, 1, 5) == pytest.approx(0.034965034965, abs=1e-9)


def test_mann_whitney_z(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0, 6.0, 7.0]
    df = spark.createDataFrame([(v, 1) for v in x] + [(v, 0) for v in y], "v double, g int")
    r = mann_whitney_z(df, [], "v", "g").first()
    u = sum((a > b) + (a == b) / 2 for a in x for b in y)
    every = x + y
    ties = sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    var = 4 * 5 / 12 * (10 - ties / (9 * 8))
    assert r.u == u and r.z == pytest.approx((u - 10 + 0.5) / math.sqrt(var))


def test_bimodality(spark):
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1.5, 300)])
    r = MO.bimodality(spark.createDataFrame([(float(v),) for v in two] + [(None,), (float("nan"),)], "v double"), "v").first()
    assert r.n == 700 and r.bimodal and sorted(r.means) == pytest.approx([0, 8], abs=0.4) and r.ashmans_d > 4
    assert not MO.bimodality(spark.createDataFrame([(float(v),) for v in rng.normal(size=500)], "v double"), "v").first().bimodal
    assert not MO.bimodality(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").first().bimodal
    assert MO.bimodality(spark.createDataFrame([], "v double"), "v").count() == 0


def test_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    fold = np.arange(300) % 3
    df = spark.createDataFrame([(i, float(a), float(b), int(c), int(f)) for i, (a, b), c, f in zip(range(300), x, y, fold, strict=True)] + [(999, 0.0, 0.0, 1, 7)], "i int, a double, b double, y int, fold int")
    got = {r.i: r.score for r in MO.cross_validated_logistic(df, ["a", "b"], "y", "fold").collect()}
    assert 999 not in got and len(got) == 300  # a fold of one class is left out
    train = np.flatnonzero(fold != 0)
    own = np.vstack([x[train], [[0, 0]]])
    z = np.hstack([np.ones((len(own), 1)), (own - own.mean(0)) / own.std(0)])
    t, w = np.append(y[train], 1), np.zeros(3)
    for _ in range(20000):  # plain gradient descent on the same loss
        w -= 0.005 * (z.T @ (1 / (1 + np.exp(-z @ w)) - t) + np.r_[0, w[1:]])
    test = np.hstack([np.ones((100, 1)), (x[fold == 0] - own.mean(0)) / own.std(0)]) @ w
    assert [got[i] for i in np.flatnonzero(fold == 0).tolist()] == pytest.approx(test.tolist(), abs=1e-5)


def test_ward_against_all_merges(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.3, (7, 2)) for c in (0, 3, 10)])
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > 1:
        cost = lambda a, b: math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(points[a].mean(0) - points[b].mean(0))
        a, b = min(itertools.combinations(clusters, 2), key=lambda p: cost(*p))
        if cost(a, b) >= 5.0:
            break
        clusters = [c for c in clusters if c not in (a, b)] + [a + b]
    label = MO.ward(points, 5.0)
    assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == {frozenset(c) for c in clusters}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(50, *map(float, points[0])), (51, None, None)], "i int, a double, b double")
    got = {r.i: r.cluster for r in MO.ward_clusters(df, "i", ["a", "b"], 3.0).collect()}
    assert len(got) == 23 and got[50] == got[0]


def test_ward_counts_all_copies_and_takes_many_rows(spark):
    # 60,000 rows of three kinds: a kind's 20,000 copies weigh too much to merge below 3, which three single rows do.
    df = spark.range(60_000).select(F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("a"))
    sizes = MO.ward_clusters(df, "i", ["a"], 3.0).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [20_000] * 3
    assert MO.ward_clusters(df.limit(3), "i", ["a"], 3.0).select("cluster").distinct().count() == 1
    many = spark.range(50_500).select(F.col("id").alias("i"), F.col("id").cast("double").alias("a"))  # more distinct rows than once allowed
    assert MO.ward_clusters(many, "i", ["a"], 0.001).count() == 50_500


def test_ward_by_mutual_neighbours_against_chains():
    rng = np.random.default_rng(4)
    points, sizes = rng.normal(size=(400, 3)), rng.integers(1, 4, 400)
    points[:, 2] = np.round(points[:, 2])
    rows = np.repeat(np.arange(400), sizes)
    for t in (0.5, 2.0, 5.0):
        whole, weighed = MO.ward(points[rows], t), MO.ward(points, t, sizes)
        pairs = set(zip(whole.tolist(), weighed[rows].tolist(), strict=True))
        assert len(pairs) == len(set(whole.tolist())) == len(set(weighed.tolist()))
    line = np.arange(64.0)[:, None]  # equal distances everywhere
    assert len(set(MO.ward(line, 1.0).tolist())) == 64 and len(set(MO.ward(line, 1e9).tolist())) == 1


def test_forest(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(v), float(rng.normal()), int(v > 0.3), i % 2) for i, v in enumerate(rng.normal(size=120))], "i int, a double, b double, y int, fold int")
    scored, weights = MO.forest_scores(df, ["a", "b"], "y", "fold", trees=10)
    rows = scored.collect()
    assert len(rows) == 120 and weights[0][0] == "a"
    assert np.mean([(r.score > 0.5) == (r.y == 1) for r in rows]) > 0.9


def test_settings(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("loss: pauc\nepochs: 7\n")
    s = settings.read_settings(spark, str(path))
    assert s == replace(settings.Settings(), loss="pauc", epochs=7) and settings.check(s) is s
    path.write_text("nothing: 1\n")
    with pytest.raises(ValueError):
        settings.read_settings(spark, str(path))
    with pytest.raises(ValueError, match="precision"):
        settings.check(replace(s, precision="int8"))
    assert len(settings.violations(replace(s, max_fpr=0.0, warmup_frac=2.0, quality_min=101, lr=0.0))) == 4
    a = asdict(s)
    settings.check_resumable(a, a | {"magnitude_scale": 0.1})
    with pytest.raises(ValueError, match="arch"):
        settings.check_resumable(a, {k: v for k, v in a.items() if k != "arch"})


def test_reports(spark):
    df = spark.createDataFrame([("b|x", 0.5), ("a", None)], "k string, v double")
    assert reports.markdown_table(df, ["k"]) == "| k | v |\n| --- | --- |\n| a | n/a |\n| b\\|x | 0.5000 |\n"
    with pytest.raises(ValueError):
        reports.markdown_table(df, ["k"], most=1)
    assert reports.box(["abcdef"], 8) == "+------+\n| abcd |\n+------+\n" and reports.spread_text(0.5, 0.25, 2) == "0.50 (IQR 0.25)"
    put = lambda t, **k: reports.splice(t, "[", "]", "[s]", "#", **k)
    assert put("x [old] y") == "x [s] y" and put("x # y") == "x #\n[s]\n y" and put("x # y", before=True) == "x [s]\n# y" and put("x\n\n") == "x\n\n[s]\n"
    with pytest.raises(ValueError):
        reports.described(df, {"k": ("me", "key")})
    assert [r.meaning for r in reports.data_dictionary(reports.described(df, {"k": ("me", "key"), "v": ("me", "value")})).orderBy("position").collect()] == ["key", "value"]
    assert df.select(F.lit(1)).count() == 2
