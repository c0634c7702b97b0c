import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import ranking as R
from quillon.operators import windows as WN
from quillon.operators.spread import spread
from quillon.operators.strata import prior_equalised, prior_weights


def scores(seed, n_neg=300, n_pos=40, decimals=1):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n_neg, int), np.ones(n_pos, int)]
    s = np.round(np.r_[rng.normal(0, 1, n_neg), rng.normal(1.2, 1, n_pos)], decimals)
    return y, s


def frame(spark, y, s, **columns):
    return spark.createDataFrame(pd.DataFrame({"filepath": [f"f{i:05d}" for i in range(len(y))], "label_int": y, "logit": s, "g": 0} | columns))


def full_curve(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp, fp = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    return np.r_[0, tp] / y.sum(), np.r_[0, fp] / (1 - y).sum(), tp, fp


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_full_curves(spark, seed):
    y, s = scores(seed)
    tpr, fpr, tp, fp = full_curve(y, s)
    row = R.metric_block(frame(spark, y, s), ["g"]).first()
    assert row.roc_auc == pytest.approx(np.trapezoid(tpr, fpr), abs=1e-12)
    assert row.fpr_at_recall == pytest.approx(np.interp(0.9, tpr, fpr), abs=1e-12)
    precision = np.r_[1.0, tp / (tp + fp)]
    assert row.ppv_at_recall == pytest.approx(np.interp(0.9, tpr, precision), abs=1e-12)
    assert row.ap == pytest.approx(np.sum(np.diff(tpr) * (tp / (tp + fp))), abs=1e-12)
    cut = np.minimum(fpr, 0.15)
    area = np.trapezoid(np.interp(cut, fpr, tpr), cut) if len(np.unique(fpr)) == len(fpr) else None
    if area is not None:
        assert row.pauc_raw == pytest.approx(area / 0.15, abs=1e-9)


def test_one_class_gives_null(spark):
    row = R.metric_block(frame(spark, np.zeros(20, int), np.linspace(0, 1, 20)), ["g"]).first()
    assert row.roc_auc is None and row.ap is None and row.fpr_at_recall is None


def test_perfect_and_monotone(spark):
    y, s = scores(5, decimals=6)
    a = R.metric_block(frame(spark, y, s), ["g"]).first()
    b = R.metric_block(frame(spark, y, np.exp(s)), ["g"]).first()
    assert a.roc_auc == pytest.approx(b.roc_auc) and a.fpr_at_recall == pytest.approx(b.fpr_at_recall)
    p = R.metric_block(frame(spark, y, y.astype(float)), ["g"]).first()
    assert p.roc_auc == 1.0 and p.fpr_at_recall == 0.0


def test_the_four_rates_are_different_operators(spark):
    y, s = scores(1)
    df = frame(spark, y, s)
    attainable = R.curve(df, ["g"]).groupBy("g").agg(R.fpr_attainable().alias("x")).first().x
    thr = np.sort(s[y == 1])[::-1][int(np.ceil(0.9 * y.sum())) - 1]
    assert attainable == pytest.approx(np.mean(s[y == 0] >= thr))
    ranked = R.ordered(df, ["g"]).groupBy("g").agg(R.fpr_ranked().alias("x"), R.fpr_recall_search().alias("z")).first()
    order = np.lexsort((np.arange(len(s)), -s))
    tp = np.cumsum(y[order])
    i = np.searchsorted(tp, np.ceil(0.9 * y.sum()))
    assert ranked.x == pytest.approx((i + 1 - tp[i]) / (1 - y).sum()) and ranked.z <= attainable


def test_ranks_match_pandas(spark):
    y, s = scores(2)
    df = frame(spark, y, s)
    want = pd.Series(s)
    got = WN.average_rank(df, ["g"], "logit").orderBy("filepath").toPandas().avg_rank
    assert np.allclose(got, want.rank())
    got = WN.percent_rank(df, [], "logit").orderBy("filepath").toPandas().pct_rank
    assert np.allclose(got, want.rank(pct=True))
    got = WN.competition_rank(df, ["g"], "logit").orderBy("filepath").toPandas()["rank"]
    assert (got == want.rank(ascending=False, method="min")).all()


def test_spread_ignores_what_is_not_finite(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, float("nan")), (0, float("inf")), (0, None), (1, 2.0)], "g int, v double")
    rows = {r.g: r for r in spread(df, ["g"], "v").collect()}
    assert (rows[0].n, rows[0].median, rows[0].width) == (2, 2.0, 2.0) and rows[0].sd == pytest.approx(2**0.5)
    assert rows[1].sd == 0.0


def test_prior_equalised_by_hand(spark):
    # Ratios of negatives to positives are 12 / 3 and 9 / 6, so a's negatives weigh 1.5 * 3 / 12 each and b's weigh 1.
    rows = [("a", 1, 0.5)] * 3 + [("b", 1, 0.5)] * 6 + [("a", 0, 0.7)] * 3 + [("a", 0, -1.0)] * 9 + [("b", 0, 0.7)] * 3 + [("b", 0, -1.0)] * 6
    df = spark.createDataFrame([(f"f{i}", *r, 0) for i, r in enumerate(rows)], "filepath string, centre string, label_int int, logit double, g int")
    w = prior_weights(df, "centre")
    assert {r.centre: r.weight for r in w.collect()} == pytest.approx({"a": 0.375, "b": 1.0})
    r = prior_equalised(df, ["g"], "centre", w).first()
    assert r.fpr == pytest.approx((3 * 0.375 + 3) / 13.5) and r.effective_n == pytest.approx(13.5)
    with pytest.raises(Exception, match="two strata"):
        prior_weights(df.where(F.col("centre") == "a"), "centre").collect()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "filepath string, label_int int, logit double, g int")
    assert R.metric_block(df, ["g"]).count() == 0 and WN.average_rank(df, ["g"], "logit").count() == 0


def test_prior_equalised_bootstrap_keeps_the_anchor_in_full(spark):
    from quillon.operators import resample

    # anchor a: 10 positives, 40 negatives; b: 10 positives, 101 negatives, of which 40 are drawn.
    rows = [(c, f"{c}{y}{k}", y, float(y) + k / 100) for c, y, n in (("a", 1, 10), ("a", 0, 40), ("b", 1, 10), ("b", 0, 101)) for k in range(n)]
    df = spark.createDataFrame(rows, "centre string, filepath string, label_int long, logit double")
    got = resample.prior_equalised_bootstrap(df, "centre", draws=50, recall=1.0).collect()  # the threshold is 1.0: one negative, of b
    assert sorted(r.draw for r in got) == list(range(50)) and {r.n for r in got} == {80}
    assert {round(r.fpr * 80) for r in got} == {0, 1}
    low = df.withColumn("logit", F.when(F.col("centre") == "a", F.lit(2.0)).otherwise(F.col("logit") - 9))
    assert {r.fpr for r in resample.prior_equalised_bootstrap(low, "centre", draws=3, recall=0.5).collect()} == {0.5}  # all of the anchor, none of b


def test_simulations_are_registered_with_all_draws(spark, monkeypatch):
    from quillon.operators import resample
    from quillon.plans import registry

    registry.load()
    seen = {}

    class Stop(Exception):
        pass

    def spy(*args, draws=None, **_):
        seen["draws"] = args[2] if draws is None else draws
        raise Stop

    for name in ("prevalence_bootstrap", "auc_bootstrap", "prior_equalised_bootstrap", "offset_simulation"):
        monkeypatch.setattr(resample, name, spy)
    want = {"b01_prevalence_bootstrap_full": 1000, "b01_official_score_full": 1000, "b02_auc_bootstrap": 2000, "b03_prior_equalised_bootstrap": 1000, "b09_offset_simulation": 1000, "b10_bisection": 400}
    for query, draws in want.items():
        with pytest.raises(Stop):
            registry.QUERIES[query](spark, "/root/testdata/sf0.001")
        assert seen.pop("draws") == draws


def test_prevalence_bootstrap_without_broadcast_picks(spark):
    from quillon.operators.resample import prevalence_bootstrap

    rows = [(g, int(k % 13 == 0), (k * 37 % 101) / 8 + (k % 13 == 0) * g) for g in (0, 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, label_int long, logit double")
    kept = prevalence_bootstrap(df, by=["g"], draws=40, seed=5)
    joined = prevalence_bootstrap(df, by=["g"], draws=40, seed=5, most=0)
    tidy = lambda d: sorted(tuple(round(v, 12) for v in r) for r in d.collect())
    assert tidy(kept) == tidy(joined) and kept.count() == 80 and kept.dtypes == joined.dtypes
    one = prevalence_bootstrap(df.where("g = 1"), draws=40, seed=5)
    assert tidy(one) == [r[1:] for r in tidy(kept) if r[0] == 1]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (one, prevalence_bootstrap(df.where("g = 1"), draws=40, seed=5, most=0))]
    assert "Join" not in plans[0] and not any("BroadcastHashJoin" in x and "index" in x for x in plans[1].splitlines())
    assert prevalence_bootstrap(df.where("label_int = 0"), draws=4, by=["g"]).collect() == []
    assert [r.roc_auc for r in prevalence_bootstrap(df.where("label_int = 1"), draws=2).collect()] == [None, None]


@pytest.mark.parametrize("name, key", [("b11_official_sweep", "shift"), ("m25_pooled_gate", "arm")])
def test_arms_share_one_bootstrap(spark, monkeypatch, name, key):
    from quillon.operators import resample
    from quillon.plans import registry

    registry.load()
    calls, real = [], resample.prevalence_bootstrap
    monkeypatch.setattr(resample, "prevalence_bootstrap", lambda *a, **k: calls.append(k["draws"]) or real(*a, **k))
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert calls == [1000] and sorted(r[key] for r in rows) == {"shift": [0.0, 0.5, 1.0], "arm": [0, 1, 2]}[key]


def _scores(spark, rows: int = 1200):
    return spark.createDataFrame([(f"f{k}", int(k % 6 == 0), (k * 37 % 101) / 40 + (k % 6 == 0)) for k in range(rows)], "filepath string, label_int long, logit double")


def test_auc_bootstrap_draws_tie_groups(spark):
    import numpy as np
    from quillon.operators.resample import auc_bootstrap

    df = _scores(spark)
    got = auc_bootstrap(df, draws=400, seed=2)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each row and draw
    at = {r.draw: r.roc_auc for r in got.collect()}
    again = {r.draw: r.roc_auc for r in auc_bootstrap(df.union(df.limit(0)).repartition(7), draws=400, seed=2).collect()}
    assert sorted(at) == list(range(400)) and at == pytest.approx(again)
    rows = df.collect()
    y, v = np.array([r.label_int for r in rows]), np.array([r.logit for r in rows])
    rng = np.random.default_rng(0)

    def auc(w):
        a, b = v[y == 1][:, None], v[y == 0][None]
        return (w[y == 1] @ ((a > b) + (a == b) / 2.0) @ w[y == 0]) / w[y == 1].sum() / w[y == 0].sum()

    want = [auc(rng.poisson(1, len(v))) for _ in range(400)]
    assert np.mean(list(at.values())) == pytest.approx(np.mean(want), abs=0.004)
    assert np.std(list(at.values())) == pytest.approx(np.std(want), rel=0.2)
    assert [r.roc_auc for r in auc_bootstrap(df.where("label_int = 1"), draws=3).collect()] == [None] * 3
    equal = df.withColumn("logit", F.lit(1.0))
    assert {r.roc_auc for r in auc_bootstrap(equal, draws=3).collect()} == {0.5}


def test_offset_simulation_draws_tie_groups(spark):
    import numpy as np
    from quillon.operators import resample

    df = _scores(spark)
    grid = spark.createDataFrame([(3, 0.5), (1, 2.0)], "k long, sd double")
    got = resample.offset_simulation(df, grid, 150)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each row and draw
    whole = {k: sorted(r.roc_auc for r in got.where(F.col("k") == k).collect()) for k in (1, 3)}
    rows = resample.offset_simulation(df, grid, 150, most=0).collect()
    old = {k: [r.roc_auc for r in rows if r.k == k] for k in (1, 3)}
    assert len(whole[3]) == len(old[3]) == 150
    assert whole[1] == pytest.approx(old[1], abs=1e-9)  # one centre moves nothing
    assert np.median(whole[3]) == pytest.approx(np.median(old[3]), abs=0.01) and np.std(whole[3]) == pytest.approx(np.std(old[3]), rel=0.2)
    sd, top, at_top, steps = resample.sd_for_target(df, 3, 0.7, draws=60)
    assert sd is not None and at_top <= 0.7 and steps < 25


def test_counts_auc_by_hand():
    import numpy as np
    from quillon.operators.resample import _counts_auc

    v = np.array([1.0, np.nan, 0.0, np.nan, -np.inf])
    # positives: 2 at 1, 1 at NaN (the largest); negatives: 1 at NaN, 3 at 0, 1 at minus infinity.
    assert _counts_auc(v, np.array([2, 1, 0, 0, 0]), np.array([0, 0, 3, 1, 1])) == pytest.approx((2 * 4 + 4.5) / 15)
    assert _counts_auc(v, np.zeros(5, int), np.ones(5, int)) is None
