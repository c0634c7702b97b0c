"""Decision rules, windows and geometry on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import kernels as K
from quillon.operators import relational as L
from quillon.operators import resample as B
from quillon.operators import rules as RU
from quillon.operators import scoring as Y
from quillon.operators import windows as WN
from quillon.operators.curation import either_pairs, hamming_pairs, nearest, slicing
from quillon.operators.strata import restricted_pairs


def one(df):
    return df.collect()[0]


def pairs(spark, rows):
    return spark.createDataFrame([("x", *r) for r in rows], "arm string, treatment double, control double, iqr_treatment double, iqr_control double, median_treatment double, median_control double")


@pytest.mark.parametrize(
    "rows, both, exceeds, agree",
    [
        ([(0.10, 0.20, 0.01, 0.05, 0.10, 0.20), (0.30, 0.31, 0.02, 0.02, 0.30, 0.31)], True, True, True),
        ([(0.10, 0.20, 0.01, 0.05, 0.10, 0.20), (0.33, 0.31, 0.02, 0.02, 0.30, 0.31)], False, True, False),
        ([(0.19, 0.20, 0.01, 0.05, 0.21, 0.20), (0.30, 0.31, 0.02, 0.02, 0.30, 0.31)], True, False, False),
        ([(0.20, 0.20, 0.01, 0.05, 0.20, 0.20), (0.31, 0.31, 0.02, 0.02, 0.31, 0.31)], False, False, True),
    ],
)
def test_component_acceptance(spark, rows, both, exceeds, agree):
    r = one(RU.component_acceptance(pairs(spark, rows), ["arm"]))
    assert (r.both_improve, r.any_exceeds, r.accepted, r.signs_agree) == (both, exceeds, both and exceeds, agree)


def test_outcome_takes_the_larger_bar(spark):
    df = spark.createDataFrame([(0.06, 0.01, 0.05), (0.04, 0.01, 0.05), (0.04, 0.05, 0.01), (0.0, 0.1, 0.1), (-0.01, 0.1, 0.1)], "g double, t double, c double")
    got = [r.o for r in df.select(RU.outcome_label(F.col("g"), F.col("t"), F.col("c")).alias("o")).collect()]
    assert got == ["PASS", "improved, under IQR", "improved, under IQR", "no change", "WORSE"]


def test_paired_sign(spark):
    def verdict(deltas, seeds):
        df = spark.createDataFrame([("f", s, float(d)) for s, d in zip(seeds, deltas, strict=True)], "family string, seed int, delta double")
        return one(RU.paired_sign(df, ["family"])).verdict

    assert verdict([1, 1, 1, 1, 0], [0] * 5) == "accept"  # four above zero; the zero is not
    assert verdict([1, 1, 1, 0, 0], [0] * 5) == "ambiguous"  # one seed only
    assert verdict([1, 1, 1, 0, 0], [0, 0, 1, 1, 2]) == "reject"
    assert verdict([-1, -1, -1, -1, -1], [0] * 5) == "reject"


def test_floor_rule_compares_with_the_control(spark):
    arms = spark.createDataFrame([("c", 0.30, 0.10), ("a", 0.36, 0.18), ("b", 0.36, 0.20), ("d", 0.34, 0.05)], "arm string, ppv double, fpr double")
    got = {r.arm: r.accepted for r in RU.floor_rule(arms, "c").collect()}
    assert got == {"a": True, "b": False, "d": False}


def test_inner_square_adds_the_side(spark):
    row = one(spark.range(1).select(K.inner_square(F.lit(320.0), F.lit(240.0), F.lit(100.0), F.lit(640), F.lit(480)).alias("b"))).b
    assert tuple(row) == (250, 170, 391, 311)  # side 141: 249.5 and 169.5 round to even


def test_crop_box_reasons(spark):
    df = spark.createDataFrame([(None, 1.0, 50.0), (40.0, 0.8512, 50.0), (40.0, 0.95, 50.0), (40.0, 0.95, 900.0)], "r double, q double, cy double")
    got = [r.c for r in df.select(K.crop_box(F.col("r"), F.col("q"), F.lit(100), F.lit(81), F.lit(50.0), F.col("cy")).alias("c")).collect()]
    assert [g.reason for g in got] == ["no non-black pixels found", "fit_quality 0.8512 < floor 0.9040", "", "degenerate inner box (56x-791)"]
    assert tuple(got[0].box) == (20, 10, 80, 70) and got[0].fit_quality is None and got[1].used_fallback and tuple(got[2].box) == (22, 22, 78, 78)


@pytest.mark.parametrize("total, warmup, steps", [(100, 0.1, 10), (90, 0.05, 4), (37, 0.3, 11), (50, 0.0, 0), (10, 0.01, 1)])
def test_warmup(spark, total, warmup, steps):
    got = [r.f for r in spark.range(total + 5).select("id", K.warmup_cosine(F.col("id"), total, warmup).alias("f")).orderBy("id").collect()]
    assert all(got[i] == pytest.approx((i + 1) / steps) for i in range(steps)) and got[total:] == pytest.approx([0.0] * 5)
    assert got[steps] == pytest.approx(1.0)


def test_restriction_schedule(spark):
    got = [r.b for r in spark.range(12).select("id", K.restriction_schedule(F.col("id")).alias("b")).orderBy("id").collect()]
    assert got[:5] == [None] * 5 and got[5] == 1.0 and got[9:] == pytest.approx([0.15] * 3)


def test_cells_never_fall(spark):
    rng = np.random.default_rng(4)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-12, 12, 300)).tolist(), 0.0, 1.0, 2.0, 4.0, math.nextafter(4.0, 0), -2.0, 5e-324, 1e308, -1e308, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", WN.cell(F.col("v")).alias("c")).orderBy("v").collect()
    assert [r.c for r in rows] == sorted(r.c for r in rows)


def test_running_sums_with_an_outlier(spark):
    values = [1.0 + i / 1e3 for i in range(500)] + [1e12, -1e12, 1.1, 1.1]
    df = spark.createDataFrame([(("a" if i % 3 else None), v, 1) for i, v in enumerate(values)], "g string, v double, n int")
    for r in WN.running_sums(df, ["g"], "v", ["n"]).collect():
        assert r.n_to == sum(1 for i, v in enumerate(values) if (i % 3 == 0) == (r.g is None) and v >= r.v)
    assert {r.rn for r in WN.numbered(df.where("g = 'a'"), [], "-v", "g").collect()} == set(range(1, df.where("g = 'a'").count() + 1))


def test_permutation_is_never_sorted(spark):
    for seed in range(12):
        got = [r.id for r in L.permuted(spark.range(2), seed, "id").orderBy("position").collect()]
        assert got == [1, 0]
    assert [r.position for r in L.permuted(spark.range(1), 0, "id").collect()] == [1]


def test_restricted_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 5 == 0), float(np.round(rng.normal(i % 5 == 0), 1))) for i in range(200)]
    got = one(restricted_pairs(spark.createDataFrame(rows, "filepath int, label_int int, logit double"), max_fpr=0.15, pos_fraction=0.5))
    pos = sorted(v for _, y, v in rows if y)[: math.ceil(0.5 * 40)]
    neg = sorted((v for _, y, v in rows if not y), reverse=True)[: math.ceil(0.15 * 160)]
    gaps = [a - b for a in pos for b in neg]
    assert got.pairs == len(gaps) and got.step == pytest.approx(np.mean([1.0 if g > 0 else 0.5 if g == 0 else 0.0 for g in gaps]))
    assert got.hinge == pytest.approx(np.mean([max(1 - g, 0) ** 2 for g in gaps]))


def test_hamming_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    rows = [(i, int(b), int(b)) for i, b in enumerate(base)] + [(100 + i, int(b ^ np.int64((1 << (i % 15)) - 1)), int(rng.integers(0, 2**62))) for i, b in enumerate(base)] + [(500, int(base[0]), 5)]
    df = spark.createDataFrame(rows, "id int, code long, dcode long")
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    want = {(a, b): bits(x, y) for a, x, _ in rows for b, y, _ in rows if a < b and bits(x, y) <= 12}
    assert {(r.a, r.b): r.distance for r in hamming_pairs(df, df, 12).collect()} == want and len(want) > 30
    either = {(a, b) for a, x, u in rows for b, y, v in rows if a < b and (bits(x, y) <= 4 or bits(u, v) <= 2)}
    assert {(r.a, r.b) for r in either_pairs(df, df, {"code": 4, "dcode": 2}).collect()} == either
    assert slicing(10**9, 12)[1] > 0 and slicing(10, 12)[1] == 0
    near = {(r.i, r["rank"]): (r.distance, r.j) for r in nearest(df, 3, block=16, span=32).collect()}
    for i, x, _ in rows:
        order = sorted((bits(x, y), j) for j, y, _ in rows if j != i)[:3]
        assert [near[i, k + 1] for k in range(3)] == order


def test_governor_by_hand():
    g = Y.Governor(300, 100.0, hard_stop=90.0, views=2, members=3)
    steps = [g.batch(8.0, 10) for _ in range(12)]
    assert steps[:4] == [""] * 4 and steps[4:7] == ["views", "members", "over budget"]  # 8 seconds for 10 of 300
    g = Y.Governor(300, 1e9, hard_stop=90.0)
    assert [g.batch(31.0, 10) for _ in range(3)] == ["", "", "hard stop"]
    g = Y.Governor(30, 10.0, trailing=False, members=2)
    assert [g.batch(4.0, 10), g.batch(1.0, 10), g.batch(9.0, 10)] == ["members", "", ""]  # the last batch never stops


def test_probe_selection(spark):
    rows = [(f"p{i}", "a" if i < 3 else "b", 1) for i in range(40)] + [(f"n{i}", "a" if i % 4 else "b", 0) for i in range(500)]
    df = spark.createDataFrame(rows, "filepath string, centre string, label_int int")
    got = B.probe_selection(df, 100, 30, seed=1).collect()
    assert len({r.filepath for r in got}) == 100
    assert sum(r.label_int for r in got) == 30 and sum(r.label_int for r in got if r.centre == "a") == 2  # 30 * 3 / 40 = 2.25
    short = df.where("label_int = 0 or filepath < 'p2'")
    assert B.probe_selection(short, 100, 30, seed=1).count() == 100
