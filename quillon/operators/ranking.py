"""Ranking metrics from tie groups.

Every metric is an aggregate over `curve`: one row per group and distinct score with the positives and negatives at the
score and at or above it. Ties are exact by construction, and grouping keys replace loops over folds, seeds and arms.
The four definitions of a false-positive rate at a recall differ on ties and are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import FINE, running_sums

RECALL = 0.9
MAX_FPR = 0.15


def _known(count: str) -> Column:
    """A divisor that is null where a class is missing, so that ANSI mode raises nothing."""
    return F.nullif(F.col(count), F.lit(0))


def curve(df: DataFrame, by: list[str], *, label: str = "label_int", score: str = "logit", fine: int = FINE) -> DataFrame:
    """by, score, pos, neg (at the score), tp, fp (at or above it), P, N (of the group)."""
    ties = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    run = running_sums(ties, by, "score", ["pos", "neg"], fine=fine).withColumnsRenamed({"pos_to": "tp", "neg_to": "fp"})
    totals = df.groupBy(*by).agg(F.sum(F.col(label)).cast("long").alias("P"), F.sum(1 - F.col(label)).cast("long").alias("N"))
    return run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))  # one row


def _of_classes(c: Column) -> Column:
    """Null where one class is missing."""
    return F.when((F.max("P") > 0) & (F.max("N") > 0), c)


def auc() -> Column:
    return _of_classes(F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)) / (F.max("P").cast("double") * F.max("N")))


def average_precision() -> Column:
    return _of_classes(F.sum(F.when(F.col("pos") > 0, F.col("pos") / _known("P") * F.col("tp") / (F.col("tp") + F.col("fp")))))


def _bracket(recall: float) -> tuple[Column, Column]:
    """The tie group in which the recall is reached, and how far into it."""
    k0, k1 = (F.col("tp") - F.col("pos")) / _known("P"), F.col("tp") / _known("P")
    return (F.col("pos") > 0) & (k0 <= recall) & (k1 > recall), (recall - k0) / (F.col("pos") / _known("P"))


def fpr_interp(recall: float = RECALL) -> Column:
    """(a) Linear interpolation on the curve; at an exact hit, the larger rate."""
    here, w = _bracket(recall)
    return _of_classes(F.max(F.when(here, (F.col("fp") - F.col("neg") + w * F.col("neg")) / _known("N"))))


def ppv_interp(recall: float = RECALL) -> Column:
    here, w = _bracket(recall)
    k0, g = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    start = F.when(k0 + g > 0, k0 / (k0 + g)).otherwise(1.0)
    return _of_classes(F.max(F.when(here, start + w * (F.col("tp") / (F.col("tp") + F.col("fp")) - start))))


def needed(recall: float) -> Column:
    """The number of positives that a recall needs."""
    return F.least(F.ceil(F.lit(recall) * F.col("P")), F.col("P"))


def threshold(recall: float = RECALL) -> Column:
    """The score of the k-th best positive, k = ceil(recall * P)."""
    return F.max(F.when((F.col("tp") >= needed(recall)) & (F.col("pos") > 0), F.col("score")))


def fpr_attainable(recall: float = RECALL) -> Column:
    """(b) Negatives at or above the attainable threshold."""
    return _of_classes(F.min(F.when(F.col("tp") >= needed(recall), F.col("fp") / _known("N"))))


def ordered(df: DataFrame, by: list[str], *, label: str = "label_int", score: str = "logit", id: str = "filepath") -> DataFrame:
    """by, tp, rows_to (positives and rows up to here), P, N, in the total order of score (falling) and id.

    Rows of one score are numbered within their tie group; the rows before them come from the curve.
    """
    from pyspark.sql import Window as W

    inner = W.partitionBy(*by, score).orderBy(id)
    rows = df.select(*by, F.col(score).alias("score"), F.sum(label).over(W.partitionBy(*by, score).orderBy(id).rowsBetween(W.unboundedPreceding, 0)).alias("tp_in"), F.row_number().over(inner).alias("n_in"))
    c = curve(df, by, label=label, score=score).select(*by, "score", (F.col("tp") - F.col("pos")).alias("tp_before"), (F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")).alias("n_before"), "P", "N")
    return rows.join(c, [*by, "score"]).select(*by, "score", (F.col("tp_in") + F.col("tp_before")).alias("tp"), (F.col("n_in") + F.col("n_before")).alias("rows_to"), "P", "N")


def fpr_ranked(recall: float = RECALL) -> Column:
    """(c) Over `ordered`: cuts inside ties, at the row where ceil(recall * P) positives are reached."""
    return _of_classes(F.min(F.when(F.col("tp") >= F.ceil(F.lit(recall) * F.col("P")), (F.col("rows_to") - F.col("tp")) / _known("N"))))


def ppv_ranked(recall: float = RECALL) -> Column:
    return _of_classes(F.min_by(F.when(F.col("tp") >= F.ceil(F.lit(recall) * F.col("P")), F.col("tp") / F.col("rows_to")), F.when(F.col("tp") >= F.ceil(F.lit(recall) * F.col("P")), F.col("rows_to"))))


def fpr_recall_search(recall: float = RECALL) -> Column:
    """(d) Over `ordered`: the first row whose recall, as a floating-point quotient, is large enough."""
    return _of_classes(F.min(F.when(F.col("tp") / _known("P") >= recall, (F.col("rows_to") - F.col("tp")) / _known("N"))))


def partial_auc(max_fpr: float = MAX_FPR) -> tuple[Column, Column]:
    """Raw area up to max_fpr (over max_fpr's range) and its McClish standardisation."""
    f0, f1 = (F.col("fp") - F.col("neg")) / _known("N"), F.col("fp") / _known("N")
    t0, t1 = (F.col("tp") - F.col("pos")) / _known("P"), F.col("tp") / _known("P")
    end = F.least(f1, F.lit(max_fpr))
    w = (end - f0) / (f1 - f0)
    raw = F.sum(F.when((f0 < max_fpr) & (F.col("neg") > 0), (end - f0) * (2 * t0 + w * (t1 - t0)) / 2.0).otherwise(0.0))
    low = max_fpr * max_fpr / 2
    return _of_classes(raw / max_fpr), _of_classes(0.5 * (1 + (raw - low) / (max_fpr - low)))


def operating_point(recall: float = RECALL) -> dict[str, Column]:
    """The attainable recalls around a target, and the false-positive rates there."""
    up, down = F.ceil(F.lit(recall) * F.col("P")), F.floor(F.lit(recall) * F.col("P"))
    at = lambda k: F.min(F.when(F.col("tp") >= k, F.col("fp") / _known("N")))
    return {
        "tp_ceil": F.max(up).cast("long"),
        "tp_floor": F.max(down).cast("long"),
        "fpr_ceil": at(up),
        "fpr_floor": at(down),
        "recall_step": F.max(1.0 / _known("P")),
        "fpr_step": F.max(1.0 / _known("N")),
    }


def ppv_projection(fpr: Column, recall: float = RECALL, positives: int = 232, negatives: int = 23176) -> Column:
    """Precision that a false-positive rate means at a stated prevalence."""
    return recall * positives / (recall * positives + fpr * negatives)


def metric_block(df: DataFrame, by: list[str], *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """n, positives, negatives, prevalence and all curve metrics of each group, in one plan."""
    raw, std = partial_auc()
    c = curve(df, by, label=label, score=score)
    out = c.groupBy(*by).agg(
        (F.max("P") + F.max("N")).alias("n"),
        F.max("P").alias("n_pos"),
        F.max("N").alias("n_neg"),
        (F.max("P") / (F.max("P") + F.max("N"))).alias("prevalence"),
        auc().alias("roc_auc"),
        raw.alias("pauc_raw"),
        std.alias("pauc"),
        average_precision().alias("ap"),
        ppv_interp().alias("ppv_at_recall"),
        fpr_interp().alias("fpr_at_recall"),
    )
    return out.withColumn("ppv_projected", ppv_projection(F.col("fpr_at_recall")))
