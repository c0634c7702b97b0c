"""Bounded-time ordered scoring: projections, the governor and the fill of unscored items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import numbered, running_sums


def progress(batches: DataFrame, by: list[str], total: Column) -> DataFrame:
    """Items and seconds so far, the rate, and the seconds left at that rate."""
    run = running_sums(batches, by, "batch", ["n_items", "seconds"], descending=False).withColumnsRenamed({"n_items_to": "done", "seconds_to": "elapsed"})
    return run.withColumn("rate", F.try_divide(F.col("done"), F.col("elapsed"))).withColumn("eta", F.try_divide(total - F.col("done"), F.col("rate")))


def projection(batches: DataFrame, by: list[str], total: Column, widths: tuple[int, int] = (2, 4), after: int = 5) -> DataFrame:
    """The projected end from trailing windows: the smaller of the widths' projections, from batch `after` on."""
    run = progress(batches, by, total)
    order = W.partitionBy(*by).orderBy("batch")
    ends = []
    for k in widths:
        w = order.rowsBetween(-(k - 1), 0)
        ends.append(F.col("elapsed") + (total - F.col("done")) * F.try_divide(F.sum("seconds").over(w), F.sum("n_items").over(w)))
    return run.withColumn("projected", F.when(F.row_number().over(order) >= after, F.least(*ends)))


def first_over(batches: DataFrame, by: list[str], limit: float) -> DataFrame:
    """The first batch at which the seconds so far pass a hard limit."""
    return running_sums(batches, by, "batch", ["seconds"], descending=False).where(F.col("seconds_to") > limit).groupBy(*by).agg(F.min("batch").alias("batch"))


def fill_unscored(df: DataFrame, by: list[str], index: str, score: str) -> DataFrame:
    """Unscored items rank last with distinct scores: (least score - 1, or -10) minus i * 1e-6 by rising index."""
    floor = df.groupBy(*by).agg((F.coalesce(F.min(score) - 1.0, F.lit(-10.0))).alias("floor__"))
    missing = numbered(df.withColumn("m__", F.col(score).isNull()), [*by, "m__"], index, name="i__")
    j = missing.join(floor, by) if by else missing.crossJoin(F.broadcast(floor))  # one row
    return j.withColumn(score, F.coalesce(F.col(score), F.col("floor__") - (F.col("i__") - 1) * 1e-6)).drop("m__", "i__", "floor__")


def govern(batches: Column, budget: float, passes: int) -> Column:
    """Fold over an ordered array of (seconds a pass): a ladder that drops to one pass, then stops, when the projected end
    passes the budget; returns (elapsed, covered, passes, stopped)."""
    total = F.size(batches)
    start = F.struct(F.lit(0.0).alias("elapsed"), F.lit(0).alias("covered"), F.lit(passes).alias("passes"), F.lit(False).alias("stopped"))

    def step(s, b):
        elapsed = s["elapsed"] + b * s["passes"]
        covered = s["covered"] + 1
        over = elapsed / covered * total > budget
        now = F.struct(
            elapsed.alias("elapsed"), covered.alias("covered"), F.when(over & (s["passes"] > 1), 1).otherwise(s["passes"]).alias("passes"), (over & (s["passes"] == 1) & (elapsed + b > budget)).alias("stopped")
        )
        return F.when(s["stopped"], s).otherwise(now)

    return F.aggregate(batches, start, step)


def median_of_passes(df: DataFrame, item: str, ms: str) -> DataFrame:
    """The median time of each item over its passes."""
    return df.groupBy(item).agg(F.percentile(ms, F.lit(0.5)).alias(ms))


class Governor:
    """Decides after each batch of one run whether to go on, to do less, or to stop.

    Trailing: nothing before five batches, then the smaller of the ends projected from the last two and the last four
    batches; a hard stop comes before any projection. Cumulative: the end at the mean rate so far, from the first batch.
    Over the budget, one step is taken a batch: views to one, then members to one, then stop.
    """

    def __init__(self, total: int, budget: float, *, trailing: bool = True, hard_stop: float = float("inf"), views: int = 1, members: int = 5, after: int = 5):
        self.total, self.budget, self.trailing, self.hard_stop, self.after = total, budget, trailing, hard_stop, after
        self.views, self.members, self.elapsed, self.seen = views, members, 0.0, 0
        self.log: list[tuple[float, int]] = []
        self.stopped = ""

    def projected(self) -> float | None:
        if not self.trailing:
            spans = [self.log]
        elif len(self.log) < self.after:
            return None
        else:
            spans = [self.log[-2:], self.log[-4:]]
        ends = [self.elapsed + (self.total - self.seen) * sum(t for t, _ in x) / max(1, sum(n for _, n in x)) for x in spans]
        return min(ends)

    def batch(self, seconds: float, items: int) -> str:
        """What follows from a batch: "", "views", "members" or the reason of the stop."""
        self.elapsed += seconds
        self.seen += items
        self.log.append((seconds, items))
        if self.seen >= self.total:
            return ""
        if self.elapsed > self.hard_stop:
            self.stopped = "hard stop"
            return self.stopped
        end = self.projected()
        if end is None or end <= self.budget:
            return ""
        if self.views > 1:
            self.views = 1
            return "views"
        if self.members > 1:
            self.members = 1
            return "members"
        self.stopped = "over budget"
        return self.stopped


def _runs(df: DataFrame, by: list[str], make, row, schema: str, pass_seconds: float) -> DataFrame:
    """Every run (its batches in order, a row a batch in one task) under the governors that make(total) gives."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("batch"), []
        key = tuple(pdf[k].iloc[0] for k in by)
        for name, g in make(int(pdf.n_items.sum())):
            steps = []
            for batch, items, seconds in zip(pdf.batch.tolist(), pdf.n_items.tolist(), pdf.seconds.tolist(), strict=True):
                action = g.batch(seconds + items * (g.views * g.members - 1) * pass_seconds, int(items))
                steps.append((batch, action))
                if g.stopped:
                    break
            out += [(*key, *r) for r in row(name, g, steps)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy(*by).applyInPandas(one, schema)


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in df.select(*by).dtypes)


def ladder(df: DataFrame, by: list[str], *, budget: float, hard_stop: float, views: int, members: int, pass_seconds: float = 0.002) -> DataFrame:
    """by, batch, step, elapsed, seen of every batch at which a run's governor did something.

    seconds are a batch's at one pass; every further pass (views times members) costs pass_seconds an item.
    """
    make = lambda total: [("", Governor(total, budget, hard_stop=hard_stop, views=views, members=members))]
    row = lambda _, g, steps: [(b, a, round(g.elapsed, 6), g.seen) for b, a in steps if a]
    return _runs(df, by, make, row, f"{_keys(df, by)}, batch long, step string, elapsed double, seen long", pass_seconds)


def governors(df: DataFrame, by: list[str], *, budget: float, limit: float, passes: int, pass_seconds: float = 0.002) -> DataFrame:
    """Each run under the cumulative and the trailing governor: share of items scored, seconds, stop, and whether the
    platform's limit would have ended it."""
    make = lambda total: [("cumulative", Governor(total, budget, trailing=False, members=passes)), ("trailing", Governor(total, budget, hard_stop=budget * 8 / 9, members=passes))]
    row = lambda name, g, steps: [(name, len(steps), g.seen / g.total if g.total else 1.0, round(g.elapsed, 6), g.stopped, bool(g.elapsed > limit and not g.stopped))]
    return _runs(df, by, make, row, f"{_keys(df, by)}, governor string, batches long, coverage double, elapsed double, stopped string, killed boolean", pass_seconds)
