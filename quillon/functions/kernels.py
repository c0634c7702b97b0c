"""Image kernels: scalar geometry as expressions, pixel work as Arrow functions over flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_square(cx: Column, cy: Column, radius: Column, width: Column, height: Column) -> Column:
    """The square inscribed in a circle: left, top, right, bottom.

    The corner is rounded half to even and the side added to it; then both are clamped to the image.
    """
    side = F.floor(radius * F.sqrt(F.lit(2.0))).cast("long")
    left, top = F.bround(cx - side / 2).cast("long"), F.bround(cy - side / 2).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(
        F.greatest(left, zero).alias("left"), F.greatest(top, zero).alias("top"), F.least(left + side, width.cast("long")).alias("right"), F.least(top + side, height.cast("long")).alias("bottom")
    )


def centred_square(width: Column, height: Column, share: float = 0.75) -> Column:
    """The centred square of a share of the shorter side, at least one pixel."""
    side = F.greatest(F.floor(share * F.least(width, height)), F.lit(1)).cast("long")
    left, top = F.floor((width - side) / 2).cast("long"), F.floor((height - side) / 2).cast("long")
    return F.struct(left.alias("left"), top.alias("top"), (left + side).alias("right"), (top + side).alias("bottom"))


def crop_box(radius: Column, fit_quality: Column, width: Column, height: Column, cx: Column, cy: Column, floor: float = 0.904) -> Column:
    """box, used_fallback, fit_quality, reason: the inner square, or the centred square where there is no content (a null
    radius), the fit is poor, or the inner square is empty."""
    box = inner_square(cx, cy, radius, width, height)
    w, h = box["right"] - box["left"], box["bottom"] - box["top"]
    reason = (
        F.when(radius.isNull(), "no non-black pixels found")
        .when(fit_quality < floor, F.format_string(f"fit_quality %.4f < floor {floor:.4f}", fit_quality))
        .when((w <= 0) | (h <= 0), F.format_string("degenerate inner box (%dx%d)", w, h))
        .otherwise("")
    )
    return F.struct(F.when(reason == "", box).otherwise(centred_square(width, height)).alias("box"), (reason != "").alias("used_fallback"), F.when(radius.isNotNull(), fit_quality).alias("fit_quality"), reason.alias("reason"))


def scaled_magnitude(value: Column, identity: Column, scale: float, *, whole: bool = False, count: bool = False, applied: Column | None = None) -> Column:
    """A magnitude moved towards its identity; whole numbers are rounded half to even; a count is divided by scale ** 2
    instead (and kept at scale 0). Rows on which it was applied before, and all at scale 1, stay."""
    moved = (value / (scale * scale) if scale > 0 else value) if count else identity + scale * (value - identity)
    moved = F.bround(moved) if whole else moved
    moved = value if scale == 1.0 else moved
    return moved if applied is None else F.when(applied, value).otherwise(moved)


def consensus(votes: Column, need: int = 3) -> Column:
    """Per position, whether at least `need` of the masks (arrays of 0 / 1) agree."""
    n = F.size(F.get(votes, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(votes, F.lit(0), lambda s, m: s + F.get(m, i)) >= need)


def warmup_cosine(step: Column, total: int, warmup: float) -> Column:
    """Learning-rate factor: linear over round(warmup * total) steps (one at least, none for a warm-up of 0), then half a
    cosine down to 0, where it stays."""
    w = max(1, round(total * warmup)) if warmup > 0 else 0
    progress = F.least(F.greatest((step - w) / F.lit(float(max(1, total - w))), F.lit(0.0)), F.lit(1.0))
    cosine = 0.5 * (1 + F.cos(F.lit(np.pi) * progress))
    return F.when(step < w, (step + 1) / F.lit(float(w))).otherwise(cosine) if w else cosine


def restriction_schedule(epoch: Column, target: float = 0.15, warmup: int = 5, anneal: int = 5) -> Column:
    """The share of negatives that a restricted loss uses: null during the warm-up, then linear from 1 to the target."""
    t = F.least((epoch - warmup) / F.lit(float(max(1, anneal - 1))), F.lit(1.0)) if anneal > 1 else F.lit(1.0)
    return F.when(epoch >= warmup, 1.0 + t * (target - 1.0))


def _plane(flat, side: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(side, -1)


def average_hash(gray: np.ndarray) -> int:
    """64 bits: cells of an 8 x 8 mean-pooled image that are above their mean."""
    small = _pooled(gray, 8, 8)
    return _bits(small > small.mean())


def difference_hash(gray: np.ndarray) -> int:
    small = _pooled(gray, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def _pooled(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    r, c = np.array_split(np.arange(gray.shape[0]), rows), np.array_split(np.arange(gray.shape[1]), cols)
    return np.array([[gray[np.ix_(a, b)].mean() if len(a) and len(b) else 0.0 for b in c] for a in r])


def _bits(mask: np.ndarray) -> int:
    value = 0
    for b in mask.ravel():
        value = value << 1 | int(b)
    return value - (1 << 64) if value >> 63 else value


def fit_circle(mask: np.ndarray) -> tuple[float, float, float, float] | None:
    """Centre, radius of equal area, and overlap over disk area of the largest 4-connected component of a mask."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # the least label of a component spreads until nothing changes
        new = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            other = label[b]
            new[a] = np.where((label[a] > 0) & (other > 0), np.minimum(new[a], other), new[a])
        if (new == label).all():
            break
        label = new
    ids, n = np.unique(label[label > 0], return_counts=True)
    if not len(ids):
        return None
    y, x = np.nonzero(label == ids[n.argmax()])
    radius = float(np.sqrt(len(x) / np.pi))
    cx, cy = float(x.mean()), float(y.mean())
    yy, xx = np.indices(mask.shape)
    disk = (xx - cx) ** 2 + (yy - cy) ** 2 <= radius**2
    return cx, cy, radius, float((disk & (label == ids[n.argmax()])).sum() / max(1, disk.sum()))


def blockiness(gray: np.ndarray) -> float:
    """Mean step across 8-pixel borders over the mean step inside blocks."""
    d = np.abs(np.diff(gray, axis=1))
    border = (np.arange(d.shape[1]) + 1) % 8 == 0
    inside = d[:, ~border].mean() if (~border).any() else 0.0
    return float(d[:, border].mean() / inside) if border.any() and inside > 0 else 0.0


def image_features(df: DataFrame, *, id: str = "vec_id", pixels: str = "pixels", side: int) -> DataFrame:
    """Hashes, circle fit and blockiness of flat gray images; a row that fails carries the error instead of stopping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, flat in zip(b[id], b[pixels], strict=True):
                try:
                    g = _plane(flat, side)
                    circle = fit_circle(g > 15) or (None,) * 4
                    rows.append((key, average_hash(g), difference_hash(g), *circle, blockiness(g), ""))
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    rows.append((key, None, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["id", "ahash", "dhash", "cx", "cy", "radius", "fit_quality", "blockiness", "error"]).astype({"ahash": "Int64", "dhash": "Int64"})

    return df.select(id, pixels).mapInPandas(run, "id long, ahash long, dhash long, cx double, cy double, radius double, fit_quality double, blockiness double, error string")
