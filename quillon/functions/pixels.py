"""Kernels on pixel arrays (height x width, or with three channels), applied row by row through Arrow batches.

A frame row has `height`, `width`, `channels` and `pixels` (bytes, rows first). A row that fails gives nulls and the error's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME = "height int, width int, channels int, pixels binary"

# ---- regions


def components(mask: np.ndarray, *, diagonal: bool = False) -> np.ndarray:
    """Labels 1, 2, ... of the connected regions of a mask in the order of their first pixel; 0 outside.

    Runs of a row are joined with the runs of the row before that they touch (union by the least run).
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = int(diagonal)
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < stop[j] + reach and start[j] < stop[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(h * w, int)
    length = stop - start
    at = np.repeat(row * w + start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[at] = np.repeat(number, length)
    return out.reshape(h, w)


def largest(mask: np.ndarray, *, diagonal: bool = False) -> np.ndarray:
    """The largest region of a mask (the first of equals); an empty mask stays empty."""
    label = components(mask, diagonal=diagonal)
    size = np.bincount(label.ravel())
    size[0] = 0
    return label == size.argmax() if size.any() else np.zeros(mask.shape, bool)


def disk(shape: tuple[int, int], cx: float, cy: float, radius: float) -> np.ndarray:
    y, x = np.indices(shape)
    return (x - cx) ** 2 + (y - cy) ** 2 <= radius**2


def field_of_view(rgb: np.ndarray, threshold: int = 15) -> tuple[float, float, float, float, float] | None:
    """Centre, radius of equal area, share of the disk that is bright, and the area in percent; none without a bright pixel.

    The circle is that of the largest bright region; the quality counts bright pixels of any region.
    """
    bright = rgb.mean(axis=2) > threshold
    region = largest(bright)
    area = int(region.sum())
    if not area:
        return None
    y, x = np.nonzero(region)
    cx, cy, radius = float(x.mean()), float(y.mean()), float(np.sqrt(area / np.pi))
    inside = disk(bright.shape, cx, cy, radius)
    return cx, cy, radius, float(bright[inside].mean()) if inside.any() else 0.0, 100.0 * area / bright.size


def dark_boxes(gray: np.ndarray, cx: float, cy: float, radius: float, *, least: int = 200, fill: float = 0.9, black: int = 10) -> list[tuple[int, float, int, int, int, int]]:
    """(area, fill, left, top, right, bottom) of near-black regions in a disk that fill their bounding box."""
    label = components((gray <= black) & disk(gray.shape, cx, cy, radius))
    y, x = np.nonzero(label)
    if not len(y):
        return []
    of = label[y, x] - 1
    n = of.max() + 1
    low, high = np.full((n, 2), np.iinfo(int).max), np.full((n, 2), -1)
    for axis, at in ((0, x), (1, y)):
        np.minimum.at(low[:, axis], of, at)
        np.maximum.at(high[:, axis], of, at)
    area = np.bincount(of)
    share = area / (high - low + 1).prod(1)
    return [(int(area[k]), float(share[k]), *map(int, (*low[k], *high[k]))) for k in np.flatnonzero((area >= least) & (share >= fill))]


# ---- sizes


def _weights(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray], support: float) -> np.ndarray:
    """m x n weights of a resampling filter that widens when it shrinks."""
    scale = n / m
    stretch = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    place = np.arange(n) + 0.5
    w = kernel((place[None, :] - centre[:, None]) / stretch)
    w[np.abs(place[None, :] - centre[:, None]) >= support * stretch] = 0
    return w / w.sum(1, keepdims=True)


def _lanczos(n: int, m: int) -> np.ndarray:
    return _weights(n, m, lambda x: np.sinc(x) * np.sinc(x / 3), 3.0)


def _area(n: int, m: int) -> np.ndarray:
    """Share of each source pixel in a target pixel."""
    edges = np.arange(m + 1) * n / m
    cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    cover = np.maximum(cover, 0)
    return cover / cover.sum(1, keepdims=True)


def _linear(n: int, m: int) -> np.ndarray:
    """Between neighbours, at pixel centres; constant beyond the ends."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    w = np.zeros((m, n))
    w[np.arange(m), low] += 1 - (at - low)
    w[np.arange(m), np.minimum(low + 1, n - 1)] += at - low
    return w


def _apply(img: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.einsum("yh,hw...,xw->yx...", rows, img.astype(float), columns, optimize=True)


def resized(img: np.ndarray, side: int) -> np.ndarray:
    """To a square of 8-bit pixels: areas are averaged when either side shrinks, else linear."""
    kind = _area if side < max(img.shape[:2]) else _linear
    return np.clip(np.rint(_apply(img, kind(img.shape[0], side), kind(img.shape[1], side))), 0, 255).astype(np.uint8)


def cropped(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """left, top, right, bottom; a box that is empty inside the image leaves the whole image."""
    left, top, right, bottom = box
    part = img[max(0, top) : max(0, bottom), max(0, left) : max(0, right)]
    return part if part.size else img


def rgb8(raw: np.ndarray) -> np.ndarray:
    """Grey, RGB or RGBA of any number type as 8-bit RGB.

    Floats up to 1 are taken as shares of 255; 16-bit numbers as shares of 257; all are cut off to 0..255.
    """
    if raw.ndim == 2:
        raw = raw[:, :, None]
    if raw.ndim != 3 or raw.shape[2] not in (1, 3, 4):
        raise ValueError(f"a frame of shape {raw.shape} is not an image")
    img = np.broadcast_to(raw, (*raw.shape[:2], 3)) if raw.shape[2] == 1 else raw[:, :, :3]
    if img.dtype == np.uint16:
        img = img.astype(np.float32) / 257
    elif img.dtype.kind == "f" and img.size and np.nanmax(img) <= 1 + 1e-6:
        img = img * 255
    return np.ascontiguousarray(np.clip(img, 0, 255).astype(np.uint8))


#: Channel means and deviations of the standard photographic training set.
CHANNEL_MEAN, CHANNEL_SD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def standardised(img: np.ndarray) -> np.ndarray:
    """Channels first, as shares of 255, less the channel's mean, over its deviation."""
    return np.moveaxis((img.astype(np.float32) / 255 - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_SD), 2, 0)


def model_input(img: np.ndarray, box: tuple[int, int, int, int], cache: int = 431, side: int = 384) -> np.ndarray:
    """The crop, resized twice (to the size that is kept, then the model's), standardised."""
    return standardised(resized(resized(cropped(img, box), cache), side))


def views(kept: np.ndarray, side: int) -> list[np.ndarray]:
    """Eleven views of a kept square: the resized one, three mirrorings, two quarter turns, four corners and the middle."""
    plain, room = resized(kept, side), kept.shape[0] - side
    turned = [plain, plain[:, ::-1], plain[::-1], plain[::-1, ::-1], np.rot90(plain), np.rot90(plain, -1)]
    corners = [(0, 0), (0, room), (room, 0), (room, room), (room // 2, room // 2)]
    return turned + [kept[y : y + side, x : x + side] for y, x in corners]


# ---- indicators


def _cosines(n: int) -> np.ndarray:
    k, x = np.indices((n, n))
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def frequency_hash(rgb: np.ndarray, box: tuple[int, int, int, int], side: int = 8, factor: int = 4) -> int:
    """Which of the lowest side x side cosine coefficients of a small grey image are above their median, as signed 64 bits."""
    gray = luma(cropped(rgb, box))
    n = side * factor
    small = np.clip(np.rint(_apply(gray, _lanczos(gray.shape[0], n), _lanczos(gray.shape[1], n))), 0, 255)
    basis = _cosines(n)
    low = (basis @ small @ basis.T)[:side, :side]
    return bits64(low > np.median(low))


def simple_hashes(rgb: np.ndarray, side: int = 8) -> tuple[int, int]:
    """Average hash (above the mean of side x side grey pixels) and difference hash (brighter than the left neighbour)."""
    gray = luma(rgb)
    small = lambda h, w: np.clip(np.rint(_apply(gray, _lanczos(gray.shape[0], h), _lanczos(gray.shape[1], w))), 0, 255)
    square, wide = small(side, side), small(side, side + 1)
    return bits64(square > square.mean()), bits64(wide[:, 1:] > wide[:, :-1])


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]))


def bits64(mask: np.ndarray) -> int:
    return int(np.packbits(mask.ravel()).view(">i8")[0])


def colour_means(rgb: np.ndarray, cx: float, cy: float, radius: float) -> tuple[float, ...]:
    """Mean red, green, blue and the ratios to green within 0.8 of the radius, without black and blown-out pixels.

    Under 100 usable pixels all of the disk counts.
    """
    inside = disk(rgb.shape[:2], cx, cy, radius * 0.8)
    light = rgb.mean(axis=2)
    usable = inside & (light > 20) & (light < 245)
    r, g, b = rgb[usable if usable.sum() >= 100 else inside].astype(float).mean(axis=0)
    ratio = lambda v: round(float(v / g), 4) if g > 0 else None
    return round(float(r), 2), round(float(g), 2), round(float(b), 2), ratio(r), ratio(b)


def inner_region(rgb: np.ndarray, cx: float, cy: float, radius: float, share: float = 0.8) -> tuple[np.ndarray, int, int] | None:
    """The square inscribed in `share` of the circle, cut to the image, with its corner; none under 32 pixels."""
    side = int(radius * share * np.sqrt(2))
    corner = np.rint([cx - side / 2, cy - side / 2]).astype(int)
    left, top = np.maximum(corner, 0).tolist()
    right, bottom = np.minimum(corner + side, [rgb.shape[1], rgb.shape[0]]).tolist()
    return (rgb[top:bottom, left:right], left, top) if min(right - left, bottom - top) >= 32 else None


def grid_step_ratio(gray: np.ndarray, left: int, top: int) -> float | None:
    """Mean step over the 8-pixel grid's lines, over the mean of all other steps, in both directions."""
    if min(gray.shape) < 16:
        return None
    on, off = [], []
    for step, start in ((np.abs(np.diff(gray, axis=1)), left), (np.abs(np.diff(gray, axis=0)).T, top)):
        line = (np.arange(step.shape[1]) + start + 1) % 8 == 0
        on.append(step[:, line].ravel())
        off.append(step[:, ~line].ravel())
    inside = np.concatenate(off).mean()
    return float(np.concatenate(on).mean() / inside) if inside > 1e-9 else None


def colours(rgb: np.ndarray) -> tuple[int, float]:
    n = len(np.unique(rgb.reshape(-1, 3).astype(np.uint32) @ np.array([1 << 16, 1 << 8, 1], np.uint32)))
    return n, n / (rgb.size // 3)


def detail_share(gray: np.ndarray, cutoff: float = 0.5) -> float | None:
    """The share of the spectrum's power (under a Hann window) beyond a share of the half width."""
    h, w = gray.shape
    power = np.abs(np.fft.fft2((gray - gray.mean()) * np.hanning(h)[:, None] * np.hanning(w))) ** 2
    fy, fx = np.fft.fftfreq(h) * h / (h / 2), np.fft.fftfreq(w) * w / (w / 2)
    return float(power[np.hypot(fy[:, None], fx) > cutoff].sum() / power.sum()) if power.sum() > 0 else None


def comb_score(gray: np.ndarray, left: int, top: int, at: tuple[int, int] = (0, 1)) -> float | None:
    """How far a histogram of one cosine coefficient of the grid's blocks repeats itself: its spectrum's peak over the sum."""
    g = gray[-top % 8 :, -left % 8 :]
    rows, cols = g.shape[0] // 8, g.shape[1] // 8
    if rows * cols < 32:
        return None
    basis = _cosines(8) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))[:, None]
    blocks = g[: rows * 8, : cols * 8].reshape(rows, 8, cols, 8)
    values = np.einsum("y,aybx,x->ab", basis[at[0]], blocks, basis[at[1]])
    count = np.histogram(values, bins=64)[0].astype(float)
    spectrum = np.abs(np.fft.rfft(count - count.mean()))[1:]
    return float(spectrum.max() / spectrum.sum()) if spectrum.sum() > 1e-9 else 0.0


def compression_indicators(rgb: np.ndarray, cx: float, cy: float, radius: float) -> tuple:
    """Grid step ratio, number and share of colours, share of fine detail, comb score; nulls where the region is too small."""
    region = inner_region(rgb, cx, cy, radius)
    if region is None:
        return (None,) * 5
    part, left, top = region
    gray = part.mean(axis=2)
    return grid_step_ratio(gray, left, top), *colours(part), detail_share(gray), comb_score(gray, left, top)


def radial_spectrum(field: np.ndarray) -> np.ndarray:
    """Mean power by whole distance from zero frequency, without the zero itself, up to half the shorter side."""
    h, w = field.shape
    power = np.abs(np.fft.fft2(field)) ** 2 / field.size
    distance = np.hypot(np.fft.fftfreq(h)[:, None] * h, np.fft.fftfreq(w) * w).astype(int).ravel()
    total, n = np.bincount(distance, power.ravel()), np.bincount(distance)
    return (total / np.maximum(n, 1))[1 : min(h, w) // 2]


# ---- colour

#: Linear sRGB to XYZ and the D65 white.
_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of 8-bit sRGB, as 8-bit numbers: L * 255 / 100, a + 128, b + 128."""
    v = rgb.astype(float) / 255
    linear = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    t = linear @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    x, y, z = np.moveaxis(f, -1, 0)
    return np.rint(np.clip(np.stack([(116 * y - 16) * 2.55, 500 * (x - y) + 128, 200 * (y - z) + 128], -1), 0, 255))


def from_lab(values: np.ndarray) -> np.ndarray:
    l, a, b = np.moveaxis(values.astype(float), -1, 0)
    y = (l / 2.55 + 16) / 116
    f = np.stack([y + (a - 128) / 500, y, y - (b - 128) / 200], -1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    return np.rint(np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear) * 255).astype(np.uint8)


def matched_colours(rgb: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Each L*a*b* channel moved to a reference's mean and deviation."""
    v = lab(rgb)
    out = (v - v.mean((0, 1))) * (sd / (v.std((0, 1)) + 1e-6)) + mean
    return from_lab(np.trunc(np.clip(out, 0, 255)))


def grey_world(rgb: np.ndarray) -> np.ndarray:
    """Channels scaled to the same mean, by 0.5 to 2."""
    mean = rgb.astype(float).mean((0, 1))
    return np.clip(rgb * np.clip(mean.mean() / np.maximum(mean, 1e-6), 0.5, 2), 0, 255).astype(np.uint8)


def own_scale(rgb: np.ndarray) -> np.ndarray:
    """Channels as z-scores, three deviations to each side over 0..255."""
    v = rgb.astype(float)
    z = (v - v.mean((0, 1))) / (v.std((0, 1)) + 1e-6)
    return np.clip(z * 42.5 + 127.5, 0, 255).astype(np.uint8)


def red_matched(rgb: np.ndarray, mask: np.ndarray, ratio: float) -> np.ndarray:
    """Red scaled so that mean red over mean green of the masked pixels is the given ratio, where that is defined."""
    if not mask.any():
        return rgb
    red, green = rgb[..., 0][mask].mean(), rgb[..., 1][mask].mean()
    if min(red, green) < 1e-6 or not np.isfinite(ratio):
        return rgb
    return np.clip(rgb * np.array([ratio * green / red, 1, 1], np.float32), 0, 255).astype(np.uint8)


def _spread(mask: np.ndarray, width: int) -> np.ndarray:
    """The mask widened by a square of 2 * width + 1 pixels."""
    for axis in (0, 1):
        total = np.cumsum(np.pad(mask.astype(int), [(width + 1, width) if a == axis else (0, 0) for a in (0, 1)]), axis)
        n = mask.shape[axis]
        mask = np.take(total, np.arange(2 * width + 1, 2 * width + 1 + n), axis) > np.take(total, np.arange(n), axis)
    return mask


def ring_difference(rgb: np.ndarray, mask: np.ndarray, width: int = 5) -> tuple[float | None, int, int]:
    """Distance of the mean L*a*b* just outside a mask from that just inside, and both rings' pixels; pixels beyond the
    image count as neither inside nor outside."""
    outside = _spread(mask, width) & ~mask
    inside = mask & _spread(~mask, width)
    if not outside.any() or not inside.any():
        return None, int(outside.sum()), int(inside.sum())
    v = lab(rgb)
    return round(float(np.linalg.norm(v[outside].mean(0) - v[inside].mean(0))), 3), int(outside.sum()), int(inside.sum())


# ---- rows


def map_frames(df: DataFrame, keep: list[str], schema: str, function: Callable[..., list[tuple]], *more: str) -> DataFrame:
    """keep, the rows that function(pixels, *more) gives for each frame, and `error`; a frame that fails gives one row of nulls."""
    names = [c.split()[0] for c in schema.split(", ")]
    fields = dict(df.select(*keep).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                own = [r[k] for k in keep]
                try:
                    img = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                    rows += [(*own, *x, "") for x in function(img, *[r[m] for m in more])]
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    rows.append((*own, *[None] * len(names), str(e)[:200]))
            out = pd.DataFrame(rows, columns=[*keep, *names, "error"], dtype=object)
            yield out

    columns = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    extra = [m for m in more if m not in keep]
    return df.select(*keep, "height", "width", "channels", "pixels", *extra).mapInPandas(run, f"{columns}, {schema}, error string")
