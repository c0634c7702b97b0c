"""Pixel kernels and stack readers against plain loops and written files."""

import gzip
import struct

import numpy as np
import pytest

from quillon.functions import pixels as P
from quillon.sources import folders, stacks


def flood(mask, diagonal):
    label, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not label[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not label[i, j]:
                    label[i, j] = n
                    todo += [(i + a, j + b) for a, b in near]
    return label


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(diagonal):
    rng = np.random.default_rng(0)
    for density in (0.2, 0.45, 0.6, 0.0, 1.0):
        mask = rng.random((23, 31)) < density
        assert (P.components(mask, diagonal=diagonal) == flood(mask, diagonal)).all()
    assert not P.largest(np.zeros((3, 4), bool)).any()


def test_field_of_view():
    y, x = np.indices((80, 100))
    img = np.where((x - 55) ** 2 + (y - 40) ** 2 <= 30**2, 100, 0)[:, :, None].repeat(3, 2).astype(np.uint8)
    cx, cy, r, fit, area = P.field_of_view(img)
    assert (cx, cy) == (55, 40) and r == pytest.approx(30, abs=0.2) and fit > 0.99 and area == pytest.approx(100 * (img[:, :, 0] > 0).mean())
    assert P.field_of_view(np.zeros((8, 8, 3), np.uint8)) is None
    img[30:50, 45:60] = 0
    (box,) = P.dark_boxes(img.mean(axis=2), cx, cy, r)
    assert box == (300, 1.0, 45, 30, 59, 49)


def test_resizing():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (12, 12, 3)).astype(np.uint8)
    assert (P.resized(img, 4) == np.rint(img.reshape(4, 3, 4, 3, 3).mean((1, 3)))).all()
    assert (P.resized(img, 12) == img).all()
    up = P.resized(img[:2, :2], 4).astype(int)
    assert up[0, 0, 0] == img[0, 0, 0] and abs(up[1, 1, 0] - np.array([9, 3, 3, 1]) @ img[:2, :2, 0].ravel().astype(int) / 16) <= 0.5
    assert len(P.views(P.resized(img, 20), 16)) == 11 and all(v.shape == (16, 16, 3) for v in P.views(P.resized(img, 20), 16))
    x = P.model_input(img, (0, 0, 12, 12), 12, 12)
    assert x.shape == (3, 12, 12) and x[0, 3, 4] == pytest.approx((img[3, 4, 0] / 255 - 0.485) / 0.229, abs=1e-5)
    assert P.cropped(img, (5, 5, 5, 9)).shape == img.shape


def test_coercion():
    g = np.array([[0, 128], [255, 7]], np.uint8)
    for a in (g, g[:, :, None], g.astype(np.uint16) * 257, g / 255, g.astype(float), np.dstack([g, g, g, g])):
        assert abs(P.rgb8(a).astype(int) - g[:, :, None]).max() <= 1
    for a in (np.zeros((2, 2, 2)), np.zeros(4)):
        with pytest.raises(ValueError):
            P.rgb8(a)


def test_colours():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert abs(P.from_lab(P.lab(img)).astype(int) - img).mean() < 2  # 8-bit rounding of L*a*b*
    assert tuple(P.lab(np.array([[[255, 255, 255]]], np.uint8))[0, 0]) == (255, 128, 128) and tuple(P.lab(np.zeros((1, 1, 3), np.uint8))[0, 0]) == (0, 128, 128)
    grey = P.grey_world(np.full((4, 4, 3), (100, 150, 50), np.uint8))
    assert tuple(grey[0, 0]) == (100, 100, 100)
    assert abs(P.own_scale(img).mean() - 127) < 1
    mask = np.zeros((20, 20), bool)
    mask[5:15, 5:15] = True
    m = P.red_matched(np.full((20, 20, 3), (50, 100, 10), np.uint8), mask, 1.5)
    assert tuple(m[0, 0]) == (150, 100, 10)
    two = np.where(mask[:, :, None], np.uint8(200), np.uint8(50)).repeat(3, 2)
    delta, outside, inside = P.ring_difference(two, mask, 2)
    assert outside == 14**2 - 100 and inside == 100 - 36 and delta == pytest.approx(np.linalg.norm(P.lab(two)[0, 0] - P.lab(two)[9, 9]), abs=1e-3)
    assert P.ring_difference(two, np.ones((20, 20), bool))[0] is None


def test_indicators():
    rng = np.random.default_rng(3)
    noise = rng.normal(128, 20, (64, 64))
    blocks = np.kron(rng.normal(128, 20, (8, 8)), np.ones((8, 8))) + rng.normal(0, 0.5, (64, 64))
    assert P.grid_step_ratio(blocks, 0, 0) > 5 > 1.3 > P.grid_step_ratio(noise, 0, 0) and P.grid_step_ratio(blocks, 3, 0) < P.grid_step_ratio(blocks, 0, 0)
    assert P.detail_share(noise) > P.detail_share(blocks) and P.grid_step_ratio(noise[:8], 0, 0) is None and P.comb_score(noise[:16, :16], 0, 0) is None
    # One coefficient by its definition.
    k = np.sqrt(1 / 8) * np.sqrt(1 / 4) * np.cos(np.pi * (2 * np.arange(8) + 1) / 16)
    values = [float((noise[8 * a : 8 * a + 8, 8 * b : 8 * b + 8] * k).sum()) for a in range(8) for b in range(8)]
    h = np.histogram(values, bins=64)[0].astype(float)
    spectrum = np.abs(np.fft.rfft(h - h.mean()))[1:]
    assert P.comb_score(noise, 0, 0) == pytest.approx(spectrum.max() / spectrum.sum())
    assert P.colours(np.array([[[1, 2, 3], [1, 2, 3]], [[3, 2, 1], [0, 0, 0]]], np.uint8)) == (3, 0.75)
    assert len(P.radial_spectrum(noise)) == 31 and P.radial_spectrum(noise).mean() == pytest.approx(400, rel=0.2)
    img = np.dstack([blocks] * 3).clip(0, 255).astype(np.uint8)
    h = P.frequency_hash(img, (0, 0, 64, 64))
    assert bin((h ^ P.frequency_hash((img * 0.9).astype(np.uint8), (0, 0, 64, 64))) & (2**64 - 1)).count("1") <= 6 and bin(h & (2**64 - 1)).count("1") == 32
    a, d = P.simple_hashes(img)
    assert (a, d) != P.simple_hashes(img[:, ::-1])


def test_stacks(spark, tmp_path):
    rng = np.random.default_rng(4)
    grey = [rng.integers(0, 256, (5, 7)).astype(np.uint8) for _ in range(9)]
    frames = [*grey, rng.integers(0, 256, (4, 3, 3)).astype(np.uint8), rng.integers(0, 60000, (2, 2)).astype(np.uint16), rng.random((3, 3)).astype(np.float32)]
    for big in (False, True):
        path = str(tmp_path / f"x{big}.tif")
        stacks.write_tiff(path, frames, big=big)
        rows = stacks.read_stack(spark, path, 4).orderBy("index").collect()
        assert len(rows) == len(frames)
        for r, f in zip(rows, frames, strict=True):
            assert (np.frombuffer(r.pixels, r.kind).reshape(f.shape) == f).all() and (r.height, r.width) == f.shape[:2]
    raw = b"".join(g.tobytes() for g in grey)
    headers = {
        "v.mha": b"ObjectType = Image\nNDims = 3\nDimSize = 7 5 9\nElementType = MET_UCHAR\nElementDataFile = LOCAL\n" + raw,
        "v.mhd": b"NDims = 3\nDimSize = 7 5 9\nElementType = MET_UCHAR\nElementDataFile = v.raw\n",
        "v.raw": raw,
        "v.nrrd": b"NRRD0004\n# note\ntype: uint8\ndimension: 3\nsizes: 7 5 9\nencoding: raw\nendian: little\n\n" + raw,
        "v.nii": (struct.pack("<i", 348) + bytes(36) + struct.pack("<8h", 3, 7, 5, 9, 1, 1, 1, 1) + bytes(14) + struct.pack("<h", 2) + bytes(36) + struct.pack("<f", 352.0)).ljust(352, b"\0") + raw,
        "c.nrrd": b"NRRD0004\ntype: uint8\nsizes: 7 5 9\nencoding: gzip\n\n" + gzip.compress(raw),
    }
    for name, data in headers.items():
        (tmp_path / name).write_bytes(data)
    for name in ("v.mha", "v.mhd", "v.nrrd", "v.nii"):
        rows = stacks.read_stack(spark, str(tmp_path / name), 2).orderBy("index").collect()
        assert [r.pixels for r in rows] == [g.tobytes() for g in grey], name
    with pytest.raises(Exception, match="raw data"):
        stacks.read_stack(spark, str(tmp_path / "c.nrrd")).count()
    first, others = stacks.find_stack(spark, str(tmp_path))
    assert first.endswith("c.nrrd") and len(others) == 6
    with pytest.raises(FileNotFoundError):
        stacks.find_stack(spark, str(tmp_path / "none"))


def test_folders(spark, tmp_path):
    for name in ("c1/neo/a.png", "c1/NDBE/b.JPG.png", "c2/non-dysplastic/c.bmp", "scripts/neo/d.png", ".git/neo/e.png", "c2/other/f.txt"):
        f = tmp_path / "set" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    assert folders.locate_root(spark, str(tmp_path)).endswith("/set")
    got = {(r.path, r.centre, r.class_label) for r in folders.image_files(spark, str(tmp_path / "set")).collect()}
    assert got == {("c1/neo/a.png", "c1", "neoplasia"), ("c1/NDBE/b.JPG.png", "c1", "non-dysplastic"), ("c2/non-dysplastic/c.bmp", "c2", "non-dysplastic")}
    with pytest.raises(FileNotFoundError):
        folders.locate_root(spark, str(tmp_path / "set" / "c2" / "other"))
