"""Image stacks (many frames in one file), read by ranges: a Spark data source with a partition for a run of frames.

`spark.read.format("frame_stack").load(path)` gives a row a frame: index, height, width, channels, kind (the number type),
pixels (its bytes, rows first, little-endian). Only headers are read by the driver; a task reads only its own frames. Files
are opened through Arrow's file systems, so that any store it knows will do.

Formats: TIFF and BigTIFF in uncompressed strips, MetaImage (mha, mhd with a raw file), NIfTI-1 (nii) and NRRD with raw
encoding. Compressed data is refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "index long, height int, width int, channels int, kind string, pixels binary"
#: Suffixes of the two families, in the order in which a folder is searched.
SUFFIXES = (".tif", ".tiff", ".mha", ".mhd", ".nii", ".nii.gz", ".nrrd")


@dataclass
class Frame:
    height: int
    width: int
    channels: int
    kind: str  # a numpy type
    spans: list[tuple[int, int]]  # offset and bytes of its strips
    planar: bool = False  # channels one after another


class _File:
    """Reads ranges of a file."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.stream = system.open_input_file(inside)

    def at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        data = self.stream.read(n)
        if len(data) != n:
            raise ValueError(f"the file ends before byte {offset + n}")
        return data


def tiff_frames(f: _File) -> Iterator[Frame]:
    head = f.at(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(f"{order}H", head[2:4])[0] == 43
    count, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    inline = 8 if big else 4
    at = struct.unpack(f"{order}{place}", head[8:16] if big else head[4:8])[0]
    sizes = {1: "B", 3: "H", 4: "I", 16: "Q"}

    while at:
        n = struct.unpack(f"{order}{count}", f.at(at, struct.calcsize(count)))[0]
        body = at + struct.calcsize(count)
        table = f.at(body, n * entry)
        tags = {}
        for k in range(n):
            raw = table[k * entry : (k + 1) * entry]
            tag, kind = struct.unpack(f"{order}HH", raw[:4])
            times = struct.unpack(f"{order}{place}", raw[4 : 4 + inline])[0]
            if kind in sizes:
                size = times * struct.calcsize(sizes[kind])
                data = raw[4 + inline :][:size] if size <= inline else f.at(struct.unpack(f"{order}{place}", raw[4 + inline :])[0], size)
                tags[tag] = struct.unpack(f"{order}{times}{sizes[kind]}", data)
        if tags.get(259, (1,))[0] != 1 or 273 not in tags:
            raise ValueError("only uncompressed strips are read")
        bits, form, channels = tags.get(258, (1,))[0], tags.get(339, (1,))[0], tags.get(277, (1,))[0]
        kind = f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}"
        yield Frame(tags[257][0], tags[256][0], channels, kind, list(zip(tags[273], tags[279], strict=True)), planar=tags.get(284, (1,))[0] == 2)
        at = struct.unpack(f"{order}{place}", f.at(body + n * entry, struct.calcsize(place)))[0]


_META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
_NRRD = {"uchar": "u1", "uint8": "u1", "unsigned char": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "unsigned short": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}
_NIFTI = {2: ("u1", 1), 4: ("i2", 1), 8: ("i4", 1), 16: ("f4", 1), 64: ("f8", 1), 128: ("u1", 3), 256: ("i1", 1), 512: ("u2", 1), 768: ("u4", 1)}


def _slices(width: int, height: int, depth: int, channels: int, kind: str, start: int) -> Iterator[Frame]:
    size = width * height * channels * np.dtype(kind).itemsize
    for z in range(depth):
        yield Frame(height, width, channels, kind, [(start + z * size, size)])


def meta_header(f: _File) -> tuple[dict[str, str], int]:
    """Keys and where the header ends."""
    fields, at, rest = {}, 0, b""
    while "ElementDataFile" not in fields:
        while b"\n" not in rest:
            got = f.stream.read(256) if at or rest else f.at(0, 0) + f.stream.read(256)
            if not got:
                raise ValueError("the header has no ElementDataFile")
            rest += got
        line, rest = rest.split(b"\n", 1)
        at += len(line) + 1
        key, _, value = line.decode("latin-1").partition("=")
        fields[key.strip()] = value.strip()
    return fields, at


def volume_frames(path: str, f: _File) -> tuple[str, list[Frame]]:
    """The file that holds the data, and its slices."""
    if path.endswith((".mha", ".mhd")):
        fields, at = meta_header(f)
        if fields.get("CompressedData", "False").lower() == "true":
            raise ValueError("compressed volumes are not read")
        size = [int(x) for x in fields["DimSize"].split()] + [1, 1]
        order = ">" if fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() == "true" else "<"
        kind = order + _META[fields["ElementType"]]
        local = fields["ElementDataFile"] == "LOCAL"
        data = path if local else f"{path.rsplit('/', 1)[0]}/{fields['ElementDataFile']}"
        return data, list(_slices(size[0], size[1], size[2], int(fields.get("ElementNumberOfChannels", 1)), kind, at if local else 0))
    if path.endswith(".nii"):
        head = f.at(0, 352)
        order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
        dims = struct.unpack(f"{order}8h", head[40:56])
        kind, channels = _NIFTI[struct.unpack(f"{order}h", head[70:72])[0]]
        return path, list(_slices(dims[1], dims[2], dims[3] if dims[0] > 2 else 1, channels, order + kind, int(struct.unpack(f"{order}f", head[108:112])[0])))
    if path.endswith(".nrrd"):
        head = f.stream.read(1 << 16)
        text, _, _ = head.partition(b"\n\n")
        fields = dict(x.split(": ", 1) for x in text.decode("latin-1").splitlines() if ": " in x and not x.startswith("#"))
        if fields["encoding"] != "raw" or "data file" in fields:
            raise ValueError("only NRRD files with raw data inside are read")
        size = [int(x) for x in fields["sizes"].split()]
        channels = size.pop(0) if len(size) > 2 and size[0] in (1, 3, 4) else 1
        size += [1]
        order = ">" if fields.get("endian", "little") == "big" else "<"
        return path, list(_slices(size[0], size[1], size[2], channels, order + _NRRD[fields["type"]], len(text) + 2))
    raise ValueError(f"{path.rsplit('/', 1)[-1]} is no stack that can be read")


@dataclass
class Run(InputPartition):
    path: str
    first: int
    frames: list[Frame]


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], int(options.get("framesPerPartition", 64))

    def partitions(self) -> list[Run]:
        f = _File(self.path)
        data, frames = (self.path, list(tiff_frames(f))) if self.path.endswith((".tif", ".tiff")) else volume_frames(self.path, f)
        return [Run(data, i, frames[i : i + self.run]) for i in range(0, len(frames), self.run)] or [Run(data, 0, [])]

    def read(self, partition: Run) -> Iterator[tuple]:
        f = _File(partition.path) if partition.frames else None
        for i, x in enumerate(partition.frames, partition.first):
            raw = np.frombuffer(b"".join(f.at(*s) for s in x.spans), x.kind)
            if x.planar:
                raw = np.moveaxis(raw.reshape(x.channels, x.height, x.width), 0, 2)
            plain = np.dtype(x.kind).newbyteorder("<")
            yield i, x.height, x.width, x.channels, plain.str[1:], np.ascontiguousarray(raw.astype(plain)).tobytes()


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_stack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:  # noqa: ANN001
        return StackReader(self.options)


def read_stack(spark: SparkSession, path: str, frames_per_partition: int = 64):
    spark.dataSource.register(StackSource)
    return spark.read.format("frame_stack").option("framesPerPartition", frames_per_partition).load(path)


def find_stack(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """The first stack of a folder by name, and the others, which are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in system.listStatus(path) if s.isFile() and s.getPath().getName().endswith(SUFFIXES)) if system.exists(path) else []
    if not names:
        raise FileNotFoundError(f"no stack in {folder}")
    return names[0], names[1:]


def write_tiff(path: str, frames: list[np.ndarray], *, big: bool = False) -> None:
    """Frames (height x width, or with channels) as uncompressed pages of one strip each."""
    from pyarrow import fs

    place, count, inline = ("Q", "Q", 8) if big else ("I", "H", 4)
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link = len(out) - inline
    for a in frames:
        start = len(out)
        out += np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()
        size, form = len(out) - start, {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        tags = [(256, a.shape[1]), (257, a.shape[0]), (258, a.itemsize * 8), (259, 1), (262, 1 if a.ndim == 2 else 2), (273, start), (277, 1 if a.ndim == 2 else a.shape[2]), (278, a.shape[0]), (279, size), (339, form)]
        struct.pack_into(f"<{place}", out, link, len(out))
        out += struct.pack(f"<{count}", len(tags))
        for tag, value in tags:
            out += struct.pack(f"<HH{place}{place}", tag, 16 if big else 4, 1, value)
        link = len(out)
        out += struct.pack(f"<{place}", 0)
    system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(inside.rsplit("/", 1)[0])
    with system.open_output_stream(inside) as f:
        f.write(bytes(out))
