"""NumPy array files as Spark data sources.

``field_stack`` reads 3-D ``.npy`` stacks, one file or one folder of files per component, side
by side into voxel rows. ``frame_list`` reads ``.npz`` lists of 2-D frames whose sizes differ.
Only headers and directories are read when planning; every task seeks to its own byte range.
Ranges of frames, rows and columns, and keys, are options: tasks without a wanted frame are not made, and
others seek past what is not wanted. They are not taken from filters by ``pushFilters``: Spark 4.1 keeps what a
Python reader took over with the relation, so that another filter of the same DataFrame would lose rows.
Paths may carry any scheme that Arrow knows.
"""

from __future__ import annotations

import contextlib
import json
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMPONENT_OPTIONS = ("u", "v", "w", "c")
OPENED_AT_ONCE = 32


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_bytes(path: str, content: bytes) -> None:
    """Write a file under a name of its own, then move it in place in one step: attempts that run
    at the same time leave the same file, and no reader sees half of one."""
    system, inner = file_system(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def each_of(paths: list[str], look):
    """``look`` at many files at once, in order."""
    with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
        return list(pool.map(look, paths))


def files_under(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder in order of their names."""
    system, inner = file_system(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    names = sorted(f.base_name for f in found if f.base_name.endswith(suffix))
    if not names:
        raise FileNotFoundError(f"no {suffix} file under {path}")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def read_header(handle) -> tuple[tuple[int, ...], np.dtype, bool]:
    """Shape as the bytes lie, type, and whether the axes lie in reverse (column order)."""
    major, _ = np.lib.format.read_magic(handle)
    reader = np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = reader(handle)
    return (shape[::-1] if fortran else shape), dtype, fortran


def header_of(path: str) -> tuple[tuple[int, ...], np.dtype, bool]:
    system, inner = file_system(path)
    with system.open_input_file(inner) as handle:
        return read_header(handle)


def span_option(span: tuple[int | None, int | None]) -> str:
    """A half-open range as the text of an option."""
    return ":".join("" if end is None else str(int(end)) for end in span)


class Wanted:
    """What the options of a reader ask for: half-open ranges ``first:end`` of ``places``, either end may be open, and lists of
    ``names`` as JSON."""

    def __init__(self, options: dict[str, str], places: list[str], names: list[str] = ()):
        self.spans: dict[str, tuple[int, int | None]] = {}
        for place in places:
            first, _, end = options.get(f"{place}_span", ":").partition(":")
            self.spans[place] = (int(first or 0), int(end) if end else None)
        self.lists = {n: set(json.loads(options[f"{n}_list"])) for n in names if f"{n}_list" in options}

    def has(self, name: str, value: str) -> bool:
        return name not in self.lists or value in self.lists[name]

    def of(self, place: str, size: int, start: int = 0) -> np.ndarray:
        """The wanted ones of the numbers ``start`` to ``start + size - 1``, ascending."""
        first, end = self.spans[place]
        return np.arange(max(start, first), start + size if end is None else min(start + size, end), dtype=np.int32)


@dataclass
class StackPart(InputPartition):
    """Rows first..last-1 of the leading axis of one file per component."""

    paths: tuple[str, ...]
    offset: int
    first: int
    last: int


class StackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.case = options.get("case_id", "case")
        self.axes = options.get("axes", "tyx")
        if self.axes not in ("tyx", "yxt"):
            raise ValueError("axes must be tyx or yxt")
        self.step = int(options.get("slabs_per_task", "32"))
        frame = options.get("frame")
        self.frame = None if frame is None else int(frame)
        self.components = [k for k in COMPONENT_OPTIONS if k in options]
        if not self.components:
            raise ValueError("give at least one of the options u, v, w, c")
        self.roots = [options[k] for k in self.components]
        self.wanted = Wanted(options, ["t", "y", "x"])
        if self.frame is not None:
            self.wanted.spans["t"] = (self.frame, self.frame + 1)
        self.bytes_read = 0  # by this reader, beside headers

    def partitions(self):
        lists = [files_under(root, ".npy") for root in self.roots]
        if len({len(names) for names in lists}) != 1:
            raise ValueError("the components have different numbers of files")
        names = [path for paths in zip(*lists) for path in paths]
        headers = dict(zip(names, each_of(names, header_of)))
        parts, offset, orders = [], 0, set()
        for paths in zip(*lists):
            shapes = {headers[path][0] for path in paths}
            orders |= {headers[path][2] for path in paths}
            if len(shapes) != 1:
                raise ValueError(f"the components differ in shape: {sorted(shapes)}")
            shape = shapes.pop()
            if len(shape) != 3:
                raise ValueError(f"expected a 3-D stack, got shape {shape}")
            if len(orders) != 1:
                raise ValueError("row order and column order are mixed")
            order = self.axes[::-1] if orders == {True} else self.axes
            if order[0] != self.axes[0] and len(lists[0]) > 1:
                raise ValueError("several files in column order do not line up along their first axis")
            for first in range(0, shape[0], self.step):
                slabs = self.wanted.of(order[0], min(self.step, shape[0] - first), offset + first)
                if len(slabs):
                    parts.append(StackPart(paths, offset, int(slabs[0]) - offset, int(slabs[-1]) + 1 - offset))
            offset += shape[0]
            n_frames = offset if order[0] == "t" else shape[order.index("t")]
        if self.frame is not None and not 0 <= self.frame < n_frames:
            raise IndexError(f"frame {self.frame} is out of range")
        return parts

    def read(self, part: StackPart | None):
        if part is None:  # nothing is wanted
            return
        with contextlib.ExitStack() as open_files:
            handles = []
            for path in part.paths:
                system, inner = file_system(path)
                handle = open_files.enter_context(system.open_input_file(inner))
                shape, dtype, reverse = read_header(handle)
                handles.append((handle, dtype, handle.tell()))
            order = self.axes[::-1] if reverse else self.axes
            seconds, thirds = self.wanted.of(order[1], shape[1]), self.wanted.of(order[2], shape[2])
            if not len(seconds) or not len(thirds):
                return
            start, band = int(seconds[0]), len(seconds)  # rows that lie side by side
            second, third = np.repeat(seconds, len(thirds)), np.tile(thirds, len(seconds))
            for at in self.wanted.of(order[0], part.last - part.first, part.offset + part.first):  # one slab in memory at a time
                place = dict(zip(order, (np.full(second.size, at, dtype=np.int32), second, third)))
                values = {}
                for name, (handle, dtype, data) in zip(self.components, handles):
                    size = band * shape[2] * dtype.itemsize
                    handle.seek(data + ((int(at) - part.offset) * shape[1] + start) * shape[2] * dtype.itemsize)
                    self.bytes_read += size
                    slab = np.frombuffer(handle.read(size), dtype=dtype).reshape(band, shape[2])
                    values[name] = slab[:, thirds[0] : thirds[-1] + 1].ravel().astype(np.float32, copy=False)
                columns = [pa.repeat(self.case, len(place["t"])), *(pa.array(place[k]) for k in "tyx")]
                # masked samples are NaN in the files and NULL in the engine
                columns += [pa.array(v, mask=~np.isfinite(v)) for v in values.values()]
                yield pa.RecordBatch.from_arrays(columns, names=["case_id", "t", "y", "x", *self.components])


class StackSource(DataSource):
    @classmethod
    def name(cls):
        return "field_stack"

    def schema(self):
        components = [k for k in COMPONENT_OPTIONS if k in self.options]
        return "case_id string, t int, y int, x int, " + ", ".join(f"{k} float" for k in components)

    def reader(self, schema):
        return StackReader(dict(self.options))


def frame_place(key: str) -> tuple[bool, int, str]:
    """Order of the frames of one archive: numbered keys by number, then the others by name."""
    digits = key.removeprefix("arr_")
    numbered = digits != key and digits.isdigit()
    return not numbered, int(digits) if numbered else 0, key


def keys_of(path: str) -> list[str]:
    """Keys of an archive in the order of their frames."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as handle, zipfile.ZipFile(handle) as archive:
        return sorted((n[:-4] for n in archive.namelist() if n.endswith(".npy")), key=frame_place)


@dataclass
class FramePart(InputPartition):
    """Members of one archive, each with its place among all frames."""

    path: str
    members: tuple[tuple[int, str], ...]
    case: str = "case"
    component: str = "c"


def read_member(part: FramePart):
    """(number, key, frame) of the members, one after the other. A single row is a frame of one row."""
    system, inner = file_system(part.path)
    with system.open_input_file(inner) as handle, zipfile.ZipFile(handle) as archive:
        for t, key in part.members:
            with archive.open(f"{key}.npy") as member:
                frame = np.lib.format.read_array(member, allow_pickle=False)
            if frame.ndim == 1:  # an axis
                frame = frame[None]
            if frame.ndim != 2:
                raise ValueError(f"{key} is not a 2-D frame: shape {frame.shape}")
            yield t, key, frame.astype(np.float32, copy=False)


class FrameListReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.case = options.get("case_id", "case")
        self.component = options.get("component", "c")
        self.step = int(options.get("frames_per_task", "32"))
        self.wanted = Wanted(options, ["t"], ["key"])
        self.bytes_read = 0  # of frames, unpacked

    def partitions(self):
        # archives follow each other in order of their names; the usual keys repeat from one to the next
        paths = files_under(self.path, ".npz")
        places: dict[str, list[tuple[int, str]]] = {}
        t = 0
        for path, keys in zip(paths, each_of(paths, keys_of)):
            wanted = set(self.wanted.of("t", len(keys), t).tolist())
            numbered = zip(range(t, t + len(keys)), keys)
            places[path] = [(n, key) for n, key in numbered if n in wanted and self.wanted.has("key", key)]
            t += len(keys)
        return [
            FramePart(path, tuple(members[i : i + self.step]))
            for path, members in places.items()
            for i in range(0, len(members), self.step)
        ]

    def read(self, part: FramePart | None):
        if part is None:
            return
        for t, key, frame in read_member(part):
            self.bytes_read += frame.nbytes
            values = frame.ravel()
            data = pa.ListArray.from_arrays(
                pa.array([0, values.size], pa.int32()), pa.array(values, mask=~np.isfinite(values))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.case]),
                    pa.array([t], pa.int32()),
                    pa.array([key]),
                    pa.array([self.component]),
                    pa.array([frame.shape[0]], pa.int32()),
                    pa.array([frame.shape[1]], pa.int32()),
                    data,
                ],
                names=["case_id", "t", "key", "component", "ny", "nx", "data"],
            )


class FrameListSource(DataSource):
    @classmethod
    def name(cls):
        return "frame_list"

    def schema(self):
        return "case_id string, t int, key string, component string, ny int, nx int, data array<float>"

    def reader(self, schema):
        return FrameListReader(dict(self.options))
