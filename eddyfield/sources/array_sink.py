"""Frames written as array archives by the tasks, with one commit for the whole write.

Every task writes its frames to archives under names of its own in a folder of the job, and reports them. Only when all tasks
have ended the archives are moved in place and listed in an index of the write, ``<path>/_index/<job>.json``; readers see
what an index lists and nothing else. When the write fails, or a task is tried again, the folder of the job goes with all
that was left in it.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from eddyfield.sources.arrays import FramePart, Wanted, each_of, file_system, read_member

SCHEMA = "case_id string, t int, component string, ny int, nx int, data array<float>"


@dataclass
class Written(WriterCommitMessage):
    """Archives of one task: name in the folder of the job, case, component, and the frames in it."""

    archives: list[tuple[str, str, str, list[int]]]


def _folder(path: str) -> str:
    return path.rstrip("/")


class ArraySinkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = _folder(options["path"])
        self.frames = int(options.get("frames_per_file", "16"))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        held: dict[tuple[str, str], dict[int, np.ndarray]] = {}
        archives = []

        def flush(case: str, component: str) -> None:
            frames = held.pop((case, component))
            buffer = io.BytesIO()
            np.savez(buffer, **{f"arr_{t}": frames[t] for t in sorted(frames)})
            name = f"{min(frames):09d}-{uuid.uuid4().hex[:12]}.npz"
            system, inner = file_system(f"{self.path}/_job-{self.job}")
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(buffer.getvalue())
            archives.append((name, case, component, sorted(frames)))

        for batch in iterator:
            for row in batch.to_pylist():
                case, component, t = row["case_id"], row["component"], row["t"]
                if None in (case, component, t) or len(row["data"]) != row["ny"] * row["nx"]:
                    raise ValueError(f"frame {t} of {case}, {component}: no place, or not {row['ny']} x {row['nx']} values")
                frames = held.setdefault((case, component), {})
                if t in frames:
                    raise ValueError(f"frame {t} of {case}, {component} comes twice")
                frames[t] = np.array([np.nan if v is None else v for v in row["data"]], dtype=np.float32).reshape(row["ny"], row["nx"])
                if len(frames) >= self.frames:
                    flush(case, component)
        for case, component in list(held):
            flush(case, component)
        return Written(archives)

    def commit(self, messages):
        archives = [a for m in messages if m is not None for a in m.archives]
        system, root = file_system(self.path)
        taken = {(e["case_id"], e["component"], t) for e in ([] if self.overwrite else index_of(self.path)) for t in e["frames"]}
        seen = set()
        for _, case, component, frames in archives:
            for t in frames:
                if (case, component, t) in taken or (case, component, t) in seen:
                    self._clear()
                    raise ValueError(f"frame {t} of {case}, {component} is there already")
                seen.add((case, component, t))
        entries = []
        for name, case, component, frames in archives:
            place = f"{component}/{case}/{name}"
            system.create_dir(f"{root}/{component}/{case}", recursive=True)
            system.move(f"{root}/_job-{self.job}/{name}", f"{root}/{place}")
            entries.append({"path": place, "case_id": case, "component": component, "frames": frames})
        older = [f for f in _indexes(self.path)] if self.overwrite else []
        system.create_dir(f"{root}/_index", recursive=True)
        with system.open_output_stream(f"{root}/_index/.{self.job}.part") as out:
            out.write(json.dumps(entries).encode())
        system.move(f"{root}/_index/.{self.job}.part", f"{root}/_index/{self.job}.json")
        for f in older:  # from here on readers see the new write only
            gone = json.loads(_bytes(system, f))
            system.delete_file(f)
            for e in gone:
                system.delete_file(f"{root}/{e['path']}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        system, inner = file_system(f"{self.path}/_job-{self.job}")
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


def _bytes(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_file(path) as handle:
        return handle.read()


def _indexes(path: str) -> list[str]:
    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/_index", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def index_of(path: str) -> list[dict]:
    """All archives of a folder: path, case, component and frames of each."""
    system, _ = file_system(_folder(path))
    lists = each_of(_indexes(_folder(path)), lambda f: json.loads(_bytes(system, f)))
    return [entry for entries in lists for entry in entries]


class ArraySinkReader(DataSourceReader):
    """The frames that were written; of given cases, components and frames the matching members are opened only."""

    def __init__(self, options: dict[str, str]):
        self.path = _folder(options["path"])
        self.wanted = Wanted(options, ["t"], ["case_id", "component"])

    def partitions(self):
        parts = []
        for e in index_of(self.path):
            if self.wanted.has("case_id", e["case_id"]) and self.wanted.has("component", e["component"]):
                frames = [t for t in e["frames"] if len(self.wanted.of("t", 1, t))]
                if frames:
                    parts.append(FramePart(f"{self.path}/{e['path']}", tuple((t, f"arr_{t}") for t in frames), e["case_id"], e["component"]))
        return parts

    def read(self, part):
        if part is None:
            return
        for t, _, frame in read_member(part):
            values = frame.ravel()
            data = pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values, mask=~np.isfinite(values)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.case]), pa.array([t], pa.int32()), pa.array([part.component]), pa.array([frame.shape[0]], pa.int32()), pa.array([frame.shape[1]], pa.int32()), data],
                names=["case_id", "t", "component", "ny", "nx", "data"],
            )


class ArraySink(DataSource):
    @classmethod
    def name(cls):
        return "frame_sink"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArraySinkReader(dict(self.options))

    def writer(self, schema, overwrite):
        return ArraySinkWriter(dict(self.options), overwrite)
