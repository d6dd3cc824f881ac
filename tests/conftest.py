from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from eddyfield.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cube(spark):
    """Voxel rows from arrays shaped (t, y, x); NaN becomes NULL."""

    def build(case: str = "a", **components: np.ndarray):
        shape = next(iter(components.values())).shape
        t, y, x = np.indices(shape)
        columns = [[None if np.isnan(v) else float(v) for v in values.ravel()] for values in components.values()]
        places = [[int(i) for i in index.ravel()] for index in (t, y, x)]
        rows = list(zip([case] * t.size, *places, *columns))
        return spark.createDataFrame(rows, "case_id string, t int, y int, x int, " + ", ".join(f"{k} double" for k in components))

    return build


@pytest.fixture(scope="session")
def field():
    """A result of (y, x) rows as an array; NULL becomes NaN."""

    def build(df, value: str, dims: tuple[str, ...] = ("y", "x")) -> np.ndarray:
        rows = df.select(*dims, value).collect()
        out = np.full([max(r[i] for r in rows) + 1 for i in range(len(dims))], np.nan)
        for r in rows:
            out[tuple(r[: len(dims)])] = np.nan if r[-1] is None else r[-1]
        return out

    return build
