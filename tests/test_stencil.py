"""Neighbour differences and filters, against NumPy, with tiles smaller than the data."""

from __future__ import annotations

import numpy as np
import pytest
from numpy.lib.stride_tricks import sliding_window_view

from eddyfield.model import shape_of
from eddyfield.operators import stencil
from eddyfield.operators.stencil import Tile

TILES = [Tile(), Tile(2, 2, 3), Tile(1, 1, 1)]
VOXEL = ("t", "y", "x")


@pytest.fixture(scope="module")
def c():
    values = np.random.default_rng(5).random((5, 4, 7))
    values[2, 1, 3] = np.nan
    values[0, 0, 6] = np.nan
    return values


@pytest.mark.parametrize("tile", TILES, ids=str)
def test_gradients(cube, field, c, tile):
    spatial = stencil.spatial_gradient(cube(c=c), dx=0.5, dy=0.25, tile=tile)
    assert np.array_equal(field(spatial, "d_dx", VOXEL), np.gradient(c, 0.5, axis=2), equal_nan=True)
    assert np.array_equal(field(spatial, "d_dy", VOXEL), np.gradient(c, 0.25, axis=1), equal_nan=True)
    temporal = stencil.temporal_gradient(cube(c=c), dt=0.05, tile=tile)
    assert np.array_equal(field(temporal, "d_dt", VOXEL), np.gradient(c, 0.05, axis=0), equal_nan=True)


@pytest.mark.parametrize("tile", TILES, ids=str)
def test_gradient_means(cube, field, c, tile):
    dx, dt = np.gradient(c, 0.5, axis=2), np.gradient(c, 0.05, axis=0)
    got = stencil.gradient_means(cube(c=c), tile=tile)
    with np.errstate(all="ignore"):
        assert np.allclose(field(got, "dx_mean"), np.nanmean(dx, axis=0), equal_nan=True)
        assert np.allclose(field(got, "dx_dt_mean"), np.nanmean(-dx * dt, axis=0), equal_nan=True)


@pytest.mark.parametrize("tile", TILES, ids=str)
def test_motion_correlator(cube, field, c, tile):
    a = np.where(c < 0.1, np.nan, c) - np.nanmean(c, axis=0)
    a = a[1:]  # pairs start one frame late
    hx = a[1:, 1:, 1:] * a[:-1, 1:, :-1] - a[:-1, 1:, 1:] * a[1:, 1:, :-1]
    hy = a[1:, 1:, 1:] * a[:-1, :-1, 1:] - a[:-1, 1:, 1:] * a[1:, :-1, 1:]
    got = stencil.motion_correlator(cube(c=c), c_min=0.1, tile=tile)
    with np.errstate(all="ignore"):
        for name, want in (("corr_x", hx), ("corr_y", hy)):
            assert np.allclose(field(got, name)[1:, 1:], np.nanmean(want, axis=0), equal_nan=True)


def test_correlator_frame(cube, field, c):
    got = field(stencil.correlator_frame(cube(c=c), 3, tile=Tile(2, 2, 2)), "corr")[:, 1:]
    assert np.allclose(got, c[3, :, 1:] * c[2, :, :-1] - c[2, :, 1:] * c[3, :, :-1], equal_nan=True)
    with pytest.raises(IndexError):
        stencil.correlator_frame(cube(c=c), 0)


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("tile", [Tile(), Tile(4, 3, 3)], ids=str)
def test_median_filter(cube, field, c, k, tile):
    table = cube(c=c)
    got = field(stencil.median_filter(table, "c", k, shape_of(table), tile=tile), "c", VOXEL)
    for t in range(c.shape[0]):
        windows = sliding_window_view(np.pad(c[t], k // 2, mode="edge"), (k, k))
        with np.errstate(all="ignore"):
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                assert np.array_equal(got[t], np.nanmedian(windows, axis=(-2, -1)), equal_nan=True)


def test_median_window_must_be_odd(cube):
    table = cube(c=np.zeros((1, 3, 3)))
    with pytest.raises(ValueError):
        stencil.median_filter(table, "c", 4, shape_of(table))
