"""Order of frames: interleaving, appending, shifting and cutting runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.functions.scalar import frame_number
from eddyfield.model import FRAMES_PER_BLOCK
from eddyfield.session import settle


def _from(voxel: DataFrame, start: int) -> DataFrame:
    """Frames from ``start`` on; also prunes the frame blocks on disk."""
    if "t_block" in voxel.columns:
        voxel = voxel.filter(F.col("t_block") >= start // FRAMES_PER_BLOCK)
    return voxel.filter(F.col("t") >= start)


def _renumbered(voxel: DataFrame, t) -> DataFrame:
    """Frames under new numbers; the block of the old number no longer holds."""
    return voxel.drop("t_block").withColumn("t", t)


def interleave_heads(a: DataFrame, b: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Frames of two heads in turn: even frames from head A, odd ones from head B.

    Both count their own frames from 0; the longer head is cut to the shorter one. The first
    ``offset`` frames are skipped, at most ``limit`` are kept, and the rest is renumbered.
    Nothing is sorted: the new number of a frame is arithmetic on the old one.
    """
    if offset < 0:
        raise ValueError("offset must not be negative")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")

    def length(head: DataFrame, name: str) -> DataFrame:
        return head.groupBy("case_id").agg((F.max("t") + 1).alias(name))

    pairs = settle(
        length(a, "n_a").join(length(b, "n_b"), "case_id").select("case_id", F.least("n_a", "n_b").alias("_pairs")),
        "pairs",
    )
    if not pairs.filter(F.col("_pairs") * 2 <= offset).isEmpty():
        raise ValueError(f"offset {offset} exceeds the available frames")
    both = _renumbered(a, F.col("t") * 2).unionByName(_renumbered(b, F.col("t") * 2 + 1))
    kept = both.join(pairs, "case_id").filter((F.col("t") < F.col("_pairs") * 2) & (F.col("t") >= offset)).drop("_pairs")
    if limit is not None:
        kept = kept.filter(F.col("t") < offset + limit)
    return kept.withColumn("t", F.col("t") - offset)


def offset_limit(voxel: DataFrame, offset: int, limit: int | None = None) -> DataFrame:
    """Skip frames and cap their number: a range of the dense frame number."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    kept = _from(voxel, offset)
    if limit is not None:
        if "t_block" in voxel.columns:
            kept = kept.filter(F.col("t_block") <= (offset + limit) // FRAMES_PER_BLOCK)
        kept = kept.filter(F.col("t") < offset + limit)
    return _renumbered(kept, F.col("t") - offset)


def concat_stacks(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second run appended after the first one, per case."""
    if first.isEmpty() and second.isEmpty():
        raise ValueError("both runs are empty")
    ends = settle(first.groupBy("case_id").agg((F.max("t") + 1).alias("_end")), "ends")
    moved = _renumbered(second.join(ends, "case_id", "left"), F.col("t") + F.coalesce(F.col("_end"), F.lit(0)))
    return first.drop("t_block").unionByName(moved.drop("_end"))


def circular_lag(voxel: DataFrame, lag: int, extent: DataFrame) -> DataFrame:
    """out[t] = in[(t + lag) mod T] as arithmetic on t. ``extent(case_id, nt)`` is small."""
    sized = voxel.join(extent.select("case_id", "nt"), "case_id")
    return _renumbered(sized, F.pmod(F.col("t") - F.lit(lag), F.col("nt"))).drop("nt")


def frame_order(frames: DataFrame, key: str = "key") -> DataFrame:
    """Frame keys in numeric order; keys of another form last, by name."""
    return frames.orderBy(frame_number(F.col(key)).asc_nulls_last(), key)


def train_test(voxel: DataFrame, n_train: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n_train`` frames, and the others renumbered from 0."""
    train = voxel.filter(F.col("t") < n_train)
    if "t_block" in voxel.columns:
        train = train.filter(F.col("t_block") <= n_train // FRAMES_PER_BLOCK)
    return train, _renumbered(_from(voxel, n_train), F.col("t") - n_train)


def upsert_component(archive: DataFrame, update: DataFrame, component: str) -> DataFrame:
    """Replace one component of a mean-field archive and keep the others."""
    keys = ["case_id", "y", "x"]
    new = update.select(*keys, component)
    return archive.drop(component).join(new, keys, "left").select(*archive.columns)
