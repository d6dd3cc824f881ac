"""Reading stacks, frame lists, text series and manifests; finding files; storing results."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyfield.session import settle
from eddyfield.sources import arrays, register


Span = tuple[int | None, int | None]


def scan_stack(
    spark: SparkSession,
    components: dict[str, str],
    *,
    case_id: str = "case",
    axes: str = "tyx",
    frame: int | None = None,
    t: Span = (None, None),
    y: Span = (None, None),
    x: Span = (None, None),
) -> DataFrame:
    """Voxel rows of one case from ``.npy`` stacks, one path per component, or one frame only. The half-open ranges of
    frames, rows and columns are all that is read; places keep their numbers in the stacks."""
    register(spark)
    spans = {f"{place}_span": arrays.span_option(span) for place, span in (("t", t), ("y", y), ("x", x))}
    reader = spark.read.format("field_stack").options(case_id=case_id, axes=axes, **spans, **components)
    if frame is not None:
        reader = reader.option("frame", str(frame))
    return reader.load()


STACK_NAME = "piv_{case}_{component}.npy"
MEAN_NAME = "{case}_{component}_mean.npy"


def scan_components(
    spark: SparkSession,
    folder: str,
    case_id: str,
    *,
    components: tuple[str, ...] = ("u", "v", "w"),
    name: str = STACK_NAME,
    axes: str = "tyx",
    t: Span = (None, None),
    y: Span = (None, None),
    x: Span = (None, None),
) -> DataFrame:
    """Voxel rows of a case from stacks that are named by a convention, within half-open ranges of frames, rows and
    columns."""
    paths = {k: f"{folder.rstrip('/')}/{name.format(case=case_id, component=k)}" for k in components}
    return scan_stack(spark, paths, case_id=case_id, axes=axes, t=t, y=y, x=x)


def scan_arrays(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """2-D ``.npy`` arrays by name as ``(name, ny, nx, y, x, value)``, one row per element; 1-D ones have one row. An
    array is as large as the sensor; each is read by one task."""
    names = [(os.path.basename(p), n) for n, p in paths.items()]
    if len({base for base, _ in names}) != len(names):
        raise ValueError("the files must differ in name")
    found = spark.read.format("binaryFile").load(list(paths.values())).select(F.element_at(F.split("path", "/"), -1).alias("base"), "content")
    named = found.join(F.broadcast(spark.createDataFrame(names, "base string, name string")), "base")  # one row per path given

    def unpack(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                if values.ndim != 2:
                    raise ValueError(f"{name} is not a 2-D array: shape {values.shape}")
                y, x = (i.ravel().astype("int32") for i in np.indices(values.shape))
                flat = values.ravel().astype("float64")
                sizes = [pa.array(np.full(flat.size, n, dtype="int32")) for n in values.shape]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(name, flat.size), *sizes, pa.array(y), pa.array(x), pa.array(flat, mask=~np.isfinite(flat))],
                    names=["name", "ny", "nx", "y", "x", "value"],
                )

    return named.select("name", "content").mapInArrow(unpack, "name string, ny int, nx int, y int, x int, value double")


def scan_mean_fields(
    spark: SparkSession, folder: str, case_id: str, *, components: tuple[str, ...] = ("u", "v", "w"), name: str = MEAN_NAME
) -> DataFrame:
    """The mean fields of a case ``(case_id, y, x, <component>, ...)``, which must be of one size."""
    paths = {k: f"{folder.rstrip('/')}/{name.format(case=case_id, component=k)}" for k in components}
    rows = settle(scan_arrays(spark, paths), "means")
    sizes = rows.select("name", "ny", "nx").distinct().collect()
    if len({(r["ny"], r["nx"]) for r in sizes}) > 1:
        raise ValueError(f"the mean fields of {case_id} differ in size: " + ", ".join(f"{r['name']} {r['ny']} x {r['nx']}" for r in sorted(sizes)))
    values = [F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in components]
    return rows.groupBy(F.lit(case_id).alias("case_id"), "y", "x").agg(*values)


def scan_grid(spark: SparkSession, x_path: str, y_path: str, *, case_id: str = "case") -> DataFrame:
    """A mesh ``grid(case_id, y, x, x_mm, y_mm)`` from two 2-D arrays of coordinates, or from two axes. Any other pair is
    refused."""
    rows = settle(scan_arrays(spark, {"x": x_path, "y": y_path}), "grid")
    sizes = {r["name"]: (r["ny"], r["nx"]) for r in rows.select("name", "ny", "nx").distinct().collect()}
    of_x, of_y = (rows.filter(F.col("name") == n) for n in ("x", "y"))
    if sizes["x"] == sizes["y"] and sizes["x"][0] > 1:
        both = of_x.select("y", "x", F.col("value").alias("x_mm")).join(of_y.select("y", "x", F.col("value").alias("y_mm")), ["y", "x"])
    elif sizes["x"][0] == sizes["y"][0] == 1:
        # two axes: each element of one meets each of the other, which is the mesh itself
        size = sizes["x"][1]
        columns = of_x.select("x", F.col("value").alias("x_mm"))
        both = of_y.select(F.col("x").alias("y"), F.col("value").alias("y_mm"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("x")).join(columns, "x")
    else:
        raise ValueError(f"x and y must both be axes or meshes of one size; got x {sizes['x']} and y {sizes['y']}")
    return both.select(F.lit(case_id).alias("case_id"), "y", "x", "x_mm", "y_mm")


def scan_frame_list(
    spark: SparkSession, path: str, *, case_id: str = "case", component: str = "c", t: Span = (None, None), keys: list[str] | None = None
) -> DataFrame:
    """Frames of an ``.npz`` list in numeric order of their keys, one row per frame. Of a half-open range of frames, or of
    given keys, only those are unpacked."""
    register(spark)
    reader = spark.read.format("frame_list").options(path=path, case_id=case_id, component=component, t_span=arrays.span_option(t))
    if keys is not None:
        reader = reader.option("key_list", json.dumps(keys))
    return reader.load()


def voxels_of(frames: DataFrame) -> DataFrame:
    """Frame rows as one row per pixel: ``(case_id, t, component, y, x, value)``."""
    return frames.select("case_id", "t", "component", "nx", F.posexplode("data").alias("at", "value")).select(
        "case_id",
        "t",
        "component",
        F.floor(F.col("at") / F.col("nx")).cast("int").alias("y"),
        (F.col("at") % F.col("nx")).cast("int").alias("x"),
        "value",
    )


def frames_of(voxel: DataFrame, value: str) -> DataFrame:
    """One row per frame with its values in row order: a frame is as large as the sensor."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", F.col(value).cast("float").alias("value"))))
    return (
        voxel.groupBy("case_id", "t")
        .agg(cells.alias("cells"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
        .select("case_id", "t", F.lit(value).alias("component"), "ny", "nx", F.col("cells.value").alias("data"))
    )


def write_arrays(frames: DataFrame, root: str, form: str, frames_per_file: int = 16) -> DataFrame:
    """Write frames ``(case_id, t, component, ny, nx, data)`` as array files, in parallel:
    ``<root>/<component>/<case_id>/<first frame>.npy`` or ``.npz``. Returns one row per file."""
    if form not in ("npy", "npz"):
        raise ValueError(f"unknown form {form}")
    register(frames.sparkSession)

    def write(key, pdf):
        import io

        import numpy as np

        case, component, block = key
        pdf = pdf.sort_values("t")
        stack = [
            np.asarray(data, dtype=np.float32).reshape(ny, nx)
            for data, ny, nx in zip(pdf["data"], pdf["ny"], pdf["nx"])
        ]
        buffer = io.BytesIO()
        if form == "npy":
            np.save(buffer, np.stack(stack))
        else:
            np.savez(buffer, **{f"arr_{t}": a for t, a in zip(pdf["t"], stack)})
        path = f"{root}/{component}/{case}/{int(block) * frames_per_file:09d}.{form}"
        arrays.write_bytes(path, buffer.getvalue())
        return type(pdf)({"case_id": [case], "component": [component], "path": [path], "frames": [len(stack)]})

    block = F.floor(F.col("t") / F.lit(frames_per_file)).cast("int")
    return (
        frames.withColumn("_block", block)
        .groupBy("case_id", "component", "_block")
        .applyInPandas(write, "case_id string, component string, path string, frames int")
    )


def sink_frames(frames: DataFrame, path: str, mode: str = "append", frames_per_file: int = 16) -> None:
    """Store frames ``(case_id, t, component, ny, nx, data)`` as array archives, all of them or none. ``append`` refuses
    frames that are there already; ``overwrite`` replaces everything."""
    register(frames.sparkSession)
    shape = [F.col("case_id"), F.col("t").cast("int"), F.col("component"), F.col("ny").cast("int"), F.col("nx").cast("int"), F.col("data").cast("array<float>")]
    frames.select(*shape).write.format("frame_sink").mode(mode).option("frames_per_file", str(frames_per_file)).option("path", path).save()


def scan_frames(
    spark: SparkSession, path: str, *, cases: list[str] | None = None, components: list[str] | None = None, t: Span = (None, None)
) -> DataFrame:
    """The frames that ``sink_frames`` stored, or those of some cases, components and a half-open range of frames."""
    register(spark)
    reader = spark.read.format("frame_sink").options(path=path, t_span=arrays.span_option(t))
    for name, wanted in (("case_id", cases), ("component", components)):
        if wanted is not None:
            reader = reader.option(f"{name}_list", json.dumps(wanted))
    return reader.load()


def write_field_arrays(fields: DataFrame, root: str, name: str = MEAN_NAME) -> DataFrame:
    """Write fields ``(case_id, y, x, <value>, ...)`` as 2-D ``.npy`` arrays, one per case and value, named by a convention. A
    field is as large as the sensor. Returns one row per file."""
    values = [c for c in fields.columns if c not in ("case_id", "y", "x")]
    register(fields.sparkSession)
    cell = F.explode(F.array(*[F.struct(F.lit(v).alias("component"), F.col(v).cast("double").alias("value")) for v in values]))

    def write(key, pdf):
        import io

        import numpy as np

        case, component = key
        out = np.full((pdf["y"].max() + 1, pdf["x"].max() + 1), np.nan)
        out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["value"].to_numpy(dtype="float64", na_value=np.nan)
        buffer = io.BytesIO()
        np.save(buffer, out)
        path = f"{root}/{name.format(case=case, component=component)}"
        arrays.write_bytes(path, buffer.getvalue())
        return type(pdf)({"case_id": [case], "component": [component], "path": [path]})

    rows = fields.select("case_id", "y", "x", cell.alias("v")).select("case_id", "y", "x", "v.*")
    return rows.groupBy("case_id", "component").applyInPandas(write, "case_id string, component string, path string")


def scan_text_series(
    spark: SparkSession,
    path: str,
    *,
    skiprows: int = 0,
    comment: str | None = "#",
    delimiter: str | None = None,
    xcol: int | None = 0,
    ycol: int = 1,
    y_scale: float = 1.0,
) -> DataFrame:
    """Text files of numbers as ``series(source, row_no, x, y)``; the source is the file's stem.

    Files are read in splits. A line's number is its place in its split plus the lines of the
    splits before it, so no file has to pass through one task.
    """
    lines = settle(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),  # consecutive within a split
        ),
        "lines",
    )

    def before(df: DataFrame, *more: Column) -> DataFrame:
        """Rows of the earlier splits of the same file: one row per split."""
        counts = df.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), *more)
        earlier = F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")
        return settle(counts.withColumn("before", earlier).drop("n"), "splits")

    starts = before(lines, F.min("id").alias("first"))
    line = F.col("id") - F.col("first") + F.col("before")
    text = F.col("value")
    if comment:
        text = F.substring_index(text, comment, 1)
    usable = (
        lines.join(starts, ["path", "split"])
        .filter(line >= skiprows)
        .withColumn("text", F.trim(text))
        .filter("text != ''")
        .select("path", "split", "id", "text")
    )
    splitter = r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E"
    place = F.row_number().over(Window.partitionBy("path", "split").orderBy("id")) - 1
    rows = (
        usable.withColumn("place", place)
        .join(before(usable), ["path", "split"])
        .select("path", (F.col("before") + F.col("place")).alias("row_no"), F.split("text", splitter).alias("f"))
    )
    single = F.size("f") == 1

    def column(i: int) -> Column:
        return F.trim(F.element_at("f", i + 1)).cast("double")

    index = F.col("row_no").cast("double")
    stem = F.regexp_extract(F.url_decode("path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    x = index if xcol is None else F.when(single, index).otherwise(column(xcol))
    y = F.when(single, F.col("f")[0].cast("double")).otherwise(column(ycol))
    return rows.select(stem.alias("source"), "row_no", x.alias("x"), (y * F.lit(y_scale)).alias("y"))


def series_stats(series: DataFrame) -> DataFrame:
    """Mean and standard deviation of every series."""
    y = F.when(~F.isnan("y"), F.col("y"))
    return series.groupBy("source").agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of heads from lines ``headA | headB | name``: ``pair(head_a, head_b, name)``.

    Blank lines and ``#`` lines are skipped. Every line needs two fields; names are given on
    all lines or on none.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    fields = F.transform(F.split("line", r"\|"), lambda f: F.trim(f))
    parsed = lines.filter("line != '' AND NOT startswith(line, '#')").select(fields.alias("f"))
    name = F.when(F.size("f") >= 3, F.nullif(F.element_at(F.concat("f", F.array(F.lit(""), F.lit(""), F.lit(""))), 3), F.lit("")))
    checked = parsed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("f") < 2).alias("short"), F.count(name).alias("named")
    ).first()
    if checked["n"] == 0:
        raise ValueError(f"no usable lines in {path}")
    if checked["short"]:
        raise ValueError(f"{checked['short']} lines in {path} lack a head")
    if checked["named"] not in (0, checked["n"]):
        raise ValueError("give names on all lines or on none")
    return parsed.select(F.col("f")[0].alias("head_a"), F.col("f")[1].alias("head_b"), name.alias("name"))


def missing_inputs(pairs: DataFrame) -> DataFrame:
    """Paths of a manifest where there is no file: ``(path)``. The tasks look, not the driver."""
    register(pairs.sparkSession)
    paths = pairs.select(F.explode(F.array("head_a", "head_b")).alias("path")).distinct()

    def look(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            asked = batch.column(0).to_pylist()
            kinds = arrays.each_of(asked, lambda path: (lambda found: found[0].get_file_info(found[1]).type)(arrays.file_system(path)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, k in zip(asked, kinds) if k == fs.FileType.NotFound], pa.string())], names=["path"])

    return paths.mapInArrow(look, "path string")


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a manifest, all of whose files exist."""
    pairs = settle(scan_manifest(spark, path), "pairs")
    missing = [r["path"] for r in missing_inputs(pairs).orderBy("path").limit(10).collect()]
    if missing:
        raise FileNotFoundError(f"input files not found: {', '.join(missing)}")
    return pairs


def write_split(tables: dict[str, DataFrame], name: str, n_train: int, root: str) -> None:
    """Two copies of a set of tables, ``<root>/train`` and ``<root>/test``: the frames of the table ``name`` are dealt to
    them, before ``n_train`` and from there on (renumbered from 0); all other tables are in both, whole."""
    from eddyfield.operators.sequence import train_test

    for part, frames in zip(("train", "test"), train_test(tables[name], n_train)):
        frames.write.mode("errorifexists").parquet(f"{root}/{part}/{name}")
        for other, table in tables.items():
            if other != name:
                table.write.mode("errorifexists").parquet(f"{root}/{part}/{other}")


def find_inputs(spark: SparkSession, folder: str, pattern: str = "*", words: tuple[str, ...] = ()) -> DataFrame:
    """Files of a folder in order of their path, optionally only those whose lower-case name
    holds every word. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    for word in words:
        found = found.filter(F.contains(name, F.lit(word.lower())))
    return found.orderBy("path")


def first_input(spark: SparkSession, folder: str, pattern: str, words: tuple[str, ...]) -> str:
    """Path of the first matching file."""
    path = find_inputs(spark, folder, pattern, words).agg(F.min("path")).first()[0]
    if path is None:
        raise FileNotFoundError(f"no file in {folder} has all of {words} in its name")
    return path


def output_name(head_a: str, head_b: str, name: str | None = None) -> str:
    """Given name, or ``<stem of A>_and_<stem of B>``."""
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    return name or f"{stem(head_a)}_and_{stem(head_b)}"


def sink_fields(fields: DataFrame, path: str, overwrite: bool = True) -> None:
    """Store result fields by case; without ``overwrite`` an existing output stays as it is. Where several
    writers may come at the same time, see ``versions.write_once``."""
    fields.write.mode("overwrite" if overwrite else "ignore").partitionBy("case_id").parquet(path)


def export_filled(df: DataFrame, path: str, *values: str) -> None:
    """Store a copy with missing values as 0."""
    df.fillna(0.0, subset=list(values)).write.mode("errorifexists").parquet(path)
