"""Order of frames, readers and writers over the fixture.

The files that are read here are written by Spark from the given tables, in parallel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.functions.scalar import frame_number
from eddyfield.model import PIXEL, VOXEL, extent
from eddyfield.operators import align, sequence, stats
from eddyfield.plans.fixture import _once, voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.stats_queries import MEAN_SQL
from eddyfield.session import new_path, settle
from eddyfield.sources import arrays, register, tables, versions


def heads_of(spark, sf_dir):
    """The two cases as the two heads of one recording."""
    table = voxel(spark, sf_dir)
    one = lambda case: table.filter(F.col("case_id") == case).select(F.lit("run").alias("case_id"), "t", "y", "x", "c")
    return one("case0"), one("case1")


HEADS_SQL = """
lengths AS (SELECT least(max(t) FILTER (case_id = 'case0'), max(t) FILTER (case_id = 'case1')) + 1 AS pairs FROM voxel),
turns AS MATERIALIZED (SELECT 'run' AS case_id, 2 * t + CASE case_id WHEN 'case0' THEN 0 ELSE 1 END AS t, y, x, c FROM voxel, lengths WHERE t < pairs)"""


@query("interleave_heads", "SELECT case_id, t, y, x, c FROM turns", HEADS_SQL)
def interleave_heads(spark, sf_dir):
    """At an odd number of frames head A is one frame longer; it is cut."""
    return sequence.interleave_heads(*heads_of(spark, sf_dir))


@query("interleave_heads_slice", "SELECT case_id, t - 1 AS t, y, x, c FROM turns WHERE t >= 1 AND t < 8", HEADS_SQL)
def interleave_heads_slice(spark, sf_dir):
    return sequence.interleave_heads(*heads_of(spark, sf_dir), offset=1, limit=7)


@query("offset_limit", "SELECT case_id, t - 1 AS t, y, x, c FROM voxel WHERE t >= 1 AND t < 10")
def offset_limit(spark, sf_dir):
    return sequence.offset_limit(voxel(spark, sf_dir), 1, 9).select(*VOXEL, "c")


@query("concat_stacks", "SELECT 'run' AS case_id, t + CASE case_id WHEN 'case0' THEN 0 ELSE (SELECT max(t) + 1 FROM voxel WHERE case_id = 'case0') END AS t, y, x, c FROM voxel")
def concat_stacks(spark, sf_dir):
    """One case appended after the other."""
    return sequence.concat_stacks(*heads_of(spark, sf_dir))


@query("circular_lag", "SELECT case_id, (t - 7 % nt + nt) % nt AS t, y, x, u, v FROM voxel JOIN (SELECT case_id, max(t) + 1 AS nt FROM voxel GROUP BY ALL) USING (case_id)")
def circular_lag(spark, sf_dir):
    table = voxel(spark, sf_dir)
    return sequence.circular_lag(table, 7, extent(table)).select(*VOXEL, "u", "v")


@query("frame_order", "SELECT DISTINCT 'arr_' || t AS key, CAST(t AS BIGINT) AS number FROM voxel UNION ALL SELECT DISTINCT 'extra_' || y, NULL FROM voxel")
def frame_order(spark, sf_dir):
    """arr_2 before arr_10, other keys last by name, with the number that orders them."""
    table = voxel(spark, sf_dir)
    numbered = table.select(F.concat(F.lit("arr_"), F.col("t").cast("string")).alias("key"))
    others = table.select(F.concat(F.lit("extra_"), F.col("y").cast("string")).alias("key"))
    keys = numbered.unionByName(others).distinct()
    return sequence.frame_order(keys.withColumn("number", frame_number(F.col("key"))))


@query("train_test_split", "SELECT 'train' AS part, case_id, t, y, x, c FROM voxel WHERE t < 2 UNION ALL SELECT 'test', case_id, t - 2, y, x, c FROM voxel WHERE t >= 2")
def train_test_split(spark, sf_dir):
    parts = []
    for name, part in zip(("train", "test"), sequence.train_test(voxel(spark, sf_dir), 2)):
        path = new_path(spark, name)
        tables.sink_fields(part.select(*VOXEL, "c"), path)
        parts.append(spark.read.parquet(path).select(F.lit(name).alias("part"), *VOXEL, "c"))
    return parts[0].unionByName(parts[1])


@query("upsert_component", f"SELECT case_id, y, x, {r('u', 'u')}, {r('v', 'v')}, {r('sqrt(w2)', 'w')}, {r('c', 'c')} FROM mean_field "
       "JOIN (SELECT case_id, y, x, avg(w * w) AS w2 FROM voxel GROUP BY ALL) USING (case_id, y, x)", MEAN_SQL)
def upsert_component(spark, sf_dir):
    """A new w in the stored archive: a second version beside the first."""
    table, root = voxel(spark, sf_dir), new_path(spark, "archive")
    versions.append_version(align.mean_field(table), root)
    update = stats.rms_raw(table, "w").withColumnRenamed("w_rms", "w")
    versions.update_version(spark, root, lambda archive: sequence.upsert_component(archive, update, "w"))
    return rounded(versions.read_version(spark, root).select(*PIXEL, "u", "v", "w", "c"), 6, "u", "v", "w", "c")


@query("sink_fields", f"SELECT case_id, y, x, {r('u', 'u')}, {r('c', 'c')} FROM mean_field", MEAN_SQL)
def sink_fields(spark, sf_dir):
    path = new_path(spark, "fields")
    tables.sink_fields(align.mean_field(voxel(spark, sf_dir), "u", "c"), path)
    return rounded(spark.read.parquet(path).select(*PIXEL, "u", "c"), 6, "u", "c")


@query("sink_if_absent", f"SELECT case_id, y, x, {r('u', 'value')} FROM mean_field", MEAN_SQL)
def sink_if_absent(spark, sf_dir):
    """The second write finds the output and leaves it."""
    table = voxel(spark, sf_dir)
    root = new_path(spark, tables.output_name("runs/headA.set", "runs/headB.set"))
    for component in ("u", "v"):
        field = align.mean_field(table, component).withColumnRenamed(component, "value")
        versions.write_once(field, root)
    return rounded(versions.read_version(spark, root).select(*PIXEL, "value"), 6, "value")


@query("export_filled", "SELECT case_id, t, y, x, coalesce(v, 0) AS v, coalesce(c, 0) AS c FROM voxel")
def export_filled(spark, sf_dir):
    path = new_path(spark, "filled")
    tables.export_filled(voxel(spark, sf_dir).select(*VOXEL, "v", "c"), path, "v", "c")
    return spark.read.parquet(path)


def stack_files(spark, sf_dir):
    """The voxels as ``.npy`` stacks of 16 frames; one row per file."""

    def build():
        table, root = voxel(spark, sf_dir), new_path(spark, "stacks")
        frames = tables.frames_of(table, "u").unionByName(tables.frames_of(table, "c"))
        written = tables.write_arrays(frames, root, "npy")
        return settle(written.withColumn("root", F.lit(root)), "stack_files")

    return _once(spark, sf_dir, "stack_files", build)


F32 = "CAST(CAST({0} AS FLOAT) AS DOUBLE) AS {0}"


@query("scan_stack", f"SELECT case_id, t, y, x, {F32.format('u')}, {F32.format('c')} FROM voxel")
def scan_stack(spark, sf_dir):
    """Both cases read back from their stacks, two components side by side."""
    root = stack_files(spark, sf_dir).first()["root"]
    cases = [
        tables.scan_stack(spark, {k: f"{root}/{k}/{case}" for k in ("u", "c")}, case_id=case) for case in ("case0", "case1")
    ]
    both = cases[0].unionByName(cases[1])
    return both.withColumn("u", F.col("u").cast("double")).withColumn("c", F.col("c").cast("double"))


@query("scan_stack_frame", f"SELECT case_id, t, y, x, {F32.format('c')} FROM voxel WHERE t = 1 AND case_id = 'case1'")
def scan_stack_frame(spark, sf_dir):
    """One frame only: one task seeks to it."""
    root = stack_files(spark, sf_dir).first()["root"]
    one = tables.scan_stack(spark, {"c": f"{root}/c/case1"}, case_id="case1", frame=1)
    return one.withColumn("c", F.col("c").cast("double"))


@query("scan_stack_ranges", f"SELECT case_id, t, y, x, {F32.format('u')}, {F32.format('c')} FROM voxel WHERE t BETWEEN 1 AND 20 AND y BETWEEN 2 AND 5 AND x >= 4 AND x < 17 AND case_id = 'case1'")
def scan_stack_ranges(spark, sf_dir):
    """The reader knows the ranges: no task for other frames, no byte of other rows."""
    root = stack_files(spark, sf_dir).first()["root"]
    some = tables.scan_stack(spark, {k: f"{root}/{k}/case1" for k in ("u", "c")}, case_id="case1", t=(1, 21), y=(2, 6), x=(4, 17))
    return some.withColumn("u", F.col("u").cast("double")).withColumn("c", F.col("c").cast("double"))


@query("find_inputs", "SELECT DISTINCT lpad(CAST((t // 16) * 16 AS VARCHAR), 9, '0') || '.npy' AS name FROM voxel WHERE case_id = 'case0'")
def find_inputs(spark, sf_dir):
    root = stack_files(spark, sf_dir).first()["root"]
    found = tables.find_inputs(spark, f"{root}/c/case0", "*.npy", ("000", "NPY"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("scan_frame_list", f"SELECT case_id, t, 'arr_' || t AS key, 'c' AS component, y, x, CAST(CAST(c AS FLOAT) AS DOUBLE) AS value FROM voxel")
def scan_frame_list(spark, sf_dir):
    """Lists of frames, written as archives of 16 and read in numeric order of the keys."""
    root = new_path(spark, "lists")
    tables.write_arrays(tables.frames_of(voxel(spark, sf_dir), "c"), root, "npz").count()
    lists = [tables.scan_frame_list(spark, f"{root}/c/{case}", case_id=case) for case in ("case0", "case1")]
    frames = lists[0].unionByName(lists[1])
    keys = frames.select("case_id", "t", "key")
    return tables.voxels_of(frames).join(keys, ["case_id", "t"]).withColumn("value", F.col("value").cast("double"))


@query("scan_frame_list_keys", "SELECT case_id, t, 'arr_' || t AS key, y, x, CAST(CAST(c AS FLOAT) AS DOUBLE) AS value FROM voxel WHERE case_id = 'case0' AND t IN (0, 2)")
def scan_frame_list_keys(spark, sf_dir):
    """Only the wanted members of the archives are unpacked."""
    root = new_path(spark, "lists")
    tables.write_arrays(tables.frames_of(voxel(spark, sf_dir), "c"), root, "npz").count()
    frames = tables.scan_frame_list(spark, f"{root}/c/case0", case_id="case0", t=(None, 3), keys=["arr_0", "arr_2", "arr_3"])
    cells = tables.voxels_of(frames)
    return cells.select("case_id", "t", F.concat(F.lit("arr_"), "t").alias("key"), "y", "x", F.col("value").cast("double").alias("value"))


def text_files(spark, sf_dir):
    """Events as text logs of 1000 lines under three header lines, with a comment in each."""

    def build():
        root = new_path(spark, "logs")
        register(spark)

        def write(key, pdf):
            pdf = pdf.sort_values("event_id")
            lines = ["device log", "columns: event value", "---"]
            for i, (event, value) in enumerate(zip(pdf["event_id"], pdf["value"])):
                lines.append(f"{event}  {value!r}" + ("  # checked" if i % 7 == 0 else ""))
                if i == 4:
                    lines += ["# pause", ""]
            arrays.write_bytes(f"{root}/log{int(key[0]):06d}.txt", ("\n".join(lines) + "\n").encode())
            return pdf.head(1)[["event_id"]]

        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
        events.groupBy(F.floor(F.col("event_id") / 1000)).applyInPandas(write, "event_id long").count()
        return spark.createDataFrame([(root,)], "root string")

    return _once(spark, sf_dir, "text_files", build)


LOGS_SQL = "logs AS MATERIALIZED (SELECT 'log' || lpad(CAST(event_id // 1000 AS VARCHAR), 6, '0') AS source, event_id % 1000 AS row_no, CAST(event_id AS DOUBLE) AS x, value * 1000 AS y FROM events)"


@query("scan_text_series", f"SELECT source, row_no, x, {r('y', 'y')} FROM logs", LOGS_SQL)
def scan_text_series(spark, sf_dir):
    root = text_files(spark, sf_dir).first()["root"]
    return rounded(tables.scan_text_series(spark, root, skiprows=3, y_scale=1000.0), 6, "y")


@query("text_series_stats", f"SELECT source, {r('avg(y)', 'mean')}, {r('stddev_pop(y)', 'std')} FROM logs GROUP BY ALL", LOGS_SQL)
def text_series_stats(spark, sf_dir):
    root = text_files(spark, sf_dir).first()["root"]
    series = tables.scan_text_series(spark, root, skiprows=3, y_scale=1000.0)
    return rounded(tables.series_stats(series), 6, "mean", "std")


@query("scan_manifest", "SELECT DISTINCT 'A/' || case_id || '_' || y || '.set' AS head_a, 'B/' || case_id || '_' || y || '.set' AS head_b, case_id || '-' || y AS name FROM voxel")
def scan_manifest(spark, sf_dir):
    """A pairs file with blank and comment lines, written from the cases and rows."""
    path = new_path(spark, "pairs")
    rows = voxel(spark, sf_dir).select("case_id", F.col("y").cast("string").alias("y")).distinct()
    line = F.concat(F.lit(" A/"), "case_id", F.lit("_"), "y", F.lit(".set | B/"), "case_id", F.lit("_"), "y", F.lit(".set|  "), "case_id", F.lit("-"), "y")
    text = F.explode(F.array(line, F.lit(""), F.concat(F.lit("# after row "), "y")))
    rows.select(text.alias("value")).write.text(path)
    return tables.scan_manifest(spark, path)
