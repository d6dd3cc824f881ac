"""Wall time of the headline queries. Prints one JSON line.

Each query is run once to warm up and then three times; the median counts. The time covers
building the plan and computing every row (a ``noop`` write). ``ingest`` is the time to derive
and store the voxel table from the given tables. Fits, particle steps and stretching time their whole work.

``scaled`` repeats a few operators over recordings that are 10 times as long (and, with
``BENCH_SCALES=10,100``, 100 times): one run after a warm-up, in voxels per second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "temporal_mean",
    "temporal_variance",
    "rms_raw",
    "rms_fluct",
    "intermittency",
    "mean_squares",
    "tke",
    "dissipation",
    "turbulence_scales",
    "turbulent_flux",
    "total_flux",
    "conditional_velocity",
    "reynolds",
    "spatial_gradient",
    "gradient_means",
    "strain_rates",
    "motion_correlator",
    "median_filter",
    "regrid_linear",
    "regrid_batch",
    "regrid_triangles",
    "concentration_pdf",
    "region_report",
    "noise_report",
    "interleave_heads",
    "interleave_native",
    "incremental_stats",
    "sketch_report",
    "lateral_profile",
    "gaussian_fit",
    "particle_advect_steps",
    "particle_advect_8_steps",
    "ftle_field",
]


def scaled(spark, sf_dir: str, copies: int) -> dict:
    """Seconds and voxels per second of a few operators over a recording of ``copies`` times the frames."""
    from pyspark.sql import functions as F

    from eddyfield.model import read_voxel, write_voxel
    from eddyfield.operators import distribution, stats, stencil, transport
    from eddyfield.plans import fixture
    from eddyfield.session import new_path

    voxel = fixture.voxel(spark, sf_dir).drop("t_block")
    frames = voxel.agg(F.max("t")).first()[0] + 1
    path = new_path(spark, f"voxel_x{copies}")
    write_voxel(voxel.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("t", (F.col("t") + F.col("copy") * frames).cast("int")).drop("copy"), path)
    longer = read_voxel(spark, path)
    rows = longer.count()
    work = {
        "temporal_mean": lambda: stats.temporal_mean(longer, "c"),
        "turbulent_flux": lambda: transport.turbulent_flux(longer),
        "gradient_means": lambda: stencil.gradient_means(longer),
        "motion_correlator": lambda: stencil.motion_correlator(longer),
        "concentration_pdf": lambda: distribution.concentration_pdf(longer, ["case_id"], 0.02),
    }
    out = {"voxels": rows}
    for name, build in work.items():
        for _ in range(2):
            started = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
        out[name] = {"sec": round(taken, 3), "voxels_per_sec": round(rows / taken)}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from eddyfield.operators import fit, lagrange
    from eddyfield.plans import catalog, fixture
    from eddyfield.plans.motion_queries import STEPS, flow_of
    from eddyfield.plans.profile_queries import lateral_of
    from eddyfield.session import local_session

    spark = local_session(cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    # the registered queries keep their input for the queries after them; time the work itself
    def particles(session, folder, steps):
        return lagrange.particle_advect(flow_of(session, folder), fixture.axis(session, folder), steps, dt=1.5, blend=2.0)

    queries["particle_advect_steps"] = lambda session, folder: particles(session, folder, 1)
    queries["particle_advect_8_steps"] = lambda session, folder: particles(session, folder, 8)
    queries["ftle_field"] = lambda session, folder: lagrange.ftle_field(particles(session, folder, STEPS), dx=0.7, dy=0.6, duration=3.0)
    queries["gaussian_fit"] = lambda session, folder: fit.gaussian_fit(lateral_of(session, folder))

    started = time.perf_counter()
    voxels = fixture.voxel(spark, sf_dir).count()
    times = {"ingest": round(time.perf_counter() - started, 3)}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(times.values()), 3)
    longer = {f"x{k}": scaled(spark, sf_dir, int(k)) for k in os.environ.get("BENCH_SCALES", "10").split(",") if k}
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
                "voxels": voxels,
                "cores": int(cores),
                "spark": spark.version,
                "runs": runs,
                "scaled": longer,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
