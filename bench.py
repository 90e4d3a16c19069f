"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from caseweave.operators import resample
from caseweave.plans import heterogeneity
from caseweave.session import local_session, scratch
from caseweave.workload import queries as registered

REPLICATES = 10_000
PASSES = int(os.environ.get("BENCH_PASSES", "3"))
HEADLINE = [
    "gini_district", "gini_unit", "gini_per_district", "lorenz_district", "lorenz_unit", "unit_zero_padding",
    "pareto_units_falciparum", "api_monthly", "api_age_sex", "incidence_month_sex", "api_age_coarse",
    "weekly_vivax_share", "district_profile", "unit_type_mix", "series_replace_slice", "cleaned_line_list",
]


def bootstrap_district(spark, folder):
    """The full published workload at district level: 10,000 replicates of every stratum."""
    replicates = heterogeneity.bootstrap_districts(
        registered._district_rates(spark, folder), replicates=REPLICATES, origin=False
    )
    return resample.percentile_interval(replicates, heterogeneity.STRATA, "g")


def bootstrap_unit(spark, folder):
    """The full published workload at unit level."""
    padded = heterogeneity.padded_unit_rates(registered._unit_rates(spark, folder))
    replicates = heterogeneity.bootstrap_units(padded, replicates=REPLICATES, origin=False)
    return resample.percentile_interval(replicates, heterogeneity.STRATA, "g")


def totals(spark) -> dict[str, float]:
    """Work of the session so far: MB read from files, MB shuffled, tasks."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    listed = [executors.apply(i) for i in range(executors.size())]
    return {
        "input_mb": sum(e.totalInputBytes() for e in listed) / 1e6,
        "shuffle_mb": sum(e.totalShuffleWrite() for e in listed) / 1e6,
        "tasks": sum(e.totalTasks() for e in listed),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # A run on one machine: the folder that all executors share is a local one.
        spark.sparkContext.setCheckpointDir(os.path.join(os.environ.get("TMPDIR", "/tmp"), "caseweave-bench"))
    runs = {name: registered.queries()[name] for name in HEADLINE}
    runs["bootstrap_district_10000"] = bootstrap_district
    runs["bootstrap_unit_10000"] = bootstrap_unit
    # The first query of a session pays for starting it.
    runs[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds, work = {}, {}
    for name, run in runs.items():
        times = []
        for _ in range(PASSES):
            before, start = totals(spark), time.perf_counter()
            with scratch(spark):
                run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        after = totals(spark)
        work[name] = {key: round(after[key] - before[key], 2) for key in after}
        # The last pass runs on a warm JVM.
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({
        "metric": "total_warm_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "work_of_last_pass": work,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
