"""Times the headline queries on one machine and prints one JSON line: the median of three runs after
a warm-up, the MB shuffled and the stages of each."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from sensorium.plans import advanced  # noqa: F401  its queries are in the same dictionary
from sensorium.plans.queries import QUERIES
from sensorium.session import session

HEADLINE = ["device_stats", "device_grid", "room_level", "building_level", "lag_features", "moving_averages", "forecast_targets", "regression_metrics", "combined_adjacency", "scaled_features"]
#: Timed too, but not part of the total, which stays comparable.
MORE = ["exact_quantiles", "targets_scaled_together"]


def shuffled(spark) -> int:
    """Bytes of shuffle written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took, mb, stages = {}, {}, {}
    tracker = spark.sparkContext.statusTracker()
    for name in HEADLINE + MORE:
        times = []
        for k in range(4):  # the first one warms up
            spark.sparkContext.setJobGroup(f"{name}{k}", name)
            start, before = time.time(), shuffled(spark)
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
            time.sleep(0.2)  # until the listener has the last task
            mb[name] = round((shuffled(spark) - before) / 1e6, 2)
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"{name}{k}")]
            stages[name] = sum(len(j.stageIds) for j in jobs if j)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took[k] for k in HEADLINE), 3), "unit": "sec", "queries": took, "shuffle_mb": mb, "stages": stages, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
