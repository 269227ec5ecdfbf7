"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median of 3 warm runs of each."""

import json
import os
import statistics
import time

from celltide.plans import catalog
from celltide.session import session

NAMES = ["coverage_cpm", "tile_counts", "frag_overlap_binned", "merge_regions", "cell_depth", "project_union", "subset_matrix", "entity_query", "matrix_row_set", "gtf_parse"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(4):
            start = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
