"""Times the headline queries and prints one JSON line.

Every query is run once to warm up and then timed; the result is fully computed
(all columns) and thrown away.
"""

from __future__ import annotations

import importlib
import json
import os
import time

from skytables.session import local_session

#: One query per kind of work (fixed list).
HEADLINE = [
    "box_at_time", "get_box", "box_sso", "attach_ephem", "at_time_moving", "at_time_many", "at_time_named",
    "crossmatch_all", "crossmatch_nearest", "crossmatch_moving", "cone_search", "resolve_name", "boxes_sso",
    "ingest_act", "ingest_jpl_ephem", "insert_ephem", "update_source", "update_ephem", "delete_sso_cascade",
    "integrity_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = importlib.import_module("__spark_entry__").queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
