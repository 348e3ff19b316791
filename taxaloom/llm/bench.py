"""Times the queries of this package and prints one JSON line: ``python -m taxaloom.llm.bench [query ...]``.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores. A query runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from taxaloom.llm import queries
from taxaloom.session import local_session


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in queries.queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main(sys.argv[1:])
