"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tabloom.plans.queries import all_queries
from tabloom.session import local_session

HEADLINES = (
    "constraint_summary_lineitem",
    "constraint_summary_credit",
    "constraint_summary_heloc",
    "repair_credit",
    "revision_report_credit",
    "column_similarity_credit",
    "auc_binary",
    "auc_lineitem",
    "dcr_rows_credit",
    "encode_rows_text",
    "parse_replies",
    "tstr_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tabloom-bench")
    known = all_queries()
    known["constraint_summary_lineitem"](spark, folder).collect()  # start the session's threads and caches
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        # The noop sink computes every row and column without moving them to the driver.
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
