"""Time the headline queries and print one JSON line. One untimed query warms the session up.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from checks.session import session  # noqa: E402

HEADLINES = [
    "standardize_dates",
    "standardize_casing",
    "casing_first_seen",
    "change_counts",
    "fill_missing",
    "duplicate_rows",
    "conflicting_rows",
    "cleaned_rows",
    "clean_summary",
    "duplicate_documents",
    "read_csv",
    "profile_lineitem",
    "profile_documents",
    "profile_messy",
    "top_long_values",
    "correlations",
    "group_comparisons",
    "trend_by_year",
    "trend_text_dates",
    "outliers_of_lines",
    "outlier_examples",
    "analyze_all",
    "text_overlap",
    "gather_two",
    "gather_three",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINES
    known = queries()
    known[HEADLINES[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
