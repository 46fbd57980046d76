"""Times the headline queries: one JSON line on stdout.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the cores. Each query runs once to warm up and is then timed; its rows are
computed in full by a `noop` write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestack.session import build_session  # noqa: E402
from workload import load_all  # noqa: E402

HEADLINES = (
    "dataset_column_stats",
    "numeric_summary",
    "profile_all_columns",
    "profile_sketch",
    "fk_orphans",
    "validate_spec",
    "sql_inner_join_agg",
    "clean_markup",
    "normalize_paragraphs",
    "find_items",
    "make_chunks",
    "document_job",
    "extract_chunks",
    "postings",
    "text_score",
    "nearest_neighbor",
    "vector_top_k",
    "content_dedup",
    "upsert_mappings",
    "latest_state",
    "chart_trend",
    "chart_hierarchy",
    "final_message",
    "extract_json",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        run(name)
        seconds[name] = run(name)
    result = {
        "metric": "headline queries, warm, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
