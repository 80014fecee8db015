"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from gradeloom.plans import catalog
from gradeloom.session import local_session

HEADLINE = [
    "cohort_gpa_rank", "students_by_major", "violin_rough", "grade_distribution", "student_home_line",
    "student_home_radar", "student_report_text", "class_value_added", "student_value_added_slope",
    "semester_gpa_residuals", "course_expected_gain", "course_line_residuals", "unpivot_scores",
    "stage_upsert", "prereq_edges", "new_students", "graph_degrees", "graph_valid_edges",
    "mastery_overlay", "mastery_bands", "bubble_counts", "degree_audit_missing", "degree_audit_scores",
    "training_set", "describe_training", "correlation_matrix", "zscore_features", "elastic_net_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
