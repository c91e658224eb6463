"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from touchline.plans import catalog  # noqa: E402
from touchline.session import local_session  # noqa: E402
from touchline.sources.contests import contests  # noqa: E402

HEADLINE = [
    "a7_parameter_schedule", "w3_w7_team_form", "e1_elo_ratings", "features_full", "p4_row_rules", "p5_duplicate_matches",
    "a21_pair_statistics", "m5_match_prediction", "k2_fold_metrics", "k3_selection", "m9_frozen_scoring", "x1_entity_tags",
    "x3_intent_tags", "j13_as_of_lookup", "r2_latest_snapshot", "f13_f14_j11_statistics", "m1_logistic_grid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    start = time.time()
    rows = contests(spark, sf_dir).count()  # derived and written once, as a job of its own
    seconds["contests_table"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "contests": rows,
        "contests_per_sec": {n: round(rows / s) for n, s in seconds.items() if s > 0},
    }))


if __name__ == "__main__":
    main()
