"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import time

from graphloom.plans.registry import QUERIES
from graphloom.session import local_session

HEADLINE = ["q_god_nodes", "q_degrees", "q_pair_weight", "q_cross_community", "q_resolve_bare", "q_resolve_selector", "q_first_writer", "q_idf_score", "q_seed_budget", "q_match_links", "q_modularity", "q_path_tree", "q_asof_enclosing", "q_bfs_levels", "q_cycles_2_3", "q_client_calls_and_routes"]


def main() -> None:
    sf_dir, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark, took = local_session(cores, 8, "8g"), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
