"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from parcelforge.plans import catalog
from parcelforge.session import session

HEADLINE = (
    "candidate_pairs_within", "match_ranked", "match_quality", "attribute_similarity", "best_match_harmonized", "conflict_rules", "conflict_counts", "validation_results", "confidence_scores",
    "adjudication_queue", "unified_records", "lineage_completeness", "lineage_edges", "merge_idempotent", "components", "proximity_nearest_ref", "knn_assets", "intersection_pairs", "version_diff",
    "conflict_clusters", "attribute_conflicts_multi", "audit_timeline", "vector_topk", "intent_route", "export_authoritative",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        # All columns of all rows are made; only the writing of them is left out.
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
