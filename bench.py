"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from dialogue_factors.plans.catalog import QUERIES
from dialogue_factors.session import build_session

HEADLINE = (
    "clean_lines", "episodes", "dialogue_files", "flatten_utterances", "attach_labels", "speaker_split_exact",
    "class_distribution", "json_roundtrip", "seeded_shuffle", "confusion_matrix", "loss_terms", "epoch_history",
    "linear_heads", "hashed_tfidf", "encode_tokens", "covariance", "pca_reduce", "nearest_centroid",
    "kmeans_best_of_n", "k_sweep", "best_k", "silhouette_exact", "silhouette_squared", "factor_split",
    "leakage_probe", "labelled_dialogue",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
