"""Seconds per headline query, as one JSON line.

Every query reads its whole tables below $BENCH_SF_DIR and is executed to its last row; the
rows go nowhere. Runs on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from checks.queries import QUERIES
from echolane.session import build_session

HEADLINE = [
    "vocab_full",
    "sentence_tokens",
    "context_profiles",
    "encoded_sequences",
    "comment_groups",
    "country_comment_counts",
    "sequence_ids",
    "keyword_search",
    "label_impressions",
    "label_stats",
    "daily_log_stats",
    "enriched_songs",
    "enriched_by_kind",
    "frequent_users",
    "ranking_dataset",
    "negatives",
    "nearest_vectors",
    "recommend_topn",
    "auc",
    "ngram_model",
    "next_word_top3",
    "sentence_scores",
    "generate_sentences",
    "cross_entropy",
    "search_training",
    "recommend_blocks",
    "bpr_factors",
    "bpr_evaluation",
    "bpr_recommendations",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
