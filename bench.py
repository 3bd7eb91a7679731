"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from moodmill import plans
from moodmill.session import local_session

HEADLINE = (
    "agg_01_opinion_features",
    "agg_01_phrase_features",
    "agg_05_lexicon_sums",
    "agg_10_polarity_summary",
    "txt_04_tokenize_social",
    "txt_15_clean_negated",
    "txt_21_bigrams",
    "txt_22_gapped_in_vocabulary",
    "txt_23_char_3grams",
    "agg_13_term_counts",
    "agg_14_bag_of_words",
    "join_14_agg_20_lexicon_overlap",
    "eval_05_score_by_dataset",
    "eval_08_stratified_folds",
    "sel_01_score_chi2",
    "sel_04_select_percentile",
    "ml_05_multinomial_nb",
    "ml_07_nearest_neighbours",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the JVM before timing
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
