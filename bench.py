"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

``matching_<n>`` times whole matching runs (encoding, whitening, both-sided search, bias
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "group_difference", "ttest_welch", "ks_stat", "u_stat", "chi2_stat", "multitest_holm", "ab_resume", "aa_split_stratified", "aa_experiments", "cuped_ols",
    "agg_multi", "corr_pearson", "corr_spearman", "quantiles", "groupby_agg", "value_counts", "merge_inner", "ffill", "outliers_filter", "category_agg", "one_hot", "knn_l2", "match_att_atc_ate", "event_moments",
]
MATCHING = (32_768, 65_536, 131_072)


def matching(spark: SparkSession, n: int) -> None:
    from tessera.frame import RoleFrame
    from tessera.plans.shells import Matching
    from tessera.roles import FeatureRole, TargetRole, TreatmentRole
    from tessera.sources import synthetic

    df = synthetic.experiment(spark, n, nans=False, seed=1)
    roles = {TreatmentRole(): ["treat"], TargetRole(): ["post_spends"], FeatureRole(): ["pre_spends", "age", "gender", "industry"]}
    Matching(quality_tests=()).execute(RoleFrame(df, roles, "user_id")).resume.collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tessera.plans import catalogue

    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    catalogue.QUERIES["group_sizes"](spark, sf_dir).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    for n in MATCHING:
        began = time.perf_counter()
        matching(spark, n)
        took[f"matching_{n}"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
