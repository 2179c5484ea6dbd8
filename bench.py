"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_table", "enriched_table", "p12_outlier_flag", "f4_dashboard_filter", "a1_statistics",
    "a5_market_concentration", "a7_company_efficiency", "a9_p17_positioning", "a13_benchmark_all",
    "a14_state_table", "a18_completeness", "a19_duplicates", "a21_geographic_consistency",
    "t7_top_companies_per_substance", "w3_lorenz", "d1_t10_monthly", "d2_d4_d5_trend",
    "st2_dagostino", "st3_st7_anova", "st4_kruskal_wallis", "st5_correlation_matrix",
    "a35_j3_category_boxes", "a36_heat_cells", "g2_dispersion", "g3_hull_density",
    "g8_a30_hotspot_table", "g6_moran", "g9_a30_accessibility_table", "g1_j6_spatial_dbscan",
    "m7_isolation_forest", "g8_hotspots_of_operations",
)


def main() -> None:
    from garimpo.plans import REGISTRY
    from tests.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    # start the executors, the Python workers and the file cache before the clock runs, by queries
    # that are not timed
    for name in ("a24_region_chart", "m8_r3_anomaly_summary"):
        REGISTRY[name].run(spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
