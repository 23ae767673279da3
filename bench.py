"""Headline queries, timed: prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stocklens.plans import registry  # noqa: E402
from stocklens.session import build_session  # noqa: E402

HEADLINE = [
    "business_analytics",
    "product_rollup",
    "merge_stock_and_sales",
    "fast_movers",
    "business_insights",
    "chart_series",
    "sales_trend",
    "category_value",
    "dashboard_metrics",
    "inventory_insights",
    "decision_analytics",
    "all_sales",
    "order_views",
    "report_listing",
    "catalog_page",
    "catalog_by_popularity",
    "cart_with_stock",
    "validate_cart",
    "cart_summary",
    "request_queue",
    "resolve_catalog_report",
    "recently_viewed",
    "ingest_report",
    "merge_product_master",
    "apply_inventory_edits",
    "apply_category_repairs",
    "apply_order_status",
    "merge_cart",
    "checkout",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    functions = registry.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        functions[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
