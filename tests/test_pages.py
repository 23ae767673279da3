"""Page bundles over the adapted tables."""

import pytest

from stocklens.operators import joins, rollups, scope, topk
from stocklens.plans import analytics
from stocklens.plans.registry import AS_OF
from stocklens.sources import tables
from stocklens.sources.adapters import ADAPTERS, Tables


@pytest.fixture(scope="module")
def adapted(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return {name: getattr(t, name) for name in ADAPTERS}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_admin_dashboard(adapted):
    page = analytics.admin_dashboard(adapted, AS_OF)
    counts = {name: part.count() for name, part in page.items()}
    assert counts["users"] == 6 and counts["reports"] == 6 and counts["shared_catalogs"] == 5 and counts["recent_activity"] == 8
    assert counts["recent_rows"] == 8 and counts["low_stock"] == 5 and counts["latest_share"] == 1
    assert page["orders"].select("order_id").distinct().count() == 8
    assert rows(page["decision_fast_items"]) == rows(topk.quantity_leaders(adapted["inventory_data"]))


def test_manager_dashboard(adapted):
    page = analytics.manager_dashboard(adapted)
    assert page["business_fast_items"].count() == 10 and len(page.shared) == 3
    assert all(part.count() >= 0 for part in page.values())
    page.release()
    assert not any(table.is_cached for table in page.shared)


def test_user_dashboard(adapted):
    page = analytics.user_dashboard(adapted, 7, "Customer#000000007", AS_OF)
    own = scope.visible_orders(adapted["orders"], "user", 7, "Customer#000000007")
    assert {r.order_id for r in page["orders"].collect()} == {r.order_id for r in topk.recent(own, 8, id_col="order_id").collect()}
    assert rows(page["cart_summary"]) == rows(rollups.cart_summary(adapted["cart_items"]).filter("user_id = 7"))
    assert page["latest_share"].count() == 1 and page["products"].count() <= 8


def test_stored_catalog_page_prunes_when_planned(spark, adapted, tmp_path):
    path = str(tmp_path / "inventory")
    tables.append_inventory(adapted["inventory_data"], path)
    stored = tables.read_inventory(spark, path, with_bucket=True)
    names = ("shared_catalogs", "uploaded_reports")
    args = [AS_OF, *(adapted[name] for name in names)]
    page = analytics.catalog_page("tok8", *args, stored, adapted["order_items"])
    plain = analytics.catalog_page("tok8", *args, adapted["inventory_data"], adapted["order_items"])
    assert {r.id for r in page["products"].collect()} == {r.id for r in plain["products"].collect()} != set()
    for part in ("products", "metrics", "facets"):
        plan = page[part]._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "report_bucket" in line]
        assert 1 <= len(scans) <= 2 and plan.count("Scan parquet") <= 12 and plan.count("Exchange hashpartitioning") <= 8
        assert all("(report_bucket" in line.split("PartitionFilters")[1] and "EqualTo(report_id" in line for line in scans)
    assert analytics.catalog_page("no such token", *args, stored, adapted["order_items"])["products"].count() == 0
    counts = joins.rows_per_report(adapted["inventory_data"])
    kept = analytics.catalog_page("tok8", *args, stored, adapted["order_items"], row_counts=counts)
    assert rows(kept["metrics"]) == rows(plain["metrics"]) and rows(kept["facets"]) == rows(plain["facets"])
