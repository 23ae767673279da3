import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stocklens import session
from stocklens.operators import allocation, changes, joins, scope, topk
from stocklens.operators.allocation import allocate
from stocklens.plans import derived, registry
from stocklens.schemas import TABLES
from stocklens.sources.adapters import Tables

START = datetime(2024, 1, 1)
CART = "cart_item_id string, user_id long, share_token string, inventory_id long, report_id string, product_name string, category string, unit_price decimal(12,2), quantity int, created_at timestamp"
INVENTORY = "id long, report_id string, product_name string, category string, price decimal(12,2), quantity int"


def serve_one_by_one(claims, stock):
    """Brute force: claims in order, each all or nothing."""
    left, out = dict(stock), {}
    for claim, lines in claims:
        out[claim] = all(left.get(item, 0) >= units for item, units in lines.items())
        if out[claim]:
            for item, units in lines.items():
                left[item] -= units
    return out, left


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_allocation_equals_serving_one_by_one(spark, seed, hot):
    rng = random.Random(seed)
    items = [f"i{n}" for n in range(12)]
    stock = {item: rng.randint(0, 60) for item in items[:-1]}
    claims = []
    for number in range(300):
        picked = set(rng.sample(items, rng.randint(1, 4)))
        if hot and rng.random() < 0.5:
            picked.add("i0")
        claims.append((f"c{number:03d}", {item: rng.randint(1, 9) for item in picked}))
    expected, _ = serve_one_by_one(claims, stock)
    rows = [
        (claim, START + timedelta(minutes=n // 3), item, units)
        for n, (claim, lines) in enumerate(claims) for item, units in lines.items()
    ]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "claim string, arrival timestamp, item string, units int")
    capacity = spark.createDataFrame(list(stock.items()), "item string, units int")
    for size in (0, 40, 200, 10_000):  # rounds to the end, rounds and groups, all in one task
        got = {r.claim: r.accepted for r in allocate(lines, capacity, chunks=5, group_lines=size).collect()}
        assert got == expected


def test_allocation_of_nothing(spark):
    lines = spark.createDataFrame([], "claim string, arrival timestamp, item string, units int")
    assert allocate(lines, spark.createDataFrame([("a", 1)], "item string, units int")).count() == 0


def test_checkout_conserves_units(spark):
    rng = random.Random(7)
    inventory = [(i, f"R{i % 2}", f"p{i}", "c", 10 + i, rng.randint(0, 20)) for i in range(10)]
    cart, n = [], 0
    for user in range(60):
        report = user % 2
        for item in rng.sample([i for i in range(10) if i % 2 == report], rng.randint(1, 3)):
            n += 1
            cart.append((f"l{n}", user, f"t{report}", item, f"R{report}", f"p{item}", "c", 9, rng.randint(1, 6), START + timedelta(minutes=user)))
    cart.append(("gone", 99, "t0", 77, "R0", "old", "c", 1, 1, START))
    before = spark.createDataFrame(inventory, INVENTORY.replace("decimal(12,2)", "int")).withColumn("price", F.col("price").cast("decimal(12,2)"))
    lines = spark.createDataFrame(cart, CART.replace("decimal(12,2)", "int")).withColumn("unit_price", F.col("unit_price").cast("decimal(12,2)"))
    result = changes.checkout(lines, before)
    after = {r.id: r.quantity for r in result["inventory"].collect()}
    assert min(after.values()) >= 0
    sold = {r.inventory_id: r.n for r in result["order_items"].groupBy("inventory_id").agg(F.sum("quantity").alias("n")).collect()}
    assert {row[0]: row[5] - sold.get(row[0], 0) for row in inventory} == after
    claims = {}
    for line in cart:
        claims.setdefault((line[9], line[1]), {})[line[3]] = line[8]
    expected, _ = serve_one_by_one(sorted(claims.items()), {row[0]: row[5] for row in inventory})
    verdicts = {r.user_id: r.verdict for r in result["verdicts"].collect()}
    assert {user: ok for (_, user), ok in expected.items()} == {user: v == "confirmed" for user, v in verdicts.items()}
    assert verdicts[99] == "missing"
    orders = {r.user_id: r for r in result["orders"].collect()}
    assert set(orders) == {u for u, v in verdicts.items() if v == "confirmed"}
    assert all(r.status == "Confirmed" for r in orders.values())
    kept = {r.user_id for r in result["cart"].select("user_id").distinct().collect()}
    assert kept == {u for u, v in verdicts.items() if v != "confirmed"}
    # The order total uses inventory prices, the lines use cart prices.
    user = next(iter(orders))
    mine = [line for line in cart if line[1] == user]
    assert float(orders[user].total_amount) == sum((10 + line[3]) * line[8] for line in mine)
    line_total = result["order_items"].filter(F.col("order_id") == orders[user].order_id).agg(F.sum("line_total")).collect()[0][0]
    assert float(line_total) == sum(9 * line[8] for line in mine)


def test_cart_additions(spark):
    inventory = spark.createDataFrame(
        [(1, "R1", "Silk", "c", None, 10), (2, "R1", "Demo item", "c", None, 10), (3, "R2", "Tote", "c", None, 5)], INVENTORY
    )
    catalogs = spark.createDataFrame([("t1", "R1"), ("t2", "R2")], "share_token string, report_id string")
    cart = spark.createDataFrame([("l1", 7, "t1", 1, "R1", "Silk", "c", None, 4, START)], CART)
    adds = [
        ("a1", 7, "t1", 1, 3), ("a2", 7, "t1", 1, 4), ("a3", 7, "t1", 1, 3), ("a4", 7, "t2", 3, 1), ("a5", 7, "t1", 2, 1),
        ("a6", 7, "t1", 1, 0), ("a7", 7, "t9", 1, 1), ("a8", 7, "t1", 3, 1), ("b1", 8, "t2", 3, 9), ("b2", 8, "t1", 1, 2),
        ("b3", 8, "t2", 3, 2),
    ]
    rows = [(r, START + timedelta(minutes=n), u, t, i, q) for n, (r, u, t, i, q) in enumerate(adds)]
    requests = spark.createDataFrame(rows, "request_id string, requested_at timestamp, user_id long, share_token string, inventory_id long, quantity int")
    new_cart, verdicts = changes.merge_cart(cart, requests, inventory, catalogs)
    assert {r.request_id: r.verdict for r in verdicts.collect()} == {
        "a1": "added", "a2": "over stock", "a3": "added", "a4": "other catalog", "a5": "not available",
        "a6": "quantity too small", "a7": "invalid catalog", "a8": "not in catalog", "b1": "over stock", "b2": "added",
        "b3": "other catalog",
    }
    lines = {(r.user_id, r.inventory_id): r.quantity for r in new_cart.collect()}
    assert lines == {(7, 1): 10, (8, 1): 2}


def test_cart_quantity_changes(spark):
    inventory = spark.createDataFrame([(1, "R1", "Silk", "c", None, 10)], INVENTORY)
    cart = spark.createDataFrame(
        [(f"l{n}", 7, "t1", 1, "R1", "Silk", "c", None, 4, START) for n in range(5)], CART
    )
    rows = [("l0", "0"), ("l0", "5"), ("l1", "11"), ("l2", "3"), ("l2", "-1"), ("l3", "2.5")]
    wanted = spark.createDataFrame(
        [(line, 7, START + timedelta(minutes=n), "x", q) for n, (line, q) in enumerate(rows)],
        "cart_item_id string, user_id long, changed_at timestamp, change_id string, quantity string",
    )
    got = {r.cart_item_id: r.quantity for r in changes.update_cart_quantity(cart, wanted, inventory).collect()}
    assert got == {"l1": 4, "l2": 3, "l3": 4, "l4": 4}


def test_deletes_by_owner_and_cleared_carts(spark):
    cart = spark.createDataFrame([("l1", 1), ("l2", 1), ("l3", 2)], "cart_item_id string, user_id long")
    ids = spark.createDataFrame([("l1", 1), ("l3", 1)], "cart_item_id string, user_id long")
    assert {r.cart_item_id for r in changes.apply_deletes(cart, ids, "cart_item_id", "user_id").collect()} == {"l2", "l3"}
    assert [r.cart_item_id for r in changes.clear_carts(cart, ids).collect()] == ["l3"]


def test_review_decisions(spark):
    requests = spark.createDataFrame(
        [(n, "e", "u", s, None, None) for n, s in enumerate(["pending", "rejected", "pending", "pending", "approved"])],
        "id long, email string, username string, status string, reviewed_by long, reviewed_at timestamp",
    )
    codes = spark.createDataFrame(
        [(1, 2, "e", "OLD", "active", None, None)],
        "id long, request_id long, email string, code string, status string, expires_at string, used_at timestamp",
    )
    made = [(0, "approve"), (1, "approve"), (2, "approve"), (2, "reject"), (3, "reject"), (3, "approve"), (0, "approve")]
    decisions = spark.createDataFrame(
        [(n, r, START + timedelta(hours=n), d, 50 + n, f"N{n}", None) for n, (r, d) in enumerate(made)],
        "decision_id long, request_id long, decided_at timestamp, decision string, reviewer_id long, code string, code_expires_at string",
    )
    out = changes.apply_review_decisions(requests, codes, decisions)
    assert {r.id: r.status for r in out["requests"].collect()} == {
        0: "approved", 1: "rejected", 2: "rejected", 3: "rejected", 4: "approved",
    }
    assert {r.code: r.status for r in out["codes"].collect()} == {"OLD": "inactive", "N0": "inactive", "N2": "inactive", "N6": "active"}
    assert out["notifications"].count() == 5


@pytest.mark.parametrize("chains,length,size,most", [(1, 200, 100_000, 0), (6, 200, 500, 1), (5, 33, 70, 1), (1, 12, 0, 7)])
def test_chains_of_claims(spark, monkeypatch, chains, length, size, most):
    """Each claim shares one scarce item with the next: every other one is accepted, whole chains at a time."""
    rows = [(f"c{k}-{n:03d}", START + timedelta(minutes=n), f"i{k}-{n + j:03d}", 1) for k in range(chains) for n in range(length) for j in (0, 1)]
    rows += [(f"c{k}-{n:03d}", START + timedelta(minutes=n), "plenty", 2) for k in range(chains) for n in range(length)]
    lines = spark.createDataFrame(rows, "claim string, arrival timestamp, item string, units int")
    capacity = spark.createDataFrame([(f"i{k}-{n:03d}", 1) for k in range(chains) for n in range(length + 1)] + [("plenty", 10**6)], "item string, units int")
    rounds = []
    judged = allocation._judged
    monkeypatch.setattr(allocation, "_judged", lambda df: rounds.append(1) or judged(df))
    verdicts = allocate(lines, capacity, group_lines=size)
    assert verdicts.columns == ["claim", "accepted"]
    got = {r.claim: r.accepted for r in verdicts.collect()}
    assert got == {claim: int(claim[-3:]) % 2 == 0 for claim in got} and len(got) == chains * length
    assert len(rounds) <= most


def test_rounds_that_settle_much_need_no_labels(spark, monkeypatch):
    monkeypatch.setattr(allocation, "_components", None)
    rows = [(f"c{n:03d}", n, f"i{k}", 50 if n % 4 else 3) for n in range(200) for k in sorted({n % 7, n % 11})]
    claims = {claim: {item: units for c, _, item, units in rows if c == claim} for claim, *_ in rows}
    stock = {f"i{k}": 20 + k for k in range(11)}
    lines = spark.createDataFrame(rows, "claim string, arrival int, item string, units int")
    got = {r.claim: r.accepted for r in allocate(lines, spark.createDataFrame(list(stock.items()), "item string, units int"), group_lines=20).collect()}
    assert got == serve_one_by_one(list(claims.items()), stock)[0]


def test_only_passing_cart_additions_meet_the_carts(spark, monkeypatch):
    kept, keep = {}, session.WorkTables.keep
    monkeypatch.setattr(session.WorkTables, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    cart = spark.createDataFrame([], CART)
    stock = spark.createDataFrame([(1, "R1", "p", "c", None, 5)], INVENTORY)
    adds = spark.createDataFrame([(f"r{n}", START, n, "t" if n else "gone", 1, n) for n in range(9)], "request_id string, requested_at timestamp, user_id long, share_token string, inventory_id long, quantity int")
    _, verdicts = changes.merge_cart(cart, adds, stock, spark.createDataFrame([("t", "R1")], "share_token string, report_id string"))
    want = ["invalid catalog"] + ["added"] * 5 + ["over stock"] * 3
    assert [r.verdict for r in verdicts.orderBy("request_id").collect()] == want
    assert kept["judged"].count() == 5


def test_cart_quantities_join_the_stock_once_a_line(spark, sf_dir):
    t = Tables(spark, sf_dir)
    changed = t.sql(derived.CART_CHANGES)
    same = t.sql(derived.SPARK_CART_CHANGES)
    assert changed.exceptAll(same).isEmpty() and same.exceptAll(changed).isEmpty()
    plan = registry.queries()["update_cart_quantity"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Generate inline") == 1 and "Union" not in plan


def test_components(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: f"file://{tmp_path}")
    rng = random.Random(3)
    rows = [(f"c{n:02d}", f"i{k}", n % 4) for n in range(60) for k in {rng.randint(0, 60), n // 2, "hot" if n % 15 == 0 else n // 2}]
    lines = spark.createDataFrame(rows, "claim string, item string, chunk int")
    got = {r.claim: r.label for r in allocation._components(lines, session.WorkTables(spark, "work"), "labels").select("claim", "label").distinct().collect()}
    label = {claim: claim for claim, _, _ in rows}
    while True:
        lowest = {}
        for claim, item, _ in rows:
            lowest[item] = min(lowest.get(item, "z"), label[claim])
        lower = {claim: min(lowest[i] for c, i, _ in rows if c == claim) for claim in label}
        if lower == label:
            break
        label = lower
    assert got == label


def test_no_verdict_without_units(spark):
    lines = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "x", 1)], "claim string, arrival int, item string, units int")
    with pytest.raises(ValueError, match="units"):
        allocate(lines, spark.createDataFrame([("x", 2)], "item string, units int"), group_lines=0)


def test_work_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: f"file://{tmp_path}")
    lines = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "x", 1), ("c", 3, "x", 1)], "claim string, arrival int, item string, units int")
    assert allocate(lines, spark.createDataFrame([("x", 2)], "item string, units int"), group_lines=0).filter("accepted").count() == 2
    left = sorted(p.name for p in next(tmp_path.iterdir()).iterdir())
    assert left[-1] == "verdicts" and len(left) == 2 and left[0].startswith("open-")


def test_checkout_can_be_written_back(spark):
    """Orders and items of a checkout feed the readers of the stored tables."""
    cart = spark.createDataFrame(
        [("1", 7, "t", 1, "R", "Silk", "c", None, 2, START), ("2", 7, "t", 2, "R", "Tote", "c", None, 1, START), ("3", 8, "t", 1, "R", "Silk", "c", None, 9, START)], CART
    ).withColumn("unit_price", F.lit(3).cast("decimal(12,2)")).withColumn("cart_item_id", F.col("cart_item_id").cast("bigint"))
    stock = spark.createDataFrame([(1, "R", "Silk", "c", None, 3), (2, "R", "Tote", "c", None, 3)], INVENTORY).withColumn("price", F.lit(3).cast("decimal(12,2)"))
    users = spark.createDataFrame([(7, "ann"), (8, "bob")], "user_id long, username string")
    result, again = (changes.checkout(cart, stock, users) for _ in range(2))
    for name in ("orders", "order_items"):
        assert [(f.name, f.dataType) for f in result[name].schema.fields] == [(f.name, f.dataType) for f in TABLES[name].fields]
    assert sorted(map(tuple, result["order_items"].collect())) == sorted(map(tuple, again["order_items"].collect()))
    views = joins.order_views(result["orders"], result["order_items"]).orderBy("position").collect()
    assert {v["item"].product_name for v in views} == {"Silk", "Tote"} and [v.position for v in views] == [1, 2]
    assert joins.order_lines(result["order_items"], result["orders"]).count() == 2
    assert [r.username for r in scope.visible_orders(result["orders"], "user", 0, "ann").collect()] == ["ann"]
    assert [(r.actor_username, r.action) for r in result["activity"].collect()] == [("ann", "Checkout completed")]


def test_merged_cart_lines_can_be_changed(spark):
    stock = spark.createDataFrame([(1, "R1", "Silk", "c", None, 10)], INVENTORY)
    empty = spark.createDataFrame([], CART.replace("cart_item_id string", "cart_item_id long"))
    adds = spark.createDataFrame([("a", START, 7, "t1", 1, 3)], "request_id string, requested_at timestamp, user_id long, share_token string, inventory_id long, quantity int")
    catalogs = spark.createDataFrame([("t1", "R1")], "share_token string, report_id string")
    cart, _ = changes.merge_cart(empty, adds, stock, catalogs)
    line = cart.collect()[0]
    assert line.cart_item_id is not None and line.created_at == START
    wanted = spark.createDataFrame([(line.cart_item_id, 7, START, "x", "5")], "cart_item_id long, user_id long, changed_at timestamp, change_id string, quantity string")
    assert [r.quantity for r in changes.update_cart_quantity(cart, wanted, stock).collect()] == [5]


def test_first_sale_of_tied_items_follows_their_numbers(spark):
    """Items 9 and 10 of one order: as numbers, 9 comes first."""
    orders = spark.createDataFrame([(1, "R1", START)], "order_id long, report_id string, created_at timestamp")
    items = spark.createDataFrame([(10, 1, "Ten", "c", 2, 1.0), (9, 1, "Nine", "c", 2, 1.0)], "order_item_id long, order_id long, product_name string, category string, quantity int, line_total double")
    none = spark.createDataFrame([], "sale_id long, product_id long, quantity int, sale_date date, total_amount double")
    products = spark.createDataFrame([], "product_id long, name string, category string")
    sales = joins.all_sales(none, products, items, orders)
    assert dict(sales.dtypes)["line_id"] == "bigint"
    empty = spark.createDataFrame([], TABLES["inventory_data"])
    assert [r.product_name for r in topk.fast_movers(topk.product_facts(empty, sales)).orderBy("position").collect()] == ["Nine", "Ten"]


def test_repaired_pointers_are_written_back(spark):
    catalogs = spark.createDataFrame([(1, "gone"), (2, "R2")], "share_id long, source_report_id string")
    resolved = spark.createDataFrame([(1, "R9", True), (2, "R2", False)], "share_id long, resolved_report_id string, is_repaired boolean")
    assert {tuple(r) for r in changes.apply_repaired_pointers(catalogs, resolved).collect()} == {(1, "R9"), (2, "R2")}
