import random
from datetime import datetime, timedelta

import pytest

from test_plan_shapes import plain_plans, plan_of  # noqa: F401
from touchcredit.operators import Measure, by_window, by_windows, campaign_metrics, campaign_windows, in_windows, level_metrics
from touchcredit.functions import at
from touchcredit.plans import WindowCampaign, WindowCampaigns, window_campaign, window_campaigns
from touchcredit.registry.adapters import Given
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ORDERS = "order_id long, customer_email string, created_date timestamp_ntz, lob_type string, recent_open string"
TABLE = "campaign string, sent_date timestamp_ntz, pos long"
T0 = datetime(2019, 7, 1)


def made(spark, seed, hot=0.4):
    """Random orders, one customer with many of them, and overlapping windows; exact bounds among the times."""
    rng = random.Random(seed)
    table = [(f"c{i}", T0 + timedelta(hours=rng.randrange(0, 1500)), i) for i in range(6)] + [("unsent", None, 9)]
    lists = sorted({(c, rng.choice(["hot", "a", "b", None]), k) for c, _, _ in table for k in range(4)}, key=str)
    orders = []
    for i in range(300):
        t = T0 + timedelta(hours=rng.randrange(-100, 2500))
        if rng.random() < 0.2:
            t = rng.choice(table[:-1])[1] + rng.choice([timedelta(0), timedelta(days=31), timedelta(days=31, microseconds=1)])
        who = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        orders.append((i, who, t if rng.random() < 0.97 else None, rng.choice(["L1", "L2", None]), "old"))
    scopes = [("c0", "L1"), ("c1", "L2"), ("c1", "L1"), ("c2", None)]
    return (
        orders, table, [(c, r) for c, r, _ in lists], scopes,
        spark.createDataFrame(orders, ORDERS),
        spark.createDataFrame(table, TABLE),
        spark.createDataFrame([(c, r, None, None) for c, r, _ in lists], "campaign string, recipient string, sent_at timestamp_ntz, clicked boolean"),
        spark.createDataFrame(scopes, "campaign string, value string"),
    )


def brute(orders, table, scopes, days, listed=None):
    out = []
    for campaign, start, _ in table:
        values = {v for c, v in scopes if c == campaign and v is not None}
        for i, who, t, line, _ in orders:
            if start is None or t is None or not start <= t <= start + timedelta(days=days) or (values and line not in values):
                continue
            times = 1 if listed is None else sum((campaign, who) == x for x in listed if who is not None)
            out += [(i, campaign, times)] if times else []
    return sorted(out)


@pytest.mark.parametrize(("seed", "days", "bins"), [(1, 31, 31), (2, 31, 7), (3, 2, 31), (4, 0, 1)])
def test_windows_equal_brute_force(spark, seed, days, bins):
    orders, table, listed, scopes, o, t, touches, s = made(spark, seed)
    windows = campaign_windows(t, days, s)
    got = by_windows(o, touches, windows, "lob_type", bins, keep_fanout=True)
    assert sorted((r.order_id, r.recent_open, r.copies) for r in got.collect()) == brute(orders, table, scopes, days, listed)
    once = by_windows(o, touches, windows, "lob_type", bins)
    assert sorted((r.order_id, r.recent_open) for r in once.collect()) == [x[:2] for x in brute(orders, table, scopes, days, listed)]
    everyone = in_windows(o.drop("recent_open"), windows, "lob_type", bins, places=3)
    assert sorted((r.order_id, r.recent_open, 1) for r in everyone.collect()) == brute(orders, table, scopes, days)


def test_days_of_a_campaign_and_no_scopes(spark):
    orders, table, listed, _, o, t, touches, _ = made(spark, 6)
    windows = campaign_windows(t.withColumn("days", F.when(F.col("campaign") == "c1", 3)), 10)
    got = sorted((r.order_id, r.recent_open) for r in by_windows(o, touches, windows).collect())
    want = [x[:2] for x in brute(orders, [r for r in table if r[0] != "c1"], [], 10, listed) + brute(orders, [r for r in table if r[0] == "c1"], [], 3, listed)]
    assert got == sorted(want)


def test_one_campaign_is_by_window(spark):
    *_, o, t, touches, _ = made(spark, 7)
    (campaign, start, _), *_ = t.orderBy("pos").collect()
    one = by_window(o.drop("recent_open"), touches.where(F.col("campaign") == campaign), at(str(start)))
    many = by_windows(o, touches, campaign_windows(t)).where(F.col("recent_open") == campaign)
    assert sorted(r.order_id for r in one.collect()) == sorted(r.order_id for r in many.collect())


def test_no_windows_no_orders(spark):
    *_, o, t, touches, s = made(spark, 8)
    assert by_windows(o, touches, campaign_windows(t.limit(0))).count() == 0
    assert in_windows(o.limit(0), campaign_windows(t, scopes=s), "lob_type").count() == 0


def test_plan_has_no_nested_loop(spark, plain_plans):  # noqa: F811
    g = Given(spark, SF)
    windows = campaign_windows(g.ship_campaigns, scopes=g.ship_scopes)
    for df in (by_windows(g.sales, g.touches_ship, windows, "lob_type"), in_windows(g.sales, windows, "lob_type")):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert not any("hashpartitioning(campaign#" in line and "lineitem" in line for line in plan.splitlines())
    assert "hashpartitioning(customer_email" in plan_of(by_windows(g.sales, g.touches_ship, windows, "lob_type"))


def test_report_of_many_equals_reports_of_each(spark):
    g = Given(spark, SF)
    table = g.ship_campaigns
    known = g.known("1997-01-01")
    both = window_campaigns(g.sales, known, g.touches_ship, table, None, WindowCampaigns())
    for row in table.collect():
        spec = WindowCampaign(str(row.sent_date), F.lit(True), row.campaign)
        one = window_campaign(g.sales, g.known(str(row.sent_date)), g.touches_ship.where(F.col("campaign") == row.campaign), spec)
        mine = both["Metrics"].where(F.col("recent_open") == row.campaign).drop("recent_open").first()
        want = one["Metrics"].first()
        assert tuple(mine) == pytest.approx(tuple(want)) if want[0] else mine[0] is None
        people = both["New Customers"].where(F.col("Campaign Source") == row.campaign)
        assert sorted(map(tuple, people.collect())) == sorted(map(tuple, one["New Customers"].collect()))


CELLS = "recent_open string, combined_email string, customer_email string, billing_amount decimal(18,4), orders long"


def test_levels_equal_metrics_of_each(spark):
    rng = random.Random(3)
    groups = {"x": "g", "y": "g", "z": None}
    rows = [(c := rng.choice("xyz"), groups[c], rng.choice(["a", "b", "c", None]), rng.randrange(99), rng.randrange(1, 4)) for _ in range(80)]
    cells = spark.createDataFrame(rows, "recent_open string, combined_email string, customer_email string, billing_amount int, orders long")
    cells = cells.withColumn("billing_amount", F.col("billing_amount").cast("decimal(18,4)"))
    big = F.col("billing_amount") > 50
    measures = [Measure("n", "orders"), Measure("big", "orders", big), Measure("sum", "revenue", big), Measure("who", "customers"), Measure("rich", "customers", big)]
    got = level_metrics(cells, measures, {"campaign": "recent_open", "combined": "combined_email", "total": None}, "orders")
    rows = {(r.level, r.key): tuple(r)[2:] for r in got.collect()}
    want = {}
    for level, key in (("campaign", "recent_open"), ("combined", "combined_email"), ("total", None)):
        for r in campaign_metrics(cells, measures, key=key, orders_col="orders").collect():
            if key is None or r[key] is not None:
                want[level, None if key is None else r[key]] = tuple(r)[0 if key is None else 1 :]
    assert rows == want and len(rows) == 5


def test_levels_take_one_lookup(spark, plain_plans):  # noqa: F811
    from touchcredit.registry.queries import research_report

    g = Given(spark, SF)
    plan = plan_of(research_report(g)["Metrics by Level"])
    assert "Expand" not in plan and "NestedLoop" not in plan
    alone = plan_of(research_report(Given(spark, SF))["Metrics"])
    assert plan.count("FileScan") == alone.count("FileScan")
