"""Plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from touchcredit.functions import at
from touchcredit.operators import CleaningRules, by_window, campaign_metrics, clean_orders, flag_new, latest_touch
from touchcredit.operators import known_customers, order_cells
from touchcredit.operators.attribution import BUCKETS, _crowded
from touchcredit.plans.common import Company, line_bundle
from touchcredit.registry.adapters import Given
from touchcredit.registry.queries import QUERIES
from toy import raw_order, raw_orders

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def plain_plans(spark):
    """Plans as first chosen: no runtime changes, and no broadcast, as if every side were large."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    names["spark.sql.maxMetadataStringLength"] = "10000"  # plans print pushed filters whole
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "raw")
    raw_orders(spark, [raw_order(1), raw_order(2)]).write.parquet(path)
    return spark.read.parquet(path)


def test_cleaning_is_one_scan_with_pushed_filters(stored, plain_plans):
    clean, _ = clean_orders(stored, CleaningRules.for_company("Acme"))
    plan = plan_of(clean)
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    assert "territory" in pushed.lower() and "IsNull(territory)" in pushed


def test_window_bounds_reach_the_scan(spark, stored, plain_plans):
    touches = Given(spark, SF).touches_lists
    df = by_window(stored, touches, at("7/1/2019"), scope=F.col("lob_type").isin("Regulatory"))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan_of(df))
    assert any("GreaterThanOrEqual(created_date" in p and "LessThanOrEqual(created_date" in p for p in pushed)


def test_as_of_lookup_shuffles_orders_and_touches_once(spark, plain_plans):
    g = Given(spark, SF)
    lines = plan_of(latest_touch(g.plain_orders, g.touches_ship, g.ship_eligibility)).splitlines()
    reused = [line for line in lines if "ReusedExchange" in line]
    assert any("__slice" in line and "REPARTITION_BY_COL" in line for line in reused)
    scans = [re.search(r"FileScan parquet \[(\w)_", line) for line in lines]
    tables = [m.group(1) for m in scans if m]
    # orders: once whole, once for their slices, and once in the adapter that makes touches from shipments
    assert tables.count("l") == 1 and tables.count("o") == 3
    # no order is placed by its order type alone, and only the index's own rows by their campaign
    assert not any("hashpartitioning(order_type#" in line for line in lines)
    assert sum("hashpartitioning(campaign#" in line for line in lines) == 2


def test_new_customers_take_two_scans_of_the_orders(spark, plain_plans):
    g = Given(spark, SF)
    labelled = g.sales.withColumn("recent_open", F.lit("c"))
    plan = plan_of(flag_new(labelled, g.known("1997-01-01"), cutoff=at("1997-01-01")))
    assert len(re.findall(r"FileScan parquet \[o_orderkey", plan)) == 2


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in ("research_metrics", "flash_metrics", "promo_metrics", "regional_metrics", "clean_report"):
            QUERIES[name](spark, SF)
        jobs = tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # a Parquet schema may be read by a job of one task; nothing is written or computed
    assert all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)


def test_metrics_on_cells_shuffle_no_whole_orders(spark, plain_plans):
    g = Given(spark, SF)
    sales = g.sales
    labelled = sales.withColumn("recent_open", F.col("order_type")).withColumn("confirmed", F.lit("confirmed"))
    cells = order_cells(labelled, ["recent_open", "customer_email", "email_lob", "lob_type", "lob", "confirmed"])
    flagged = flag_new(cells, known_customers(sales, sales.limit(0)), cutoff=at("1996-01-01"))
    plan = plan_of(campaign_metrics(flagged, line_bundle(Company()), orders_col="orders"))
    assert "Expand" not in plan
    scans = re.findall(r"FileScan parquet \[(.*?)\]", plan)
    assert all("user_name" not in s and "institution" not in s for s in scans)
    # rows leave the join on the email already placed for the count of distinct customers
    assert not re.search(r"Exchange hashpartitioning\(recent_open#\d+, customer_email", plan.split("partial_sum")[0])


def test_as_of_lookup_sorts_no_columns_of_orders_with_the_touches(spark, plain_plans):
    g = Given(spark, SF)
    plan = plan_of(latest_touch(g.plain_orders, g.touches_ship, g.ship_eligibility))
    assert plan.count("Window [") == 2 and not re.search(r"null AS (order_id|o_orderkey)#", plan)


def test_cleaning_works_out_a_derived_amount_once(spark, plain_plans):
    plan = plan_of(Given(spark, SF).cleaned)
    assert len(re.findall(r"o_totalprice#\d+ as decimal\(18,4\)", plan)) == 1


def test_customers_are_counted_by_marks_and_not_by_one_sum_for_each_measure(spark, plain_plans):
    g = Given(spark, SF)
    labelled = g.sales.withColumns({"recent_open": F.col("order_type"), "confirmed": F.lit("confirmed"), "new_to_company": F.lit(0), "new_to_lob": F.lit(0)})
    plan = plan_of(campaign_metrics(labelled, line_bundle(Company())))
    per_customer = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line and re.search(r"customer_email|__email", line.split("functions=")[0])]
    assert per_customer and all(len(re.findall(r"(?:sum|max)\(", line.split("output=")[0])) <= 2 for line in per_customer)


def test_customers_of_each_side_are_counted_apart(spark, plain_plans):
    """In one stage with the touches, adaptive execution left all asked times to one task."""
    touched, asked = (spark.createDataFrame([(c,) for c in rows], "__customer string") for rows in ("aab", "ab"))
    found = spark.range(1).select(_crowded([touched, asked], 2).alias("crowded"), F.pmod(F.xxhash64(F.lit("a")), F.lit(BUCKETS)).alias("a"))
    assert found.select(F.expr("size(filter(crowded, c -> c))"), F.expr("get(crowded, cast(a AS int))")).first() == (1, True)
    lines = plan_of(found).splitlines()
    union = next(i for i, line in enumerate(lines) if line.strip(" :+-").startswith("Union"))
    assert "HashAggregate" in lines[union + 1] and "count(1)" in lines[union + 1]


def test_lines_are_looked_up_in_their_orders_and_not_sorted(spark, plain_plans):
    plan = plan_of(Given(spark, SF).touches_ship)
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan


def test_as_of_lookup_moves_no_hash_of_the_customer(spark, plain_plans):
    g = Given(spark, SF)
    plan = plan_of(latest_touch(g.plain_orders, g.touches_ship, g.ship_eligibility))
    assert not re.search(r"hashpartitioning\([^)]*__place", plan)
