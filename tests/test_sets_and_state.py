"""Customer sets, the members' prefilter, kept first appearances, and the rules in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from test_plan_shapes import plain_plans, plan_of  # noqa: F401
from toy import day, priced, raw_order, raw_orders, touches
from touchcredit.functions import at, register_functions
from touchcredit.operators import (
    CleaningRules,
    by_list,
    clean_orders,
    customer_sets,
    enrich_orders,
    flag_new,
    known_customers,
    likely_members,
    merge_sets,
    number_customers,
    set_sizes,
)
from touchcredit.plans import KnownState


def test_numbers_are_dense_and_unique(spark):
    emails = [f"u{i}@x.org" for i in range(500)]
    df = spark.createDataFrame([(e,) for e in [*emails, *emails[:300], None]], "customer_email string").repartition(5)
    rows = number_customers(df, places=7).collect()
    assert sorted(r.number for r in rows) == list(range(500)) and {r.customer_email for r in rows} == set(emails)
    assert number_customers(df.limit(0)).count() == 0


def test_sets_count_as_distinct_at_any_level(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([f"u{i}" for i in range(90)] + [None]), rng.randrange(3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "recent_open string, customer_email string, v int")
    sets = customer_sets(df, number_customers(df, 5), ["recent_open"], {"all": None, "twos": F.col("v") == 2})
    for keep in (["recent_open"], []):
        want = {}
        for c, e, v in rows:
            if e is not None:
                own = want.setdefault(c if keep else None, (set(), set()))
                own[0].add(e)
                own[1].update([e] if v == 2 else [])
        got = {(r.recent_open if keep else None): (r.all, r.twos) for r in set_sizes(sets, keep, ["all", "twos"]).collect()}
        assert got == {k: (len(x), len(y)) for k, (x, y) in want.items()}
    twice = merge_sets(sets.union(sets), ["recent_open"], ["all", "twos"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, merge_sets(sets, ["recent_open"], ["all", "twos"]).collect()))


def test_a_roll_up_reads_no_customers(spark, tmp_path, plain_plans):  # noqa: F811
    df = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("b", "u2")], "recent_open string, customer_email string")
    customer_sets(df, number_customers(df), ["recent_open"], {"all": None}).write.parquet(str(tmp_path / "sets"))
    total = set_sizes(spark.read.parquet(str(tmp_path / "sets")), [], ["all"])
    assert total.first()["all"] == 2 and "customer_email" not in plan_of(total)


def test_prefilter_keeps_all_members_and_few_others(spark):
    people = [f"u{i}@x.org" for i in range(4000)]
    orders = spark.createDataFrame([(i, p) for i, p in enumerate([*people, None])], "order_id long, customer_email string")
    lists = touches(spark, [("c", p, None, None) for p in people[::10]] + [("d", people[0], None, None), ("d", None, None, None)])
    passed = {r.customer_email for r in likely_members(orders, lists).collect()}
    assert set(people[::10]) <= passed and len(passed) < 600
    exact = by_list(orders, lists).select("order_id", "recent_open").collect()
    assert sorted(by_list(likely_members(orders, lists), lists).select("order_id", "recent_open").collect()) == sorted(exact)
    # A bitmap that is too small for the lists lets more through, and loses none.
    crowded = touches(spark, [("c", f"v{i}", None, None) for i in range(60_000)] + [("c", p, None, None) for p in people[::10]])
    full = {r.customer_email for r in likely_members(orders, crowded, most_bits=1 << 15).collect()}
    assert set(people[::10]) <= full
    assert likely_members(orders, lists.limit(0)).count() == 0


def test_prefilter_comes_before_the_shuffle(spark, plain_plans):  # noqa: F811
    orders = priced(spark, [raw_order(1)])
    lists = touches(spark, [("c", "a@x.org", None, None)])
    plan = plan_of(by_list(likely_members(orders, lists), lists).select("order_id"))
    assert "xxhash64(0, " in plan and "NestedLoop" not in plan


ORDERS = [
    raw_order(1, created_date=day(1), customer_email="a@x.org"), raw_order(2, created_date=day(5), customer_email="a@x.org", lob_type="Regulatory"),
    raw_order(3, created_date=day(9), customer_email="b@x.org"), raw_order(4, created_date=day(20), customer_email="c@x.org"),
    raw_order(5, created_date=day(2), customer_email="c@x.org"), raw_order(6, created_date=day(3), customer_email=None),
]


def test_state_by_batches_equals_one_run(spark, tmp_path):
    orders = priced(spark, ORDERS)
    history = spark.createDataFrame([("b@x.org", "b@x.org*sanger")], "customer_email string, email_lob string")
    state = KnownState(spark, str(tmp_path / "state"))
    assert state.known().customers.count() == 0
    assert state.merge("h", history=history)
    assert state.merge("late", orders.where("order_id IN (3, 4)"))
    assert state.merge("early", orders.where("order_id NOT IN (3, 4)"), history.limit(0))
    before = sorted(map(str, state.known().lines.collect()))
    assert not state.merge("late", orders)
    assert sorted(map(str, state.known().lines.collect())) == before
    whole = known_customers(orders, history)
    labelled = orders.withColumn("recent_open", F.lit("c"))
    for cutoff in ("2019-07-01", "2019-07-04", "2019-08-01"):
        rows = [
            sorted(map(str, flag_new(labelled, k, cutoff=at(cutoff)).select("order_id", "new_to_company", "new_to_lob").collect()))
            for k in (whole, state.known())
        ]
        assert rows[0] == rows[1]


def test_a_merge_reads_no_earlier_orders(spark, tmp_path):
    """The state is kept when the files of earlier batches are gone, and a merge that fails changes nothing."""
    orders = priced(spark, ORDERS)
    for name, ids in (("one", "(1, 2)"), ("two", "(4, 5)")):
        orders.where(f"order_id IN {ids}").write.parquet(str(tmp_path / name))
    state = KnownState(spark, str(tmp_path / "state"))
    state.merge("one", spark.read.parquet(str(tmp_path / "one")))
    for f in (tmp_path / "one").iterdir():
        f.rename(tmp_path / f"gone-{f.name}")
    with pytest.raises(Exception, match="lost"):
        state.merge("bad", orders.withColumn("customer_email", F.raise_error(F.lit("lost")).cast("string")))
    state.merge("two", spark.read.parquet(str(tmp_path / "two")))
    first = {r.customer_email: r.first_order for r in state.known().customers.collect()}
    assert first == {"a@x.org": day(1), "c@x.org": day(2)}


def test_rules_in_sql_equal_the_operators(spark):
    rules = CleaningRules.for_company("Acme's \\d")
    rows = [
        raw_order(1, billing_amount="$1.23456"), raw_order(2, billing_amount="AU$10.5"), raw_order(3, billing_amount="$12d"),
        raw_order(4, billing_amount=None), raw_order(5, billing_amount="£3"), raw_order(6, billing_amount="$0.0000"),
        raw_order(7, order_status=None), raw_order(8, lob_type=None, order_status="Cart"), raw_order(9, territory="40A"),
        raw_order(10, territory=None), raw_order(11, lob_type="Cloning and Mutagenesis", order_status="Cart"),
        raw_order(12, lob_type="Regulatory", order_status="Cart", quotation_number="q"), raw_order(13, institution="ACME'S 7"),
        raw_order(14, institution=None, customer_email=None), raw_order(15, billing_amount="$1,2"), raw_order(16, order_status="Discard"),
    ]
    raw_orders(spark, rows).createOrReplaceTempView("sql_rules_orders")
    names = register_functions(spark, rules, orders_view="sql_rules_orders")
    assert "clean_orders" in names
    columns = ["order_id", "created_date", "customer_email", "email_lob", "lob_type", "lob", "order_status", "promotion_code", "billing_amount"]
    want = enrich_orders(clean_orders(raw_orders(spark, rows), rules)[0]).select(*columns)
    got = spark.sql("SELECT * FROM clean_orders()").select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() >= 6
    assert got.schema["billing_amount"].dataType == want.schema["billing_amount"].dataType


def test_sql_filters_reach_the_scan(spark, tmp_path, plain_plans):  # noqa: F811
    raw_orders(spark, ORDERS).write.parquet(str(tmp_path / "raw"))
    spark.read.parquet(str(tmp_path / "raw")).createOrReplaceTempView("sql_scan_orders")
    register_functions(spark, CleaningRules.for_company("Acme"), orders_view="sql_scan_orders")
    df = spark.sql("SELECT sum(billing_amount) FROM clean_orders() WHERE created_date >= CAST(:start AS TIMESTAMP_NTZ)", args={"start": "2019-07-04"})
    plan = plan_of(df)
    pushed = plan[plan.index("PushedFilters") :]
    assert "territory" in pushed and "GreaterThanOrEqual(created_date" in pushed and "Python" not in plan
    clean, _ = clean_orders(spark.read.parquet(str(tmp_path / "raw")), CleaningRules.for_company("Acme"))
    own = plan_of(clean)
    assert ("IsNull(territory)" in own) == ("IsNull(territory)" in plan)
