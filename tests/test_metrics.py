import random

import pytest
from pyspark.sql import functions as F

from toy import priced, raw_order
from touchcredit import constants as C
from touchcredit.operators import (
    Measure,
    acquired_measures,
    add_confirmed,
    campaign_metrics,
    direct_measures,
    metric_rows,
    new_customer_list,
    order_cells,
    quote_measures,
    revenue_split_measures,
    source_breakdown,
    status_measures,
    total_measures,
    unique_measure,
)
from touchcredit.plans.common import Company, line_bundle, promo_bundle

CELLS = ["recent_open", "customer_email", "lob_type", "lob", "confirmed", "new_to_company", "new_to_lob"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = [
        raw_order(
            i, customer_email=rng.choice(["a@x.org", "b@x.org", "c@x.org", None]),
            lob_type=rng.choice(list(C.LINE_CODES)), order_status=rng.choice(["Cart", "Complete", None]),
            billing_amount=f"${rng.randrange(1, 99)}.2500", promotion_code=rng.choice(["P", None]),
        )
        for i in range(200)
    ]
    df = add_confirmed(priced(spark, rows))
    new = F.when(F.col("customer_email").isNull() | (F.col("customer_email") == "a@x.org"), 1).otherwise(0)
    return df.withColumns(
        {
            "recent_open": F.when(
                F.col("order_id") % 7 != 0, F.concat(F.lit("c"), (F.col("order_id") % 2).cast("string"))
            ),
            "new_to_company": new,
            "new_to_lob": F.when(new == 0, (F.col("order_id") % 3 == 0).cast("int")),
        }
    )


def plain_value(m: Measure):
    """The direct form of each measure."""
    if m.kind == "orders":
        return F.count(F.when(F.lit(True) if m.when is None else m.when, F.col("customer_email")))
    if m.kind == "revenue":
        return F.sum("billing_amount") if m.when is None else F.sum(F.when(m.when, F.col("billing_amount")).otherwise(0.0))
    return F.count_distinct(F.col("customer_email") if m.when is None else F.when(m.when, F.col("customer_email")))


def table(df):
    return {r[0]: [round(v, 6) if v is not None else None for v in r[1:]] for r in df.collect()}


def test_widths(spark):
    def width(ms):
        return len({m.name for m in ms})

    company = Company()
    assert width(line_bundle(company)) == 49 and width(promo_bundle(company)) == 13


def test_width_of_the_window_report(spark):
    names = [m.name for m in total_measures() + status_measures("Company", None) + acquired_measures("Company", None) + unique_measure()]
    assert len(names) == len(set(names)) == 11


@pytest.mark.parametrize("bundle", [
    lambda: line_bundle(Company()),
    lambda: promo_bundle(Company()),
    lambda: revenue_split_measures() + total_measures(),
])
def test_two_steps_equal_plain_aggregates(labelled, bundle):
    bundle = bundle()
    plain = labelled.groupBy("recent_open").agg(*[plain_value(m).alias(m.name) for m in bundle])
    assert table(campaign_metrics(labelled, bundle)) == table(plain)
    cells = order_cells(labelled, [*CELLS, "promotion_code"])
    assert table(campaign_metrics(cells, bundle, orders_col="orders")) == table(plain)


def test_spine_gives_rows_of_nulls_in_order(spark, labelled):
    spine = spark.createDataFrame([("c1", 0), ("missing", 1), ("c0", 2)], "recent_open string, pos int")
    rows = campaign_metrics(labelled, quote_measures() + unique_measure(), spine=spine).collect()
    assert [r.recent_open for r in rows] == ["c1", "missing", "c0"]
    assert all(v is None for v in rows[1][1:]) and all(v is not None for v in rows[0])


def test_global_over_nothing(labelled):
    row = campaign_metrics(labelled.where("false"), total_measures() + unique_measure(), key=None).collect()
    assert [tuple(r) for r in row] == [(0, None, 0)]


def test_line_revenue_adds_up(labelled):
    parts = [m for m in quote_measures() + direct_measures() if m.kind == "revenue"]
    both = campaign_metrics(labelled, parts + [Measure("all", "revenue")])
    for row in both.collect():
        assert sum(row[1:-1]) == pytest.approx(row["all"])


def test_metric_rows(labelled):
    one = campaign_metrics(labelled, total_measures(), key=None)
    rows = metric_rows(one).collect()
    assert [(r.pos, r.metric) for r in rows] == [(0, "# of Order"), (1, "Revenue")]
    assert [r.value for r in rows] == [float(v) for v in one.first()]


def test_breakdown(labelled):
    weights = {"All": F.lit(1), "Twice": F.when(F.col("order_id") < 50, 2).otherwise(0), "Never": F.lit(0)}
    rows = source_breakdown(labelled, weights).orderBy("pos").collect()
    assert [r.metric for r in rows][:4] == ["NGS_Total", "NGS_NonConfirmedRevenue", "NGS_ConfirmedRevenue", "GS_Total"]
    assert len(rows) == 15 and all(r.Never is None for r in rows)
    data = labelled.collect()
    ngs = [r for r in data if r.lob == "ngs"]
    assert rows[0].All == pytest.approx(sum(r.billing_amount for r in ngs))
    assert rows[1].Twice == pytest.approx(
        2 * sum(r.billing_amount for r in ngs if r.confirmed == "non_confirmed" and r.order_id < 50)
    )


def test_new_customer_list(spark, labelled):
    got = new_customer_list(labelled, F.col("recent_open"), "Acme")
    assert got.columns == [
        "New Customer Type", "Customer Email", "Customer Name", "Institution", "Campaign Source", "First Order LoB",
    ]
    expected = set()
    for r in labelled.collect():
        if r.new_to_company == 1:
            expected.add(("New to Acme", r.customer_email, r.user_name, r.institution, r.recent_open, r.lob))
        if r.new_to_lob == 1:
            expected.add((f"New to {r.lob}", r.customer_email, r.user_name, r.institution, r.recent_open, "N/A"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
