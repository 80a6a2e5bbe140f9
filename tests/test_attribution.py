import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from toy import ELIGIBLE_SCHEMA, day, ids, priced, raw_order, touches
from touchcredit.functions import at
from touchcredit.operators import by_click, by_list, by_window, latest_touch, order_cells, touch_matrix
from touchcredit.operators.attribution import credited, list_weights, weigh_copies


def eligible(spark, rows):
    return spark.createDataFrame(rows, ELIGIBLE_SCHEMA)


ELIGIBLE = [
    ("c0", 0, "t1", 1), ("c1", 1, "t1", 1), ("c2", 2, "t1", 1),
    ("c0", 0, "t2", 0), ("c1", 1, "t2", 1), ("c2", 2, "t2", 0),
    ("c0", 0, "t3", 0), ("c1", 1, "t3", 0), ("c2", 2, "t3", 0),
]


# ---- lists ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def list_inputs(spark):
    orders = priced(
        spark,
        [raw_order(1), raw_order(2, customer_email="b@x.org"), raw_order(3, customer_email=None), raw_order(4, customer_email="c@x.org")],
    )
    lists = touches(
        spark,
        [
            ("one", "a@x.org", day(1), True), ("one", "a@x.org", day(2), True), ("two", "a@x.org", day(1), False),
            ("two", "b@x.org", day(1), True), ("two", None, day(1), None),
        ],
    )
    return orders, lists


def test_by_list(list_inputs):
    assert ids(by_list(*list_inputs), "recent_open") == [(1, "one"), (1, "two"), (2, "two")]


def test_null_safe(list_inputs):
    assert (3, "two") in ids(by_list(*list_inputs, null_safe=True), "recent_open")


def test_fanout_is_a_weight(list_inputs):
    orders, lists = list_inputs
    labelled = by_list(orders, lists, keep_fanout=True)
    assert ids(labelled, "recent_open", "copies") == [(1, "one", 2), (1, "two", 1), (2, "two", 1)]
    for rows in (labelled, by_list(order_cells(orders, ["customer_email"]), lists, keep_fanout=True)):
        sums = weigh_copies(rows).groupBy("recent_open").agg(F.sum("orders"), F.sum("billing_amount"))
        assert sorted(map(tuple, sums.collect())) == [("one", 2, 20.0), ("two", 2, 20.0)]


def test_by_click(list_inputs):
    assert ids(by_click(*list_inputs), "recent_open") == [(1, "one"), (2, "two")]


def test_list_weights(list_inputs):
    _, lists = list_inputs
    assert sorted(map(tuple, list_weights(lists).collect())) == [("a@x.org", 2, 1), ("b@x.org", 1, 1)]
    assert sorted(map(tuple, list_weights(lists, keep_fanout=True).collect())) == [("a@x.org", 3, 2), ("b@x.org", 1, 1)]


def test_touch_matrix(list_inputs):
    got = ids(touch_matrix(*list_inputs, ["one", "two", "none"]), "one", "two", "none")
    assert got[0] == (1, day(2), day(1), None) and got[3] == (4, None, None, None)
    assert len(got) == 4


def test_window_ends(spark):
    times = [day(1) - timedelta(microseconds=1), day(1), day(1, month=8), day(1, 0, 1, month=8)]
    orders = priced(spark, [raw_order(i, created_date=t) for i, t in enumerate(times)])
    lists = touches(spark, [("one", "a@x.org", day(1), None)])
    assert ids(by_window(orders, lists, at("7/1/2019"))) == [(1,), (2,)]
    assert ids(by_window(orders, lists, at("07/01/2019"), scope=F.col("lob_type") == "x")) == []


# ---- as-of ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**7])
def test_three_outcomes(spark, slice_seconds):
    orders = priced(
        spark,
        [
            raw_order(1),
            raw_order(2, order_type="t2"),
            raw_order(3, order_type="t3"),
            raw_order(4, order_type="untracked"),
            raw_order(5, customer_email="nobody@x.org"),
            raw_order(6, customer_email=None),
            raw_order(7, created_date=day(5)),
            raw_order(8, created_date=day(5, 0, 0, 0, 1)),
            raw_order(9, customer_email="late@x.org"),
        ],
    )
    lists = touches(
        spark,
        [
            ("c0", "a@x.org", day(5), None), ("c2", "a@x.org", day(5), None), ("c1", "a@x.org", day(20), None),
            ("c0", "late@x.org", day(11), None), ("c0", None, day(1), None), ("c0", "nobody@x.org", None, None),
        ],
    )
    complete = latest_touch(orders, lists, eligible(spark, ELIGIBLE), complete=True, slice_seconds=slice_seconds)
    assert ids(complete, "recent_open") == [
        (1, "c0"), (2, "none_open"), (3, "none_open"), (4, None), (7, "none_open"), (8, "c0"), (9, "none_open"),
    ]
    expected = [(1, "c0"), (8, "c0")]
    assert ids(credited(complete), "recent_open") == expected
    assert ids(latest_touch(orders, lists, eligible(spark, ELIGIBLE), slice_seconds=slice_seconds), "recent_open") == expected


def test_resend_does_not_hide_the_earlier_send(spark):
    orders = priced(spark, [raw_order(1)])
    lists = touches(spark, [("c0", "a@x.org", day(3), None), ("c0", "a@x.org", day(25), None), ("c1", "a@x.org", day(2), None)])
    assert ids(latest_touch(orders, lists, eligible(spark, ELIGIBLE)), "recent_open") == [(1, "c0")]


def brute(orders, lists, pairs):
    out = []
    for o in orders:
        best = None
        for campaign, pos, order_type, ok in pairs:
            if not ok or order_type != o["order_type"]:
                continue
            for c, r, sent, _ in lists:
                if c == campaign and r == o["customer_email"].lower() and sent < o["created_date"]:
                    rank = (sent, -pos)
                    if best is None or rank > best[0]:
                        best = (rank, campaign)
        if best:
            out.append((o["order_id"], best[1]))
    return sorted(out)


def make_skewed(seed, grain):
    """A third of all orders and of all touches belong to one customer."""
    rng = random.Random(seed)

    def who():
        return "hot@x.org" if rng.random() < 0.33 else f"u{rng.randrange(8)}@x.org"

    def when():
        return day(1) + grain * rng.randrange(int(timedelta(days=3) / grain))

    orders = [
        raw_order(i, customer_email=who(), created_date=when(), order_type=rng.choice(["t1", "t2", "t3", "t4"]))
        for i in range(300)
    ]
    lists = [(f"c{rng.randrange(3)}", who(), when(), None) for _ in range(120)]
    return orders, lists


@pytest.mark.parametrize(
    "grain", [timedelta(days=1), timedelta(minutes=1), timedelta(seconds=20), timedelta(microseconds=250000)]
)
@pytest.mark.parametrize("slice_seconds", [60, 3600, 86400 * 2])
def test_against_brute_force(spark, grain, slice_seconds):
    rows, lists = make_skewed(11, grain)
    got = latest_touch(priced(spark, rows), touches(spark, lists), eligible(spark, ELIGIBLE), slice_seconds=slice_seconds)
    assert ids(got, "recent_open") == brute(rows, lists, ELIGIBLE)


def test_later_touches_change_nothing(spark):
    rows, lists = make_skewed(2, timedelta(hours=5))
    more = lists + [("c0", o["customer_email"].lower(), o["created_date"], None) for o in rows if o["order_id"] == 7]
    pick = lambda got: [r for r in got if r[0] == 7]
    el = eligible(spark, ELIGIBLE)
    before = latest_touch(priced(spark, rows), touches(spark, lists), el)
    after = latest_touch(priced(spark, rows), touches(spark, more), el)
    assert pick(ids(before, "recent_open")) == pick(ids(after, "recent_open"))


def test_equal_places_do_not_double_orders(spark):
    orders = priced(spark, [raw_order(1)])
    lists = touches(spark, [("c0", "a@x.org", day(3), None), ("c1", "a@x.org", day(3), None)])
    same = eligible(spark, [("c0", 7, "t1", 1), ("c1", 7, "t1", 1), ("c1", 7, "t1", 1)])
    assert ids(latest_touch(orders, lists, same), "recent_open") == [(1, "c1")]


def test_fanout_of_the_credited_touch_is_a_weight(spark):
    orders = priced(spark, [raw_order(1), raw_order(2, customer_email="b@x.org"), raw_order(3, customer_email="late@x.org")])
    lists = touches(
        spark,
        [
            ("c0", "a@x.org", day(3), None), ("c0", "a@x.org", day(3), True), ("c1", "a@x.org", day(2), None),
            ("c1", "b@x.org", day(4), None), ("c1", "late@x.org", day(20), None), ("c1", "late@x.org", day(20), None),
        ],
    )
    el = eligible(spark, ELIGIBLE)
    assert ids(latest_touch(orders, lists, el, keep_fanout=True), "recent_open", "copies") == [(1, "c0", 2), (2, "c1", 1)]
    complete = latest_touch(orders, lists, el, complete=True, keep_fanout=True)
    assert ids(complete, "recent_open", "copies") == [(1, "c0", 2), (2, "c1", 1), (3, "none_open", 1)]


def test_empty_inputs(spark):
    orders = priced(spark, [raw_order(1)])
    lists = touches(spark, [("c0", "a@x.org", day(3), None)])
    el = eligible(spark, ELIGIBLE)
    assert ids(latest_touch(orders.limit(0), lists, el)) == []
    assert ids(latest_touch(orders, lists.limit(0), el)) == []
    assert ids(latest_touch(orders, lists, el.limit(0))) == []
    assert ids(latest_touch(orders, lists, el.limit(0), complete=True), "recent_open") == [(1, None)]


@pytest.mark.parametrize("large", [0, 100, 10**6])
@pytest.mark.parametrize("slice_seconds", [60, 86400])
def test_customers_sorted_whole_and_in_slices_agree(spark, large, slice_seconds):
    """All customers cut into slices, the large one alone, and none."""
    rows, lists = make_skewed(5, timedelta(minutes=7))
    lists += [("unknown", "only@x.org", day(1), None), *lists[:30]]
    rows.append(raw_order(900, customer_email="only@x.org", order_type="t1"))
    orders, sent, el = priced(spark, rows), touches(spark, lists), eligible(spark, ELIGIBLE)
    got = latest_touch(orders, sent, el, slice_seconds=slice_seconds, large=large)
    assert ids(got, "recent_open") == brute(rows, lists, ELIGIBLE)
    complete = latest_touch(orders, sent, el, complete=True, slice_seconds=slice_seconds, keep_fanout=True, large=large)
    assert ids(credited(complete), "recent_open") == brute(rows, lists, ELIGIBLE)
    assert (900, "none_open", 1) in ids(complete, "recent_open", "copies")
    assert {n for *_, n in ids(complete, "recent_open", "copies")} >= {1, 2}
    assert ids(complete, "recent_open", "copies") == ids(
        latest_touch(orders, sent, el, complete=True, keep_fanout=True), "recent_open", "copies"
    )
