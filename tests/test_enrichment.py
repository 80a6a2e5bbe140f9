from toy import ids, priced, raw_order
from touchcredit.functions import contains_word, minute_number
from touchcredit.operators import add_confirmed, in_scope
from pyspark.sql import functions as F


def test_keys(spark):
    df = priced(
        spark,
        [
            raw_order(1, lob_type="Gene Synthesis", customer_email="Ann@X.org"),
            raw_order(2, lob_type="Something Else"),
            raw_order(3, customer_email=None),
            raw_order(4, lob_type=None),
        ],
    )
    assert ids(df, "customer_email", "lob", "email_lob") == [
        (1, "ann@x.org", "gs", "ann@x.org*gs"),
        (2, "a@x.org", "Something Else", "a@x.org*something else"),
        (3, None, "sanger", None),
        (4, "a@x.org", None, None),
    ]


def test_confirmed(spark):
    rows = [
        raw_order(1, order_status="Cart"),
        raw_order(2, lob_type="Gene Synthesis", order_status="Discard"),
        raw_order(3, lob_type="Gene Synthesis", order_status=None),
        raw_order(4, lob_type="Gene Synthesis"),
        raw_order(5, lob_type=None, order_status="Cart"),
    ]
    df = priced(spark, rows)
    assert ids(add_confirmed(df), "quote_based", "confirmed") == [
        (1, 0, "confirmed"),
        (2, 1, "non_confirmed"),
        (3, 1, "confirmed"),
        (4, 1, "confirmed"),
        (5, 0, "confirmed"),
    ]
    by_status = ids(add_confirmed(df, None), "confirmed")
    assert [s for _, s in by_status] == ["non_confirmed", "non_confirmed", "confirmed", "confirmed", "non_confirmed"]


def test_scope_and_code(spark):
    rows = [
        raw_order(1, lob_type="Regulatory", promotion_code="my-FLASH"),
        raw_order(2, lob_type="Gene Synthesis", priority="Fast", promotion_code="Flash19"),
        raw_order(3, lob_type="Gene Synthesis", priority=None),
        raw_order(4, promotion_code="fla"),
    ]
    df = priced(spark, rows)
    assert [r[0] for r in ids(df.where(in_scope(["Fast"])))] == [1, 2]
    assert [r[0] for r in ids(df.where(contains_word(F.col("promotion_code"), "flash")))] == [1, 2]


def test_minutes_rise_with_the_clock_through_a_clock_change(spark):
    """02:30 on 2019-03-10 does not exist in the session's zone."""
    texts = ["2019-03-10 01:59:59", "2019-03-10 02:30:00", "2019-03-10 03:10:00", "2019-11-03 01:30:00", "1969-12-31 23:59:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr("cast(t AS timestamp_ntz)").alias("ts"))
    got = [r[0] for r in df.select(minute_number(F.col("ts"))).collect()]
    import datetime

    epoch = datetime.datetime(1970, 1, 1)
    assert got == [int((datetime.datetime.fromisoformat(t) - epoch).total_seconds() // 60) for t in texts]
