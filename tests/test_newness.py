import random

from pyspark.sql import functions as F

from toy import day, ids, priced, raw_order
from touchcredit.functions import at
from touchcredit.operators import flag_new, known_customers

HISTORY = "customer_email string, email_lob string"


def test_fixed_cutoff(spark):
    rows = [
        raw_order(1, customer_email="old@x.org"),
        raw_order(2, customer_email="listed@x.org"),
        raw_order(3, customer_email="fresh@x.org"),
        raw_order(4, customer_email=None),
        raw_order(5, customer_email="sameday@x.org", created_date=day(5)),
        raw_order(6, customer_email="old@x.org", lob_type="Regulatory"),
        raw_order(7, customer_email="old@x.org", created_date=day(4)),
    ]
    orders = priced(spark, rows)
    history = spark.createDataFrame([("listed@x.org", None), (None, None)], HISTORY)
    labelled = orders.where("order_id < 7").withColumn("recent_open", F.lit("c0"))
    for known in (known_customers(orders, history), known_customers(orders, history, before=at("2019-07-05"))):
        flagged = flag_new(labelled, known, cutoff=at("2019-07-05"))
        assert ids(flagged, "new_to_company", "new_to_lob") == [
            (1, 0, 0), (2, 0, 1), (3, 1, None), (4, 1, None), (5, 1, None), (6, 0, 1),
        ]


def test_per_campaign_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [
        raw_order(
            i, customer_email=f"u{rng.randrange(12)}@x.org", created_date=day(rng.randrange(1, 29)),
            lob_type=rng.choice(["Gene Synthesis", "Regulatory", "Sanger Sequencing"]),
        )
        for i in range(60)
    ]
    listed = [("u1@x.org", "u1@x.org*gs"), ("u2@x.org", "u3@x.org*rs")]
    dates = {"c0": day(5), "c1": day(15), "c2": day(25)}
    orders = priced(spark, rows)
    labelled = orders.withColumn("recent_open", F.concat(F.lit("c"), (F.col("order_id") % 3).cast("string")))
    table = spark.createDataFrame(list(dates.items()), "campaign string, sent_date timestamp_ntz")
    known = known_customers(orders, spark.createDataFrame(listed, HISTORY))
    got = ids(flag_new(labelled, known, table), "new_to_company", "new_to_lob")

    all_rows = orders.select("order_id", "created_date", "customer_email", "email_lob").collect()
    expected = []
    for r in all_rows:
        cut = dates[f"c{r.order_id % 3}"]
        emails = {e for e, _ in listed} | {o.customer_email for o in all_rows if o.created_date < cut}
        lines = {k for _, k in listed} | {o.email_lob for o in all_rows if o.created_date < cut}
        new = int(r.customer_email not in emails)
        expected.append((r.order_id, new, None if new else int(r.email_lob not in lines)))
    assert got == sorted(expected)
