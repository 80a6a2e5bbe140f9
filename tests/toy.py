"""Small inputs."""

from datetime import datetime

ORDER_SCHEMA = (
    "order_id long, created_date timestamp_ntz, lob_type string, order_status string, quotation_number string, "
    "territory string, billing_amount string, institution string, customer_email string, user_name string, "
    "promotion_code string, priority string, order_type string"
)
TOUCH_SCHEMA = "campaign string, recipient string, sent_at timestamp_ntz, clicked boolean"
ELIGIBLE_SCHEMA = "campaign string, pos long, order_type string, eligible int"


def day(n, hour=0, minute=0, second=0, micro=0, month=7):
    return datetime(2019, month, n, hour, minute, second, micro)


def raw_order(order_id, **changes):
    row = dict(
        order_id=order_id,
        created_date=day(10),
        lob_type="Sanger Sequencing",
        order_status="Complete",
        quotation_number=None,
        territory="10A",
        billing_amount="$10.0000",
        institution="Somewhere University",
        customer_email="A@x.org",
        user_name="A",
        promotion_code=None,
        priority=None,
        order_type="t1",
    )
    row.update(changes)
    return row


def raw_orders(spark, rows):
    names = [part.split()[0] for part in ORDER_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ORDER_SCHEMA)


def priced(spark, rows):
    """Orders after cleaning: amounts as numbers, derived keys added."""
    from pyspark.sql import functions as F

    from touchcredit.operators import enrich_orders

    df = raw_orders(spark, rows)
    return enrich_orders(df.withColumn("billing_amount", F.expr("try_cast(substr(billing_amount, 2) AS double)")))


def touches(spark, rows):
    return spark.createDataFrame([(c, r, s, k) for c, r, s, k in rows], TOUCH_SCHEMA)


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select("order_id", *columns).collect())
