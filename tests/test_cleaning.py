import pytest
from pyspark.sql import functions as F

from toy import raw_order, raw_orders
from touchcredit.functions import parse_amount, round4
from touchcredit.operators import CleaningRules, clean_orders, clean_stages

RULES = CleaningRules.for_company("Acme")
QUOTE = "Gene Synthesis"

CASES = {
    "null status of a direct order": (dict(order_status=None), "kept"),
    "direct order in cart": (dict(order_status="Cart"), "dropped"),
    "direct order discarded": (dict(order_status="Discard"), "dropped"),
    "null line counts as direct": (dict(lob_type=None, order_status="Ready To Order"), "dropped"),
    "null territory": (dict(territory=None), "kept"),
    "foreign territory": (dict(territory="22C"), "dropped"),
    "quote order in cart, no quotation": (dict(lob_type=QUOTE, order_status="Cart"), "kept"),
    "quote order in cart, with quotation": (
        dict(lob_type=QUOTE, order_status="Cart", quotation_number="7"), "dropped"),
    "quote order, null status, with quotation": (
        dict(lob_type=QUOTE, order_status=None, quotation_number="7"), "kept"),
    "quote order complete, with quotation": (dict(lob_type=QUOTE, quotation_number="7"), "kept"),
    "quote order discarded": (dict(lob_type=QUOTE, order_status="Discard"), "kept"),
    "quote order draft": (dict(lob_type=QUOTE, order_status="Draft"), "dropped"),
    "zero home amount": (dict(billing_amount="$0.0000"), "dropped"),
    "zero converted amount": (dict(billing_amount="AU$0.0000"), "kept"),
    "yen": (dict(billing_amount="JPY.￥100.0000"), "dropped"),
    "yen with another sign in place of the dot": (dict(billing_amount="JPY ￥100.0000"), "dropped"),
    "pound": (dict(billing_amount="£1.0000"), "dropped"),
    "euro": (dict(billing_amount="€1.0000"), "dropped"),
    "amount with a comma": (dict(billing_amount="$1,234.00"), "rejected"),
    "amount with a type suffix": (dict(billing_amount="$12d"), "rejected"),
    "amount that is no number": (dict(billing_amount="$nan"), "rejected"),
    "null amount": (dict(billing_amount=None), "rejected"),
    "company in capitals": (dict(institution="The ACME Lab"), "dropped"),
    "company in small letters": (dict(institution="acme"), "dropped"),
    "company in mixed case": (dict(institution="Acme Inc"), "kept"),
    "null institution": (dict(institution=None), "kept"),
    "company email, any char for the dot": (dict(customer_email="x@acmeXcom"), "dropped"),
    "company test email": (dict(customer_email="acme.test@x.org"), "dropped"),
    "company email in capitals": (dict(customer_email="x@ACME.COM"), "kept"),
    "null email": (dict(customer_email=None), "kept"),
}


@pytest.fixture(scope="module")
def outcome(spark):
    names = list(CASES)
    raw = raw_orders(spark, [raw_order(i, **CASES[n][0]) for i, n in enumerate(names)])
    clean, rejects = clean_orders(raw, RULES)
    kept = {r.order_id for r in clean.collect()}
    rejected = {r.order_id for r in rejects.collect()}
    assert not kept & rejected
    return {n: "kept" if i in kept else "rejected" if i in rejected else "dropped" for i, n in enumerate(names)}


@pytest.mark.parametrize("name", list(CASES))
def test_row(outcome, name):
    assert outcome[name] == CASES[name][1]


def test_amounts(spark):
    texts = ["$12.34567", "AU$100.0000", "AU$0.0000", "$1e3", "$ 7 ", "$1.00005", "$1.00015", "$x", "$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    amounts = df.select(parse_amount(F.col("t")).alias("amount"))
    assert amounts.dtypes == [("amount", "decimal(18,4)")]
    values = [None if r[0] is None else float(r[0]) for r in amounts.collect()]
    assert values == [12.3457, 69.0, 0.0, 1000.0, 7.0, 1.0001, 1.0002, None, None]


def test_round4_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.uniform(0, 1e6, 2000), np.arange(2000) / 20000 + 5e-5])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = [float(r[0]) for r in df.orderBy("i").select(round4(F.col("x"))).collect()]
    assert got == list(np.round(xs, 4))


def test_stages_and_remap(spark):
    raw = raw_orders(spark, [raw_order(1, lob_type="Cloning and Mutagenesis"), raw_order(2, lob_type=None)])
    stages = clean_stages(raw, RULES)
    assert [r.lob_type for r in stages["cleaned"].orderBy("order_id").collect()] == ["Cloning and Mutagenesis", None]
    assert [r.lob_type for r in stages["ready"].orderBy("order_id").collect()] == ["Gene Synthesis", None]


def test_no_internal_rules_by_default(spark):
    clean, _ = clean_orders(raw_orders(spark, [raw_order(1, institution="ACME")]), CleaningRules())
    assert clean.count() == 1


def test_sums_are_exact(spark):
    """Amounts whose sum as doubles depends on the order add up to the same in any."""
    df = spark.createDataFrame([(f"${x}",) for x in ("0.1000", "0.2000", "0.3000", "99999999999.9999")], "t string")
    total = df.repartition(3).agg(F.sum(parse_amount(F.col("t")))).first()[0]
    assert str(total) == "100000000000.5999"
