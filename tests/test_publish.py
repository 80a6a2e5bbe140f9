"""Reports published as a whole, audits in the scan that writes, and scans that lose no row."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_plan_shapes import plain_plans, plan_of  # noqa: F401
from toy import day, raw_order, raw_orders
from touchcredit import jobs
from touchcredit.functions import parse_time, unreadable
from touchcredit.operators import CleaningRules, clean_orders
from touchcredit.operators.cleaning import REASONS, fate_totals, observed, observed_totals, order_fate
from touchcredit.plans import Publication, cleaning_tables, overwrite_months, published
from touchcredit.sources import scan_orders, tidy_checked

RULES = CleaningRules.for_company("Acme")


def test_a_report_is_seen_as_a_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        published(spark, folder)
    Publication(spark, folder).publish({"One Table": one, "Two": two})
    assert {t: df.count() for t, df in published(spark, folder).items()} == {"One Table": 3, "Two": 5}

    broken = Publication(spark, folder)
    broken.keep("One Table", spark.range(9))
    fails = spark.range(4).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        broken.publish({"One Table": spark.range(9), "Two": fails})
    assert published(spark, folder)["One Table"].count() == 3

    later = Publication(spark, folder)
    kept = later.keep("One Table", spark.range(7))
    later.publish({"One Table": kept, "Two": two})
    assert published(spark, folder)["One Table"].count() == 7
    rows = spark.read.json(f"{folder}/manifests").orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 2] and [t.rows for t in rows[1].tables] == [7, 5]


def test_a_published_csv(spark, tmp_path):
    run = Publication(spark, str(tmp_path), "csv")
    run.publish({"T": spark.createDataFrame([("a", None)], "x string, y string")})
    assert [tuple(r) for r in published(spark, str(tmp_path))["T"].collect()] == [("a", None)]


def test_months_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "orders")
    df = spark.createDataFrame([(1, day(1)), (2, day(5)), (3, day(1, month=8))], "order_id long, created_date timestamp_ntz")
    overwrite_months(df, path)
    overwrite_months(spark.createDataFrame([(4, day(9, month=8))], df.schema), path)
    assert sorted((r.order_id, r.month) for r in spark.read.parquet(path).collect()) == [(1, "2019-07"), (2, "2019-07"), (4, "2019-08")]


def spoiled(spark):
    rows = [
        raw_order(1), raw_order(2, order_status="Cart"), raw_order(3, territory="20A"), raw_order(4, billing_amount="$0.0000"),
        raw_order(5, billing_amount="£3.0000"), raw_order(6, institution="ACME"), raw_order(7, billing_amount="$1,2"),
        raw_order(8, billing_amount=None), raw_order(9), raw_order(10, customer_email="x@acme.com"), raw_order(11, order_status=None),
        raw_order(12, billing_amount="AU$10.0000"),
    ]
    df = raw_orders(spark, rows)
    times = F.when(F.col("order_id") == 9, "30/07/2019").when(F.col("order_id") == 11, " ").otherwise("7/30/2019")
    return tidy_checked(df.withColumn("created_date", times))


FATES = {
    1: "kept", 2: "status", 3: "territory", 4: "zero amount", 5: "foreign amount", 6: "internal account", 7: "unreadable amount",
    8: "unreadable amount", 9: "unreadable time", 10: "internal account", 11: "kept", 12: "kept",
}


def test_every_order_has_one_fate(spark):
    raw = spoiled(spark)
    assert {r.order_id: r.fate for r in raw.select("order_id", order_fate(raw.columns, RULES).alias("fate")).collect()} == FATES
    clean, rejects = clean_orders(raw, RULES)
    assert sorted(r.order_id for r in clean.collect()) == [1, 11, 12] and "bad_time" not in clean.columns
    assert {r.order_id: r.reason for r in rejects.collect()} == {k: v for k, v in FATES.items() if v in REASONS}
    totals = {r.fate: (r.orders, r.revenue) for r in fate_totals(raw, RULES).collect()}
    assert sum(n for n, _ in totals.values()) == raw.count() and totals["kept"] == (3, Decimal("26.9000"))
    assert totals["foreign amount"] == (1, 0) and totals["unreadable amount"] == (2, 0)


def test_the_audit_comes_from_the_scan_that_writes(spark, tmp_path, plain_plans):  # noqa: F811
    spoiled(spark).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    watched, watch = observed(raw, RULES)
    clean = clean_orders(watched, RULES)[0]
    assert plan_of(clean).count("FileScan") == 1 and "Exchange" not in plan_of(clean)
    clean.write.format("noop").mode("overwrite").save()
    counted = {fate: (n, amount or 0) for fate, n, amount in observed_totals(watch)}
    assert counted == {r.fate: (r.orders, r.revenue) for r in fate_totals(raw, RULES).collect()}
    run = Publication(spark, str(tmp_path / "out"))
    run.publish(cleaning_tables(raw, RULES, run.keep))
    tables = published(spark, str(tmp_path / "out"))
    assert {r.fate: (r.orders, r.revenue) for r in tables["Audit"].collect()} == counted
    assert tables["Cleaned"].count() == counted["kept"][0] and tables["Rejects"].count() == 3


def test_times_never_end_the_job(spark):
    texts = ["30/07/2019", "13/13/2019", "7/31/2019", "02/30/2020", "2019-07-31 10:00:00", "soon", "", None, "0/1/2019", "1/1/99999", "2019-02-30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", parse_time(F.col("t")).alias("ts"), unreadable(F.col("t")).alias("bad")).collect()
    assert [r.t for r in got if r.ts is not None] == ["7/31/2019", "2019-07-31 10:00:00"]
    assert [r.t for r in got if r.bad] == ["30/07/2019", "13/13/2019", "02/30/2020", "soon", "0/1/2019", "1/1/99999", "2019-02-30"]


def test_no_row_of_a_spoiled_file_is_lost(spark, tmp_path):
    columns = ["CreatedDate", "LineOfBusinessType", "OrderStatus", "QuotationNumber", "Territory", "BillingAmount", "Institution", "CustomerEmail"]
    good = "7/30/2019,Sanger Sequencing,Complete,,10A,$5.0000,Inst,a@x.org"
    rows = [",".join(columns), good, good + ",more", "7/30/2019,Sanger Sequencing", good.replace("7/30", "30/7"), good.replace("$5", "$five"), "", good]
    (tmp_path / "orders.csv").write_text("\n".join(rows) + "\n")
    raw = scan_orders(spark, str(tmp_path / "orders.csv"), columns)
    totals = {r.fate: r.orders for r in fate_totals(raw, RULES).collect()}
    assert totals == {"kept": 2, "row shape": 2, "unreadable time": 1, "unreadable amount": 1}
    clean, rejects = clean_orders(raw, RULES)
    assert clean.count() == 2 and clean.select("billing_amount").distinct().count() == 1
    texts = {r.reason: r.bad_row for r in rejects.collect()}
    assert texts["row shape"] in rows and texts["unreadable time"] is None
    with pytest.raises(Exception, match="(?i)header|column"):
        scan_orders(spark, str(tmp_path / "orders.csv"), columns[::-1]).count()


def test_a_job_that_publishes(spark, tmp_path, monkeypatch):
    columns = ["CreatedDate", "LineOfBusinessType", "OrderStatus", "QuotationNumber", "Territory", "BillingAmount", "Institution", "CustomerEmail"]
    (tmp_path / "orders.csv").write_text(",".join(columns) + "\n7/30/2019,Sanger Sequencing,Complete,,10A,$5.0000,Inst,a@x.org\nbad\n")
    settings = {"orders": str(tmp_path / "orders.csv"), "columns": columns, "out": str(tmp_path / "out"), "publish": True}
    (tmp_path / "s.json").write_text(json.dumps(settings))
    jobs.main(["clean", str(tmp_path / "s.json")])
    tables = published(spark, str(tmp_path / "out"))
    assert {r.fate: r.orders for r in tables["Audit"].collect()} == {"kept": 1, "row shape": 1}
    assert tables["Rejects"].first().bad_row == "bad"
