from datetime import datetime

import pytest
from pyspark.sql import functions as F

from toy import day
from touchcredit.functions import parse_time
from touchcredit.sources import (
    campaign_groups,
    campaigns,
    eligibility,
    normalise_headers,
    read_history,
    read_index,
    read_open_list,
    read_orders,
    read_touches,
)

LONG = "Promo 30% off A+B_é"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "index.csv").write_text(
        "long_name,short_name,combined_name,sent_date,t one,t2\n"
        f"Promo 30% off/ A+B_é,first,both,7/31/2019,x,\n"
        "Second,second,both,2019-08-02 10:00:00,,\n"
        "Third,third,,08/03/2019,1,yes\n",
        encoding="utf-8",
    )
    lists = root / "lists"
    lists.mkdir()
    header = "Recipient,Sent At (your time zone),Clicked\n"
    (lists / f"{LONG}.csv").write_text(header + "Ann@X.org,2019-07-31 08:00:00,true\n", encoding="utf-8")
    (lists / "Second.csv").write_text(header + "b@x.org,2019-08-02 09:30:00,false\n")
    (lists / "Unlisted.csv").write_text(header + "c@x.org,2019-08-02 09:30:00,false\n")
    part = lists / "Third"
    part.mkdir()
    (part / "part-00000.csv").write_text(header + "d@x.org,8/3/2019,\n")
    (root / "orders.csv").write_text(
        "Extra,CreatedDate,LineOfBusinessType,BillingAmount,CustomerEmail\n"
        'e,2019-07-01 10:11:12.123456,Regulatory,"$1,234.00",Ann@X.org\n'
    )
    (root / "history.csv").write_text("Email,Email + LoB\nAnn@X.org,Ann@X.org*gs\n")
    return root


def test_index(spark, folder):
    index = read_index(spark, str(folder / "index.csv"))
    table = campaigns(index).orderBy("pos").collect()
    assert [(r.campaign, r.long_name, r.combined_name, r.sent_date) for r in table] == [
        ("first", "Promo 30% off A+B_é", "both", day(31)),
        ("second", "Second", "both", datetime(2019, 8, 2, 10)),
        ("third", "Third", None, datetime(2019, 8, 3)),
    ]
    pairs = {(r.campaign, r.order_type): r.eligible for r in eligibility(index).collect()}
    assert pairs == {
        ("first", "t one"): 1, ("first", "t2"): 0, ("second", "t one"): 0, ("second", "t2"): 0,
        ("third", "t one"): 1, ("third", "t2"): 1,
    }
    assert [r.combined_name for r in campaign_groups(campaigns(index)).collect()] == ["both"]


def test_groups_given_by_name(spark, folder):
    index = read_index(spark, str(folder / "index.csv")).drop("combined_name")
    got = {r.campaign: r.combined_name for r in campaigns(index, {"first": "g"}).collect()}
    assert got == {"first": "g", "second": None, "third": None}


def test_all_lists_in_one_scan(spark, folder):
    table = campaigns(read_index(spark, str(folder / "index.csv")))
    rows = read_touches(spark, str(folder / "lists"), table).orderBy("campaign").collect()
    assert [tuple(r) for r in rows] == [
        ("first", "ann@x.org", day(31, 8), True),
        ("second", "b@x.org", datetime(2019, 8, 2, 9, 30), False),
        ("third", "d@x.org", datetime(2019, 8, 3), None),
    ]


def test_one_list(spark, folder):
    rows = read_open_list(spark, str(folder / "lists" / "Second.csv"), "mine").collect()
    assert [tuple(r) for r in rows] == [("mine", "b@x.org", datetime(2019, 8, 2, 9, 30), False)]


def test_orders_and_history(spark, folder):
    orders = read_orders(spark, str(folder / "orders.csv"), "csv")
    assert orders.columns == ["Extra", "created_date", "lob_type", "billing_amount", "customer_email"]
    row = orders.first()
    assert row.created_date == datetime(2019, 7, 1, 10, 11, 12, 123456) and row.billing_amount == "$1,234.00"
    assert [tuple(r) for r in read_history(spark, str(folder / "history.csv"), "csv").collect()] == [
        ("ann@x.org", "ann@x.org*gs")
    ]


def test_headers_and_times(spark):
    df = spark.createDataFrame([("7/31/2019", "07/30/2019", "no date")], "`Sent Date` string, `A + B` string, c string")
    assert normalise_headers(df).columns == ["sent_date", "a_+_b", "c"]
    row = df.select(*[parse_time(F.col(f"`{c}`")) for c in df.columns]).first()
    assert tuple(row) == (day(31), day(30), None)


def test_lists_with_different_columns(spark, tmp_path):
    """Only the columns that matter are read, by name; a list that states no clicks does not hide those of others."""
    index = spark.createDataFrame([("One", "first"), ("Two", "second"), ("part-3", "third")], "long_name string, campaign string")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "One.csv").write_text("Recipient,Sent At (your time zone)\na@x.org,2019-07-01 08:00:00\n")
    (tmp_path / "csv" / "Two.csv").write_text("Note,Clicked,Recipient,Sent At (your time zone)\nn,true,B@x.org,2019-07-02 08:00:00\n")
    (tmp_path / "csv" / "part-3.csv").write_text("Recipient,Sent At (your time zone),Clicked\nc@x.org,2019-07-03 08:00:00,false\n")
    for name in ("One", "Two", "part-3"):
        one = spark.read.option("header", True).csv(str(tmp_path / "csv" / f"{name}.csv"))
        one.write.option("compression", "none").parquet(str(tmp_path / "parquet" / name))
    for fmt in ("csv", "parquet"):
        rows = read_touches(spark, str(tmp_path / fmt), index, fmt).orderBy("campaign").collect()
        assert [tuple(r) for r in rows] == [
            ("first", "a@x.org", day(1, 8), None), ("second", "b@x.org", day(2, 8), True), ("third", "c@x.org", day(3, 8), False),
        ]


def test_a_missing_list_is_an_error(spark, folder):
    index = spark.createDataFrame([("Second", "second"), ("Lost", "lost")], "long_name string, campaign string")
    with pytest.raises(FileNotFoundError, match="Lost"):
        read_touches(spark, str(folder / "lists"), index)


def test_a_list_of_many_files_is_named_once(spark, tmp_path):
    """Rows find their campaign by the list's name: what is looked up does not grow with the files, and a time is read once."""
    index = spark.createDataFrame([("A +b%", "a"), ("c", "c")], "long_name string, campaign string")
    (tmp_path / "A +b%").mkdir()
    for name in ("A +b%/part-1.csv", "A +b%/part-2.csv", "A +b%/c.csv", "c.csv"):
        (tmp_path / name).write_text("Recipient,Sent At (your time zone)\nX@x.org,7/1/2019\n")
    rows = read_touches(spark, str(tmp_path), index).where("sent_at IS NOT NULL")
    assert sorted(r.campaign for r in rows.collect()) == ["a", "a", "a", "c"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "part-1" not in plan and plan.count("try_make_timestamp_ntz") + plan.count("RLIKE") <= 2
