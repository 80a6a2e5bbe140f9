"""Whole reports from files to files."""

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from toy import day, raw_order, raw_orders
from touchcredit import constants as C
from touchcredit.jobs import checked, main, run_clean, run_list, run_touch, run_window
from touchcredit.plans import ReportFolder, write_report

LISTS = {"A/1 Long": ("first", "both"), "B Long": ("second", "both"), "C Long": ("third", "alone")}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    rng = random.Random(1)
    rows = [
        raw_order(
            i, customer_email=f"U{rng.randrange(15)}@x.org", created_date=day(rng.randrange(1, 31)),
            lob_type=rng.choice(list(C.LINE_CODES)), billing_amount=f"${rng.randrange(1, 90)}.5000",
            priority=rng.choice(["Fast", None]), promotion_code=rng.choice(["FLASH1", "CODE2", None]),
            order_type=rng.choice(["t1", "t2", "other"]), institution=rng.choice(["Uni", "ACME"]),
        )
        for i in range(250)
    ]
    back = {v: k for k, v in C.ORDER_COLUMNS.items()}
    raw_orders(spark, rows).withColumnsRenamed(back).write.parquet(str(root / "raw"))
    spark.createDataFrame([("u1@x.org", "u1@x.org*gs")], "Email string, `Email + LoB` string").write.parquet(
        str(root / "history")
    )
    (root / "index.csv").write_text(
        "long_name,short_name,combined_name,sent_date,t1,t2\n"
        + "".join(f"{k},{s},{g},7/{5 * (i + 1)}/2019,x,{'x' if i else ''}\n" for i, (k, (s, g)) in enumerate(LISTS.items()))
    )
    (root / "lists").mkdir()
    for i, name in enumerate(LISTS):
        lines = ["Recipient,Sent At (your time zone),Clicked"]
        lines += [f"u{u}@X.org,2019-07-{5 * (i + 1):02d} 08:00:00,{'true' if u % 2 else 'false'}" for u in range(i, 12)]
        (root / "lists" / (name.replace("/", "") + ".csv")).write_text("\n".join(lines) + "\n")
    settings = {
        "orders": str(root / "raw"), "history": str(root / "history"), "index": str(root / "index.csv"),
        "lists": str(root / "lists"), "company": {"name": "Acme", "short": "ACM"},
    }
    clean = run_clean(spark, {"orders": str(root / "raw"), "company": "Acme"})
    paths = write_report(clean, str(root / "clean"))
    assert set(paths) == {"Raw", "Cleaned", "Ready", "Rejects", "Audit"}
    settings["orders"] = paths["Ready"]
    return root, settings


def test_cleaned_tables(spark, world):
    _, s = world
    ready = spark.read.parquet(s["orders"])
    assert ready.where("institution = 'ACME'").count() == 0 and dict(ready.dtypes)["billing_amount"] == "decimal(18,4)"


def test_list_report(spark, world):
    _, s = world
    out = run_list(spark, {**s, "start": "2019-07-03", "code_word": "flash", "source": "Summer"})
    opened, every = out["Open Email"], out["All Sources"]
    breakdown = {r.metric: r for r in out["Breakdown"].collect()}
    for source, rows in (("All Sources", every), ("Open Email", opened), ("Open & Click", out["Open and Click"])):
        total = rows.where("lob = 'sanger'").agg(F.sum("billing_amount")).first()[0]
        assert breakdown["Sanger_Revenue"][source] == float(total)
    metrics = out["Metrics"].collect()
    assert [r.recent_open for r in metrics] == ["first", "second", "third"] and len(metrics[0]) == 50
    assert metrics[0]["Return_Order"] + metrics[0]["NewToACM_Order"] == opened.where("recent_open = 'first'").count()
    types = {r[0] for r in out["New Customers"].select("New Customer Type").collect()}
    assert "New to Acme" in types


@pytest.mark.parametrize("kind", ["promotion", "research"])
def test_touch_report(spark, world, kind):
    _, s = world
    out = run_touch(spark, {**s, "kind": kind, "codes": ["CODE2"], "priorities": ["Fast"]})
    final, complete = out["Labelled"], out["Labelled Complete"]
    assert {r[0] for r in complete.select("recent_open").distinct().collect()} >= {None, "none_open", "first"}
    assert final.where("recent_open IS NULL OR recent_open = 'none_open'").count() == 0
    assert final.where("(new_to_company = 1) <> (new_to_lob IS NULL)").count() == 0
    combined = out["Metrics Combined"].collect()
    assert [r.combined_email for r in combined] == ["both", "alone"]
    for row in combined:
        part = final.where(F.col("combined_email") == row.combined_email)
        assert row["# of unique customers"] == part.select("customer_email").distinct().count()
    if kind == "promotion":
        assert len(out["Metrics"].columns) == 14 and len(out["Detail"].columns) == 9
        codes = out["Breakdown By Code"].collect()
        total = final.where("promotion_code = 'CODE2'").agg(F.sum("billing_amount")).first()[0]
        assert [(r[0], r[1]) for r in codes] == [("CODE2", float(total))]
        assert {r[0] for r in out["New Customers"].select("Campaign Source").collect()} <= {"first", "second", "third"}
    else:
        assert len(out["Metrics"].columns) == 50
        assert {r[0] for r in out["New Customers"].select("Campaign Source").collect()} <= {"both", "alone"}


def test_window_report_from_the_command_line(spark, world):
    root, s = world
    settings = {
        **s, "list": str(root / "lists" / "B Long.csv"), "source": "Regional", "sent_date": "7/10/2019",
        "scope_column": "priority", "scope_values": ["Fast"], "out": str(root / "window"), "out_format": "csv",
    }
    path = root / "settings.json"
    path.write_text(json.dumps(settings))
    main(["window", str(path)])
    rows = spark.read.option("header", True).option("inferSchema", True).csv(str(root / "window" / "metrics")).collect()
    labelled = spark.read.option("header", True).csv(str(root / "window" / "labelled"))
    assert len(rows) == 1 and rows[0]["# of Order"] == labelled.count() > 0
    assert run_window(spark, settings)["Metrics"].columns[0] == "# of Order"


def test_reports_by_submit(spark, world):
    """From files to files in a process of its own: large tables are written once, and nothing else is left."""
    root, s = world
    run_root = root / "submitted"
    run_root.mkdir()
    raw = str(root / "raw")
    jobs = {
        "clean": {"orders": raw, "company": "Acme", "out": str(run_root / "clean")},
        "touch": {**s, "orders": str(run_root / "clean" / "ready"), "out": str(run_root / "touch"), "priorities": ["Fast"]},
    }
    for report, settings in jobs.items():
        path = run_root / f"{report}.json"
        path.write_text(json.dumps(settings))
        job = Path(__file__).resolve().parent.parent / "touchcredit_job.py"
        done = subprocess.run(
            [sys.executable, str(job), report, str(path)], capture_output=True, text=True, cwd=run_root, timeout=300,
            env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"},
        )
        assert done.returncode == 0, done.stderr[-2000:]
    assert spark.read.parquet(str(run_root / "touch" / "metrics")).count() == 3
    whole = spark.read.parquet(str(run_root / "touch" / "labelled_complete"))
    assert whole.where("recent_open = 'none_open'").count() > 0
    written = {p.name for p in (run_root / "touch").iterdir()}
    assert {"labelled", "labelled_complete", "metrics", "new_customers", "revenue_breakdown", "detail"} <= written
    with pytest.raises(ValueError, match="priorities"):
        checked("touch", {k: v for k, v in jobs["touch"].items() if k != "priorities"})


def test_kept_tables_are_read_back(spark, tmp_path):
    folder = ReportFolder(str(tmp_path))
    df = folder.keep("All Rows", spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    assert write_report({"All Rows": df, "Sum": df.groupBy().sum("id")}, str(tmp_path), kept=folder) == {
        "All Rows": f"{tmp_path}/all_rows", "Sum": f"{tmp_path}/sum",
    }
    assert spark.read.parquet(f"{tmp_path}/all_rows").count() == 5
