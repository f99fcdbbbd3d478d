import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from framevitals.functions.net import is_local
from framevitals.operators import drift, text, validation
from framevitals.plans.report import full_report, quick_report
from framevitals.sources import csv, reports
from framevitals.sources.scratch import fresh_path
from framevitals.streaming.profile import append_stream, long_form, profile_stream, running_counts


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('v,w,b\nNA,1,True\nn/a,2,False\nnull,x,true\n,"q, ""z""",false\n1.5,,True\n')
    df = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"v": "double", "w": "string", "b": "boolean"}
    assert [r["v"] for r in df.collect()] == [None, None, None, None, 1.5]
    assert [r["w"] for r in df.collect()] == ["1", "2", "x", 'q, "z"', None]


def test_validate_source(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "plain.csv").write_text("a\n1\n")
    (tmp_path / "other.txt").write_text("a,b\n")
    got = {r["name"]: r for r in csv.validate_source(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got["good.csv"]["ok"] and got["good.csv"]["ragged_lines"] == 1
    assert got["plain.csv"]["reason"] == "no comma in the file" and got["other.txt"]["reason"] == "wrong suffix"


def test_every_file_is_judged(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "long.csv").write_text("a,b\n1,2\n1,2,3\n4,5\n")
    (tmp_path / "quoted one.csv").write_text('a,b\n1,"x,y"\n2,"over, and\nover, two, lines"\n3,z\n')
    got = {r["name"].replace("%20", " "): r for r in csv.validate_source(spark, str(tmp_path)).collect()}
    assert got["empty.csv"]["reason"] == "empty file" and got["empty.csv"]["lines"] == 0
    assert got["blank.csv"]["reason"] == "no lines"
    assert got["long.csv"]["reason"] == "lines longer than the header" and got["long.csv"]["long_lines"] == 1
    assert got["quoted one.csv"]["ok"] and got["quoted one.csv"]["long_lines"] == 0


def test_damaged_report(spark, tmp_path):
    path = str(tmp_path / "reports")
    reports.save_report(quick_report(spark.range(5).toDF("a")), path, "x")
    (tmp_path / "reports" / "dataset_id=x" / "section=summary" / "half.json").write_text('{"item": "da\n[1, 2\n{"num": "many", "metric": "m"}\n')
    (tmp_path / "reports" / "dataset_id=y" / "section=summary").mkdir(parents=True)
    (tmp_path / "reports" / "dataset_id=y" / "section=summary" / "half.json").write_text("no json\n")
    got = {r["metric"]: r for r in reports.load_report(spark, path, "x").collect()}
    assert got["rows"]["num"] == 5.0 and got["damaged_lines"]["num"] == 3.0
    rows = reports.load_report(spark, path, "y").collect()
    assert {r["txt"] for r in rows} == {"processing", None} and {r["num"] for r in rows} == {None, 1.0}


def test_export_and_preview(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.export_clean(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    df = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    df.write.parquet(str(tmp_path / "clean"))
    csv.export_clean(spark, str(tmp_path / "clean"), str(tmp_path / "out"))
    assert csv.read_csv(spark, str(tmp_path / "out")).count() == 2
    assert [tuple(r) for r in csv.preview(df, 5, ["a"]).collect()] == [("1", "x"), ("2", "")]
    assert csv.head_rows(df, 1, ["a"]).first()["a"] == 1 and csv.sample_rows(df, 10).count() == 2


def test_reports(spark):
    path = fresh_path(spark, "reports")
    assert reports.load_report(spark, path, "x").first()["txt"] == "processing"
    df = spark.range(10).selectExpr("id", "id % 2 as y")
    reports.save_report(quick_report(df), path, "x")
    reports.save_report(quick_report(df.limit(5)), path, "x")
    rows = {r["metric"]: r["num"] for r in reports.load_report(spark, path, "x").collect()}
    assert rows["rows"] == 5.0
    assert reports.load_report(spark, path, "y").first()["txt"] == "processing"
    assert reports.as_document(reports.load_report(spark, path, "x")).count() == 1


def test_full_report_without_target(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 3 as string) as s")
    sections = {r["section"] for r in full_report(df).collect()}
    assert {"summary", "column", "quality", "ml_readiness", "leakage", "stats_numeric"} <= sections
    assert "imbalance" not in sections


def test_is_local_like_the_standard_library(spark):
    rng = random.Random(3)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "198.18.0.0/15", "100.64.0.0/10", "240.0.0.0/4"):
        n = ipaddress.ip_network(net)
        ips += [str(n[0]), str(n[-1]), str(n[0] - 1), str(n[-1] + 1) if int(n[-1]) < 2**32 - 1 else str(n[-1])]
    for net in ("fc00::/7", "fe80::/10", "2001:db8::/32", "2002::/16", "100::/64", "2001::/23", "::1/128", "::/128"):
        n = ipaddress.ip_network(net)
        ips += [str(n[0]), str(n[-1]), str(n[-1] + 1), n[0].exploded]
    ips += ["192.0.0.9", "192.0.0.10", "192.0.0.8", "::ffff:0808:0808", "::ffff:8.8.8.8", "::FFFF:10.1.1.1", "::ffff:c0a8:1", "2001:1::1", "2606:4700::1111"]
    ips += ["localhost", "", "x", "1.2.3", "256.1.1.1", "010.1.1.1", "1::2::3", ":1", "1:2:3:4:5:6:7", "::", "12345::1"]

    def want(ip):
        if ip in ("", "localhost"):
            return True
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return True
        return a.is_private or a.is_loopback

    df = spark.createDataFrame([(ip,) for ip in ips] + [(None,)], "ip string")
    got = {r["ip"]: r["local"] for r in df.select("ip", is_local(F.col("ip")).alias("local")).collect()}
    assert got.pop(None) is True
    assert {ip for ip in got if got[ip] != want(ip)} == set()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(900).selectExpr("id", "if(id % 4 = 0, null, id * 1D) as v", "if(id % 5 = 0, double('NaN'), 1D) as w")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, spark.read.parquet(profile_stream(stream)).collect()))
    want = sorted(map(tuple, long_form(running_counts(df), df.columns).collect()))
    assert got == want and ("w", 900, 180, 20.0) in got


def test_audit_stream_appends(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    append_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"))  # nothing new: nothing appended
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10


def test_text_and_validation(spark, one):
    df = spark.createDataFrame([(" a\t\tb\x01 ",), ("ok",), ("bad�",), (None,)], "t string")
    assert [r["t"] for r in text.text_clean(df).collect()] == ["a b", "ok", "bad�", None]
    issues = one(text.text_issues(df))["t"]
    assert (issues["padded"], issues["spaced"], issues["control"], issues["replacement"]) == (1, 1, 1, 1)
    got = one(validation.schema_check(df, "t int, u int"))
    assert (got["t"]["status"], got["t"]["misfits"], got["u"]["status"]) == ("type", 3, "missing")
    rules = one(validation.range_check(spark.range(10).toDF("v"), {"v": (2, 7)}))["v"]
    assert (rules["below"], rules["above"], rules["violations"], rules["ratio"]) == (2, 2, 4, 0.4)


def test_drift(spark, one):
    a = spark.range(1000).selectExpr("id * 1D as v", "'x' as s")
    b = spark.range(1000).selectExpr("id * 3D as v", "if(id % 2 = 0, 'x', 'y') as s")
    same, moved = one(drift.drift_psi(a, a)), one(drift.drift_psi(a, b))
    assert same["v"]["psi"] == 0.0 and same["v"]["band"] == "stable"
    assert moved["v"]["band"] == "drifted" and moved["s"]["band"] == "drifted"
    diff = one(drift.version_diff(a, b.drop("s")))
    assert diff["s"]["status"] == "removed" and diff["v"]["status"] == "same"
    assert drift.schema_diff(a, b.drop("s")).count() == 1
