"""Bucketed stores, updates of one file, batches that land once, keyword tables, hooks, frontiers with a budget."""

import glob
import os
import shutil

import pytest

from pyspark.sql import functions as F

from lyceum.catalog import QUERIES
from lyceum.functions import classify, rx
from lyceum.functions import text as X
from lyceum.operators import crawl, keywords, layout, store
from lyceum.plans import hooks
from lyceum.streaming import landing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_stores_join_without_a_shuffle(spark, tmp_path):
    raw_path, done_path = f"file://{tmp_path}/raw", f"file://{tmp_path}/done"
    raw = spark.range(1000).selectExpr("CAST(id AS STRING) AS raw_id", "repeat('x', 100) AS html")
    for k in (0, 1):
        store.append_bucketed(raw.where(f"raw_id % 2 = {k}"), raw_path, "raw_id", 4)
    store.append_bucketed(spark.range(0, 1000, 3).selectExpr("CAST(id AS STRING) AS raw_data_id"), done_path, "raw_data_id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store.bucketed(spark, raw_path, "raw_id STRING, html STRING", "raw_id", 4)
        found = store.unprocessed(left, store.bucketed(spark, done_path, "raw_data_id STRING", "raw_data_id", 4))
        assert "Exchange" not in plan_of(found)
        assert "Exchange" not in plan_of(QUERIES["anti_unprocessed_bucketed"](spark, "/root/testdata/sf0.001"))
        assert sorted(int(r["raw_id"]) for r in found.collect()) == [k for k in range(1000) if k % 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lyceum_")]


def test_an_update_writes_one_file(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(300).selectExpr("id", "id % 3 AS kind", "CAST(NULL AS STRING) AS note", "CASE WHEN id % 7 = 6 THEN 'b' END AS mark")
    store.append(df.repartition(4, "id"), path, "kind", sort_by=["id"])

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/**/*.parquet", recursive=True)}

    before = files()
    assert store.update_in_place(spark, path, "mark = 'b' AND kind = 1", ["id"], note="seen")
    after = files()
    assert set(after) == set(before) and len([f for f in after if after[f] != before[f]]) == 1
    assert not glob.glob(f"{tmp_path}/t/_update-*")
    rows = {r["id"]: r["note"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 300 and {k: v for k, v in rows.items() if v} == {13: "seen"}
    assert store.update_in_place(spark, path, "mark = 'b' AND kind = 1 AND note IS NULL", ["id"], note="seen")
    assert {r["id"] for r in spark.read.parquet(path).where("note = 'seen'").collect()} == {13, 34}
    assert not store.update_in_place(spark, path, "mark = 'z'", ["id"], note="x")
    with pytest.raises(ValueError):
        store.update_in_place(spark, path, "mark = 'b'", ["id"], kind=5)


def test_batches_land_once(spark, tmp_path):
    source, target, notes = (f"{tmp_path}/{x}" for x in ("in", "out", "notes"))
    spark.range(10).write.parquet(source)
    calls = []

    def run():
        landing.follow_into(spark, f"file://{source}", "id long", f"file://{notes}", f"file://{target}", lambda df: calls.append(1) or df.selectExpr("id * 2 AS twice")).awaitTermination()

    run()
    rows = lambda: sorted(r["twice"] for r in spark.read.parquet(f"file://{target}").collect())
    assert rows() == list(range(0, 20, 2))
    spark.range(10, 15).write.mode("append").parquet(source)
    run()
    last = max(int(os.path.basename(f)) for f in glob.glob(f"{notes}/commits/[0-9]*"))
    for f in (f"{notes}/commits/{last}", f"{notes}/commits/.{last}.crc"):  # the driver died between the write and its note
        os.path.exists(f) and os.remove(f)
    run()
    assert rows() == list(range(0, 30, 2)) and len(calls) == 3
    shutil.rmtree(f"{target}/batch={last}")  # it died in the middle of the write: there is no marker
    os.makedirs(f"{target}/batch={last}")
    assert landing.land_once(spark.range(2).selectExpr("id AS twice"), last, f"file://{target}")
    assert not landing.land_once(spark.range(2).selectExpr("id AS twice"), last, f"file://{target}")


def test_keywords_as_a_table(spark):
    texts = [(1, "the fee, the FEE and fees"), (2, None), (3, ""), (4, "hostel é"), (5, "nothing")]
    words = [("fee",), ("fees",), ("the fee",), ("é",), ("",), (None,), ("fee",), ("absent",)]
    df, list_ = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(words, "word string")
    wanted = sorted((i, w) for i, t in texts for (w,) in set(words) if t is not None and w and w in t)
    for size in (1 << 20, 4):
        assert sorted(map(tuple, keywords.keyword_hits(df, "id", "text", list_, size).collect())) == wanted
    assert keywords.keyword_hits(df, "id", "text", list_.limit(0)).collect() == []


def test_hooks_answer_in_batches_and_may_fail(spark, tmp_path):
    seen = str(tmp_path)

    def ask(texts):
        name = f"{seen}/{texts[0]}"
        tries = sum(f.startswith(texts[0]) for f in os.listdir(seen))
        open(f"{name}-{tries}", "w").write(str(len(texts)))
        if texts[0] == "bad" or tries == 0 and texts[0] == "slow":
            raise RuntimeError("no answer")
        return [("placement", 0.9) if "x" in t else ("admission", 0.5) for t in texts]

    rows = [(1, "ax"), (2, "b"), (3, None), (4, "cx"), (5, "slow"), (6, "x"), (7, "bad"), (8, "x")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1).sortWithinPartitions("id")
    out = hooks.asked(df, "text", ask, batch=2, tries=2, wait=0.0).withColumn("kind", classify.verdict(F.col("verdict"), F.lit("rule")))
    assert {r["id"]: r["kind"] for r in out.collect()} == {1: "placement", 2: "rule", 3: "rule", 4: "placement", 5: "rule", 6: "placement", 7: "rule", 8: "rule"}
    assert sorted(f for f in os.listdir(seen) if f.startswith(("bad", "slow"))) == ["bad-0", "bad-1", "slow-0", "slow-1"]


def test_a_frontier_holds_its_budget_in_every_round(spark, monkeypatch):
    edges = [("s0", f"a{k:04}") for k in range(500)] + [(f"a{k:04}", f"b{k}-{j}") for k in range(500) for j in range(3)] + [("t0", "t1"), ("t1", "t2"), ("t2", "t0"), ("t2", "t3")]
    start = spark.createDataFrame([("S", "s0"), ("T", "t0"), ("T", "t0")], "site string, url string")
    sizes = []
    kept = type(start).checkpoint
    monkeypatch.setattr(type(start), "checkpoint", lambda self, *a: sizes.append(kept(self, *a)) or sizes[-1])
    found = crawl.frontier(start, spark.createDataFrame(edges, "url string, to string"), rounds=4, budget=50).collect()
    assert sorted(tuple(r) for r in found if r["site"] == "T") == [("T", "t0", 0), ("T", "t1", 1), ("T", "t2", 2), ("T", "t3", 3)]
    assert sorted(r["url"] for r in found if r["site"] == "S") == sorted(["s0", *(f"a{k:04}" for k in range(49))])
    rounds = [d.groupBy("site").count().collect() for d in sizes]
    assert all(r["count"] <= 50 for some in rounds for r in some) and not any(r["site"] == "S" for some in rounds[2:] for r in some)


def test_white_space_of_all_kinds_is_stripped(spark):
    values = ["2024-01-05\n", "\t2024-01-05", " 2024-01-05 ", "\x1c\r\n 2024-01-05　\x85", "2024-01-05", " ", "", None, "2024-01-05x"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    rows = df.select(F.date_format(X.parse_date(F.col("v")), "yyyy-MM-dd").alias("d"), rx.stripped(F.col("v")).alias("s"), X.clean(F.col("v")).alias("c")).collect()
    assert [r["d"] for r in rows] == ["2024-01-05"] * 5 + [None] * 4
    assert [r["s"] for r in rows] == [None if v is None else v.strip() for v in values]
    span = {"text": "\t a ", "x": 0.0, "y": 0.0, "font": "f", "size": 9.0, "flags": 2}
    lines = spark.createDataFrame([([{"spans": [span, span]}],)], "x array<struct<spans:array<struct<text:string,x:double,y:double,font:string,size:double,flags:int>>>>")
    assert lines.select(layout.as_table(F.col("x")).alias("t")).first()["t"]["raw_text"] == "a | a"


def test_clean_folds_then_drops_then_trims(spark):
    import re

    values = ["a \x01 b", "\x02  a  b\x7f ", "a\x1cb\x1f\x1e c", "\n\t", "x\x00\x00y", "a\x0b\x0c\r\nb", "é　　ü  ", None]
    wanted = [re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"\s+", " ", v or "")).strip(" ") for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(X.clean(F.col("v"))).collect()] == wanted
