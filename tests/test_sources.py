import json

import pytest
from pyspark.sql import functions as F

from lyceum.operators import store
from lyceum.sources import tables as S


def test_targets_and_json(spark, tmp_path):
    rows = [{"name": "B College", "alias": ["BC"], "base_url": "https://b.example/", "admission_paths": ["a"], "placement_paths": [], "domain": "b.example"}, {"name": "A"}]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    out = S.targets(spark, f"file://{tmp_path}/t.json").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"]) for r in out] == [(1, "B College"), (2, "A")] and out[1]["alias"] is None
    (tmp_path / "broken.json").write_text("{")
    assert S.json_file(spark, f"file://{tmp_path}/broken.json", "name string").collect() == [(None,)]
    S.save_json(spark.range(2), f"file://{tmp_path}/out")
    assert S.json_file(spark, f"file://{tmp_path}/out/*.json").count() >= 1


def test_binary_files_and_pdf_lines(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = S.binary_files(spark, f"file://{tmp_path}", "*.pdf")
    assert [bytes(r["content"]) for r in files.collect()] == [b"one|two"]

    def reader(content):
        spans = [{"text": t, "x": 0.0, "y": 0.0, "font": "f", "size": 9.0, "flags": 0} for t in content.decode().split("|")]
        return [(1, [{"spans": spans}])]

    lines = S.pdf_lines(files, reader).select("page", F.explode("lines").alias("l")).collect()
    assert [s["text"] for s in lines[0]["l"]["spans"]] == ["one", "two"]
    with pytest.raises(NotImplementedError):
        S.pdf_lines(files)


def test_layout_of_a_store_prunes_its_scans(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    df = spark.range(1000).selectExpr("id", "concat('c', id % 50) AS college_name", "concat('t', id % 3) AS page_type")
    store.append(df.repartition(1), path, "page_type", sort_by=["college_name", "id"])
    found = store.scan(spark, path, page_type="t1", college_name="c7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "page_type#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(college_name,c7)" in plan
    assert sorted(r["id"] for r in found.collect()) == [k for k in range(1000) if k % 50 == 7 and k % 3 == 1]
    order = [r["college_name"] for r in spark.read.parquet(f"{path}/page_type=t1").select("college_name").collect()]
    assert order == sorted(order)


def test_dumps_of_positioned_text(spark, tmp_path):
    from lyceum.operators import layout

    span = {"text": "a", "origin": [1.5, 2.0], "font": "f", "size": 9.0, "flags": 2}
    good = {"path": "x.pdf", "page": 3, "blocks": [{"type": 0, "lines": [{"spans": [span]}, {}]}, {"type": 1, "image": "z"}, {"type": 0}]}
    (tmp_path / "d.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"path": "y.pdf", "page": 1}) + "\n")
    rows = {r["path"]: r for r in S.span_pages(spark, f"file://{tmp_path}/d.json").collect()}
    assert set(rows) == {"x.pdf", "y.pdf", None} and rows["y.pdf"]["blocks"] is None
    (first, second), *rest = rows["x.pdf"]["blocks"]
    assert first["spans"][0].asDict() == {"text": "a", "x": 1.5, "y": 2.0, "font": "f", "size": 9.0, "flags": 2} and second["spans"] == [] and rest == [[]]
    texts = S.span_pages(spark, f"file://{tmp_path}/d.json").select("path", layout.formatted(F.col("blocks")).alias("t"), layout.tables_of(F.col("blocks")).alias("n"))
    assert {r["path"]: (r["t"], r["n"]) for r in texts.collect()}["x.pdf"] == ("a\n\n", [])
