from pyspark.sql import functions as F

from lyceum.operators import html as H
from lyceum.plans import extract

PAGE = """<html><head><title>Harbour</title><style>p {}</style></head><body><header><p>head</p></header><h1>Tide tables</h1>
<p>High water comes late this week</p><p><b>a</b> b<ul><li>one<p>two</li></ul>
<table><tr><th>Port</th><th>Depth</th></tr><tr><td>Nore</td><td>7</td></tr><tr><td>Lune</td><td>4</td><td>mud</td></tr></table>
<a href="https://tides.example/next">Next week</a><a href="#">x</a><a href="javascript:y">y</a><a href="#top">t</a>
<a href="mailto:a@b.c">m</a><img src="i.png" alt="Chart"><img src="s.png" alt="chart" width="20"></body></html>"""


def test_all_fields_of_a_page():
    page = H.read_page(PAGE)
    assert page["text"].split("\n")[:2] == ["Tide tables", "High water comes late this week"]
    (table,) = page["tables"]
    assert table["headers"] == ["Port", "Depth"] and table["raw_rows"] == [["Nore", "7"], ["Lune", "4", "mud"]]
    assert {"href": "https://tides.example/next", "text": "Next week"} in page["links"]
    assert page["images"] == ["i.png"]
    for name in H.FIELDS:
        assert H.read_page(PAGE, (name,)) == {name: page[name]}


def test_text_rules():
    assert H.read_page("<p><b>a</b> b</p>")["text"] == "ab"
    assert H.read_page("<li>x<p>y</p></li>")["text"] == "xy\ny"
    assert H.read_page("plain <i>text</i>")["text"] == "plain\ntext"
    assert H.read_page("<body><p>a</p><div class='x content'><p>b</p></div></body>")["main_text"] == "b"
    assert H.read_page("<main><p>m</p></main><article><p>a</p></article>")["main_text"] == "m"
    assert "head" not in H.read_page(PAGE)["text"]
    assert H.read_page("<script>s</script><!-- c -->t")["plain"] == "t"
    assert H.read_page(None) is None and H.read_page("")["text"] == ""


def test_tables_without_th_use_their_first_row():
    assert H.table_cells(H.tree("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>")[0].find_all("table")[0]) == (["a"], [["b"]])
    assert H.read_page("<table><tr><td>a</td></tr></table>")["tables"][0]["raw_rows"] == []


def test_links_and_rows(spark):
    df = spark.createDataFrame([(1, "https://test.com/x/", PAGE), (2, "http://a/", None)], "page_id long, url string, html string")
    pages = H.parse_pages(df)
    assert [r["url"] for r in H.links(pages, "page_id").orderBy("place").collect()] == [
        "https://tides.example/next", "https://test.com/x/#top", "mailto:a@b.c",
    ]
    assert [r["url"] for r in H.crawl_links(pages, "page_id").collect()] == ["https://tides.example/next"]
    rows = pages.select(F.explode(F.flatten(F.transform(H.data_tables(F.col("page")), H.table_rows))).alias("r")).collect()
    assert rows[1]["r"] == {"Port": "Lune", "Depth": "4", "column_3": "mud"}


def test_one_parse_per_page(spark):
    df = spark.createDataFrame([(1, "https://test.com/", PAGE)], "page_id long, url string, html string")
    raw = extract.raw_pages(df, F.lit("c"), F.lit("2024-01-01").cast("timestamp"), "s")
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    children = extract.embedded(raw).collect()
    assert [(r["raw_id"], r["parent_id"], r["page_type"]) for r in children] == [("1-0", "1", "table")]


def parses(df):
    """How often the plan that runs evaluates the parser: links are resolved by another UDF."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [read(")


def test_one_parse_per_page_where_items_become_rows(spark):
    df = spark.createDataFrame([(1, "https://test.com/", PAGE)], "page_id long, url string, html string")
    pages = H.parse_pages(df)
    for found in (H.links, H.crawl_links, H.file_links, H.image_links, H.table_documents):
        assert parses(found(pages, "page_id")) == 1, found.__name__
    raw = extract.raw_pages(df, F.lit("c"), F.lit("2024-01-01").cast("timestamp"), "s")
    assert parses(raw) == parses(extract.embedded(raw)) == 1


def test_process_reads_tables_of_html_only(spark):
    table = "<html><body><table><tr><th>Course</th></tr><tr><td>Law</td></tr></table></body></html>"
    rows = [("1", "c", "admission", table), ("2", "c", "admission", "Course: Law"), ("3", "c", "placement", "x"), ("4", "d", "admission", "y")]
    raw = spark.createDataFrame(rows, "raw_id string, college_name string, page_type string, raw_content string")
    done = spark.createDataFrame([("9",)], "raw_data_id string")
    a, p = extract.process(raw, done, F.lit("2024-01-01").cast("timestamp"), name="c")
    out = {r["raw_data_id"]: [c["name"] for c in r["admission_data"]["courses_offered"]] for r in a.collect()}
    assert out == {"1": ["Law"], "2": []} and p.count() == 1
