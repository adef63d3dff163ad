"""All registered queries of the extraction engine and their SQL: name -> (spark, sf_dir) -> DataFrame.

Extractors are run on text and tables rendered from relational rows, so that the SQL is those rows themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.functions import admission as A
from lyceum.functions import classify as C
from lyceum.functions import fixed
from lyceum.functions import placement as P
from lyceum.functions import text as X
from lyceum.functions import url as U
from lyceum.operators import crawl, keywords, layout, store
from lyceum.operators import html as H
from lyceum.plans import extract
from lyceum.session import shared_folder
from lyceum.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that become large pages or texts, by key in as many tasks as the session's partitions: the few MB of a file are one
    task otherwise, however long their pages take."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def joined(*parts: str | Column) -> Column:
    return F.concat(*map(text, parts))


def no_tables() -> Column:
    return F.array().cast(schemas.NO_TABLES)


def one_table(headers: list[str], rows: Column) -> Column:
    """A single table of these headers and rows of cells."""
    head = F.array(*map(F.lit, headers)).cast("array<string>")
    t = F.struct(F.lit(0).alias("table_index"), head.alias("headers"), rows.alias("raw_rows"), F.lit("").alias("text"))
    return F.array(t).cast(schemas.NO_TABLES)


# --- pages -----------------------------------------------------------------------------------------------------------
STRIP = r"""regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"""


def sql_hits(words: list[str], value: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({value}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


SQL_TYPED = f"""
SELECT page_id, CASE WHEN ai > pi OR ak > pk THEN 'admission' WHEN pi > ai OR pk > ak THEN 'placement' ELSE 'general' END AS page_type
FROM (SELECT page_id, {sql_hits(fixed.ADMISSION_INDICATORS, "t")} AS ai, {sql_hits(fixed.PLACEMENT_INDICATORS, "t")} AS pi,
             {sql_hits(fixed.ADMISSION_KEYWORDS, "t")} AS ak, {sql_hits(fixed.PLACEMENT_KEYWORDS, "t")} AS pk
      FROM (SELECT page_id, lower({STRIP}) AS t FROM pages))"""


def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = H.parse_pages(table(spark, sf_dir, "pages"), "plain")
    return pages.select("page_id", "url", C.page_type(F.col("page.plain")).alias("page_type"))


@query(f"SELECT page_type, count(*) AS n FROM ({SQL_TYPED}) GROUP BY page_type")
def page_type_count(spark, sf_dir):
    return store.type_counts(typed_pages(spark, sf_dir))


@query(SQL_TYPED)
def page_type_classify(spark, sf_dir):
    return typed_pages(spark, sf_dir).drop("url")


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  length(regexp_replace({}, '[\s\x0b]+', '', 'g')) AS n_visible FROM pages""".format(STRIP))
def page_title_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    visible = F.length(F.regexp_replace(H.stripped_text(F.col("html")), r"\s+", "")).cast("long")
    return pages.select("page_id", title.alias("title"), visible.alias("n_visible"))


@query()
def page_main_text(spark, sf_dir):
    """Text, main text, tables and images of every page, by the parser; checked by unit tests."""
    pages = H.parse_pages(table(spark, sf_dir, "pages"), "text", "main_text", "tables", "images")
    return pages.select(
        "page_id", F.col("page.text").alias("text"), F.col("page.main_text").alias("main_text"),
        F.size("page.tables").cast("long").alias("n_tables"), F.size("page.images").cast("long").alias("n_images"),
    )


SQL_LINKS = r"""SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]+)"', 1)) AS href FROM pages"""
SQL_ROOT = "regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0)"


@query(f"""SELECT page_id, {SQL_ROOT} || href AS link, count(*) AS n FROM ({SQL_LINKS})
WHERE NOT starts_with(href, 'javascript:') AND href <> '#' GROUP BY 1, 2""")
def link_extract(spark, sf_dir):
    pages = H.parse_pages(table(spark, sf_dir, "pages"), "links")
    return H.links(pages, "page_id").groupBy("page_id", F.col("url").alias("link")).agg(F.count("*").alias("n"))


SQL_ADMISSION = "|".join(f"(?:{p})" for p in fixed.ADMISSION_PATHS)
SQL_PLACEMENT = "|".join(f"(?:{p})" for p in fixed.PLACEMENT_PATHS)


@query(f"""SELECT page_id, link, CASE WHEN regexp_matches(lower(link_path), '{SQL_PLACEMENT}') THEN 'placement'
  WHEN regexp_matches(lower(link_path), '{SQL_ADMISSION}') THEN 'admission' ELSE 'general' END AS page_type
FROM (SELECT DISTINCT page_id, {SQL_ROOT} || href AS link, regexp_extract(href, '^[^?#]*', 0) AS link_path
      FROM ({SQL_LINKS}) WHERE NOT starts_with(href, 'javascript:') AND NOT starts_with(href, '#'))
WHERE NOT regexp_matches(lower(link_path), '\\.(pdf|docx?|xlsx?|jpe?g|png|gif)$')""")
def link_filter_typed(spark, sf_dir):
    pages = H.parse_pages(table(spark, sf_dir, "pages"), "links")
    sites = table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("site"))
    kept = crawl.page_links(H.crawl_links(pages, "page_id").join(sites, "page_id"), F.col("site"), F.lit("general"))
    return kept.select("page_id", F.col("url").alias("link"), "page_type").distinct()


@query("""SELECT url FROM (SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/x' END AS url FROM pages) q
WHERE EXISTS (SELECT 1 FROM pages p WHERE p.url = q.url)""")
def url_exists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = F.when(F.pmod("page_id", F.lit(2)) == 0, F.col("url")).otherwise(joined(F.col("url"), "/x"))
    return store.exists_among(pages.select(asked.alias("url")), pages)


SQL_FILES = """SELECT p_partkey, 'https://files.example/' || p_partkey || '.' ||
  (['pdf','doc','xlsx','csv','PNG','html'])[1 + p_partkey % 6] AS link FROM part"""


@query(f"""SELECT p_partkey, t AS file_type, CASE t WHEN 'pdf' THEN 'application/pdf' WHEN 'doc' THEN 'application/msword'
  WHEN 'xlsx' THEN 'application/vnd.ms-excel' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS content_type
FROM (SELECT p_partkey, lower(regexp_extract(link, '[.]([^.]*)$', 1)) AS t FROM ({SQL_FILES})) WHERE t <> 'html'""")
def file_links_mime(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["pdf", "doc", "xlsx", "csv", "PNG", "html"]))
    key = F.col("p_partkey")
    link = joined("https://files.example/", key, ".", F.get(kinds, F.pmod(key, F.lit(6)).cast("int")))
    files = table(spark, sf_dir, "part").select("p_partkey", link.alias("url")).where(U.is_allowed_file(F.col("url")))
    kind = U.file_type(F.col("url"))
    return files.select("p_partkey", kind.alias("file_type"), U.mime_type(kind).alias("content_type"))


# --- targets ---------------------------------------------------------------------------------------------------------
SQL_TARGETS = """SELECT row_number() OVER (ORDER BY n_nationkey) AS ordinal, n_name AS name,
  [upper(left(n_name, 3)), 'Univ ' || n_name] AS alias, 'https://' || lower(n_name) || '.example/' AS base_url FROM nation"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    alias = F.array(F.upper(F.substring(name, 1, 3)), joined("Univ ", name))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", name.alias("name"), alias.alias("alias"), joined("https://", F.lower(name), ".example/").alias("base_url"),
        F.array(F.lit("admissions"), F.lit("pg-admissions")).alias("admission_paths"), F.array(F.lit("placement")).alias("placement_paths"),
        joined(F.lower(name), ".example").alias("domain"),
    )


@query(f"SELECT ordinal, name, base_url FROM ({SQL_TARGETS})")
def target_list(spark, sf_dir):
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("n_nationkey")).cast("long")  # a catalogue: tens of rows
    return targets(spark, sf_dir).select(number.alias("ordinal"), "name", "base_url")


@query("SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'n_1')")
def name_contains(spark, sf_dir):
    return crawl.by_name(targets(spark, sf_dir), "N_1").select("name")


@query(f"SELECT name FROM ({SQL_TARGETS}) WHERE contains(lower(name), 'univ n') OR contains(lower(array_to_string(alias, '|')), 'univ n')")
def name_or_alias(spark, sf_dir):
    return crawl.by_name_or_alias(targets(spark, sf_dir), "UNIV N").select("name")


@query(f"""SELECT name, CAST(i AS BIGINT) AS place, (['general','admission','admission','placement'])[i + 1] AS page_type,
  base_url || (['','admissions','pg-admissions','placement'])[i + 1] AS url FROM ({SQL_TARGETS}), range(0, 4) r(i)""")
def seed_urls(spark, sf_dir):
    return crawl.seeds(targets(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH RECURSIVE edges AS (SELECT DISTINCT url, {SQL_ROOT} || href AS link FROM ({SQL_LINKS})
    WHERE NOT starts_with(href, 'javascript:') AND NOT starts_with(href, '#')),
  walk AS (SELECT regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS site, min(url) AS url, 0 AS depth FROM pages GROUP BY 1
    UNION SELECT site, link, depth + 1 FROM walk JOIN edges USING (url) WHERE depth < 3),
  nearest AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url)
SELECT site, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS r FROM nearest) WHERE r <= 50""")
def crawl_frontier(spark, sf_dir):
    """Pages within three links of each site's first page, 50 at most a site."""
    pages = table(spark, sf_dir, "pages")
    found = H.crawl_links(H.parse_pages(pages, "links"), "page_id").withColumnRenamed("url", "to")
    edges = found.join(pages.select("page_id", "url"), "page_id").select("url", "to").distinct()
    first = pages.groupBy(U.domain(F.col("url")).alias("site")).agg(F.min("url").alias("url"))
    return crawl.frontier(first, edges)


SQL_PAGE = "'K' || o_orderkey || '/' || o_custkey"


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: menus to leave out, a part with the content, open paragraphs, nested lists, links and images."""
    key = joined("K", F.col("o_orderkey"), "/", F.col("o_custkey"))
    html = joined(
        "<html><head><title>T</title><script>var s = '<p>no</p>';</script></head><body><nav><p>menu</p></nav><header><h1>top</h1></header>"
        "<p>outside</p><div class='wide content'><h2>Order ", key, "</h2><p>first ", F.col("o_orderstatus"), "<p>second <b>&amp;</b> part</p></p>"
        "<ul><li>one<ul><li>inner</li></ul></li></ul><a href='files/", F.col("o_orderkey"), ".PDF'>f</a><a href='/x/list.xlsx?v=1'>x</a>"
        "<a href='page.html'>p</a></div><img src='chart.png' alt='Chart'><img src='icon.png' alt='chart' width='20'>"
        "<table class='t'><tr><td><span>Placement</span><img src='/p.png'></td></tr></table><footer><p>foot</p></footer></body></html>",
    )
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey").select(
        "o_orderkey", joined("https://h.example/a/", F.col("o_custkey"), "/").alias("url"), html.alias("html")
    )


@query(f"""SELECT o_orderkey, concat_ws(chr(10), 'outside', m) AS text, m AS main_text FROM (SELECT o_orderkey, concat_ws(chr(10),
  'Order ' || {SQL_PAGE}, 'first ' || o_orderstatus || 'second&part', 'second&part', 'oneinner', 'inner') AS m FROM orders)""")
def page_texts(spark, sf_dir):
    pages = H.parse_pages(order_pages(spark, sf_dir), "text", "main_text")
    return pages.select("o_orderkey", F.col("page.text").alias("text"), F.col("page.main_text").alias("main_text"))


@query("""SELECT o_orderkey, 'https://h.example/a/' || o_custkey || '/files/' || o_orderkey || '.PDF' AS link, 'pdf' AS file_type,
  'application/pdf' AS content_type FROM orders""")
def page_file_links(spark, sf_dir):
    found = H.file_links(H.parse_pages(order_pages(spark, sf_dir), "links"), "o_orderkey")
    return found.select("o_orderkey", F.col("url").alias("link"), "file_type", "content_type")


@query("""SELECT o_orderkey, 'https://h.example/a/' || o_custkey || '/chart.png' AS link FROM orders
UNION ALL SELECT o_orderkey, 'https://h.example/p.png' FROM orders""")
def page_data_images(spark, sf_dir):
    found = H.image_links(H.parse_pages(order_pages(spark, sf_dir), "images"), "o_orderkey")
    return found.select("o_orderkey", F.col("url").alias("link"))


@query("""SELECT o_orderkey, 'kept ' || o_orderstatus || chr(10) || 'after' AS text, CAST(NULL AS VARCHAR) AS error, CAST(3 AS BIGINT) AS odd,
  CASE WHEN o_custkey % 2 = 0 THEN 'chart.png' ELSE NULL END AS image FROM orders""")
def page_broken_markup(spark, sf_dir):
    """Pages with a broken marked section, an end tag without its element and a width that is no number: rows like all others."""
    width = F.when(F.pmod("o_custkey", F.lit(2)) == 0, "²").otherwise("20")
    html = joined(
        "<p>kept ", F.col("o_orderstatus"), "</p><![foo[x]]></div><img src='chart.png' alt='Chart' width='", width, "'><p>after</p>",
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "<!-- never <!--").otherwise("<"),
    )
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    pages = H.parse_pages(orders.withColumn("html", html), "text", "images", "error", "odd")
    return pages.select("o_orderkey", "page.text", "page.error", "page.odd", F.get("page.images", F.lit(0)).alias("image"))


@query("""SELECT o_orderkey, CAST(i AS INTEGER) AS table_index,
  (['<table class="grid"><tr><td title="a &amp; b">' || o_orderkey || '<table><tr><td>' || o_orderstatus || ' &lt;x&gt;<br/></td></tr></table></td></tr></table>',
    '<table><tr><td>' || o_orderstatus || ' &lt;x&gt;<br/></td></tr></table>'])[i + 1] AS html,
  (['' || o_orderkey || chr(10) || o_orderstatus || ' <x>', o_orderstatus || ' <x>'])[i + 1] AS text FROM orders, range(0, 2) r(i)""")
def page_table_html(spark, sf_dir):
    """The markup of every table of a page, nested and unclosed ones too."""
    html = joined(
        "<p>x<TABLE class='grid'><tr><td title='a & b'>", F.col("o_orderkey"), "<table><tr><td>", F.col("o_orderstatus"), " &lt;x><br></table></td>",
    )
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    pages = H.parse_pages(orders.withColumn("html", html), "tables", "table_html")
    return H.table_documents(pages, "o_orderkey").select("o_orderkey", "table_index", "html", "text")


# --- store -----------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def scan_filter(spark, sf_dir):
    found = store.scan(spark, f"{sf_dir}/lineitem.parquet", l_returnflag="R", l_linestatus="F")
    return found.select("l_orderkey", "l_partkey", "l_quantity")


def raw_and_processed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return orders.withColumnRenamed("o_orderkey", "raw_id"), lines.select(F.col("l_orderkey").alias("raw_data_id"))


@query("""SELECT o_orderkey AS raw_id, o_orderpriority FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def anti_unprocessed(spark, sf_dir):
    return store.unprocessed(*raw_and_processed(spark, sf_dir)).select("raw_id", "o_orderpriority")


@query("""SELECT o_orderstatus, count(*) AS n FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') GROUP BY o_orderstatus""")
def semi_processed_count(spark, sf_dir):
    found = store.processed_only(*raw_and_processed(spark, sf_dir))
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
AND l_returnflag = 'R')) AS processed FROM orders o""")
def dry_run_progress(spark, sf_dir):
    return store.progress(*raw_and_processed(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey AS parent_custkey FROM lineitem
JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45""")
def parent_child_join(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("raw_id"), F.col("o_custkey").alias("custkey"))
    children = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    both = store.with_parent(children, parents, F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "parent_custkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r
FROM orders) WHERE r = 1""")
def latest_per_college(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 5")
def inspect_top5(spark, sf_dir):
    return extract.inspect(table(spark, sf_dir, "orders"), "o_orderpriority", 5, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""SELECT l_orderkey, unnest(list_sort(list_distinct(list(l_partkey)))[1:3]) AS l_partkey FROM lineitem GROUP BY l_orderkey""")
def array_head(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    return lists.select("l_orderkey", F.explode(F.slice("parts", 1, 3)).alias("l_partkey"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O') THEN 'X'
ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def update_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = store.updated_first(orders, F.col("o_orderstatus") == "O", ["o_orderkey"], o_orderstatus="X")
    return out.select("o_orderkey", "o_orderstatus")


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lyceum-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey, o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 < 2) GROUP BY 1, 2""")
def append_twice(spark, sf_dir):
    """Two appends to one partitioned store, read again: equal rows are there twice."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), fresh(spark)
    third = F.pmod("o_orderkey", F.lit(3))
    store.append(orders.where(third > 0), path, "o_orderstatus")
    store.append(orders.where(third < 2), path, "o_orderstatus")
    found = store.scan(spark, path, "o_orderkey long, o_orderstatus string")
    return found.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS raw_id, o_orderpriority FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def anti_unprocessed_bucketed(spark, sf_dir):
    """Raw and processed rows in stores with the same buckets, the processed ones in two appends: neither side is shuffled."""
    raw, done = raw_and_processed(spark, sf_dir)
    raw_path, done_path, buckets = fresh(spark), fresh(spark), 16
    store.append_bucketed(raw.select("raw_id", "o_orderpriority"), raw_path, "raw_id", buckets)
    half = F.pmod("raw_data_id", F.lit(2)) == 0
    for some in (half, ~half):
        store.append_bucketed(done.where(some), done_path, "raw_data_id", buckets)
    raw = store.bucketed(spark, raw_path, "raw_id BIGINT, o_orderpriority STRING", "raw_id", buckets)
    return store.unprocessed(raw, store.bucketed(spark, done_path, "raw_data_id BIGINT", "raw_data_id", buckets))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority = '2-HIGH')
THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def update_in_place(spark, sf_dir):
    """The first urgent order set anew in a stored, partitioned table; only the file that holds it is written."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), fresh(spark)
    store.append(orders.repartition(8), path, "o_orderstatus", sort_by=["o_orderkey"])
    store.update_in_place(spark, path, "o_orderpriority = '2-HIGH'", ["o_orderkey"], o_orderpriority="X")
    return store.scan(spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, [lower(n_name), 'é \" ' || n_name] AS alias FROM nation")
def json_round_trip(spark, sf_dir):
    nation, path = table(spark, sf_dir, "nation"), fresh(spark)
    alias = F.array(F.lower("n_name"), joined('é " ', F.col("n_name")))
    tables.save_json(nation.select(F.col("n_nationkey").cast("long"), F.col("n_name").alias("name"), alias.alias("alias")), path)
    return tables.json_file(spark, path, "n_nationkey long, name string, alias array<string>", lines=True)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS raw_data_id, strftime(o_orderdate, '%d/%m/%Y') AS fact FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0""")
def process_one_college(spark, sf_dir):
    """Raw documents of one college only, by its name exactly as written."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    raw = orders.select(
        key.alias("raw_id"), F.when(F.col("o_orderstatus") == "O", "College O").otherwise("college o").alias("college_name"),
        F.lit("admission").alias("page_type"), deadline_text().alias("raw_content"),
    )
    done = orders.where(F.pmod("o_orderkey", F.lit(3)) == 0).select(key.alias("raw_data_id"))
    found, _ = extract.process(raw, done, F.lit("2024-01-01").cast("timestamp"), "College O")
    return found.select("raw_data_id", F.get(F.col("admission_data.application_deadlines"), F.lit(0))["date_str"].alias("fact"))


@query("""SELECT o_orderkey, o_orderkey % 3 <> 2 AS is_html, CASE o_orderkey % 3 WHEN 2 THEN '<HTML><p>' || o_custkey ELSE o_custkey::VARCHAR END AS text FROM orders""")
def content_sniffed(spark, sf_dir):
    """Contents are parsed where they hold an html or body tag in lower case; others are text as they are."""
    kind, customer = F.pmod("o_orderkey", F.lit(3)), F.col("o_custkey")
    content = F.when(kind == 0, joined("<html><p>", customer)).when(kind == 1, joined("x <body class='c'><p>", customer, "</body>")).otherwise(joined("<HTML><p>", customer))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    found, _ = extract.content_parts(F.col("content"), orders)
    return orders.select("o_orderkey", H.is_html(F.col("content")).alias("is_html"), found.alias("text"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || ',"tags":["a\\"b",null]}' AS doc FROM nation""")
def json_dump(spark, sf_dir):
    doc = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.array(F.lit('a"b'), F.lit(None)).alias("tags"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(doc).alias("doc"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'chart' WHEN doc_id % 5 = 0 THEN 'table' WHEN len(regexp_extract_all(text, '[^\\s\\x0b]+')) > 30 THEN 'text'
  ELSE 'photo' END AS kind FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, 'unknown' FROM documents WHERE doc_id % 11 = 0""")
def image_types(spark, sf_dir):
    """Kinds of images by what a model saw in them: here flags from ids, and the documents' texts as what was read."""
    key, seen = F.col("doc_id"), F.pmod("doc_id", F.lit(11)) != 0
    chart, has_table = (F.when(seen, F.pmod(key, F.lit(n)) == 0) for n in (7, 5))
    return documents(spark, sf_dir).select("doc_id", C.image_type(chart, has_table, F.when(seen, F.col("text"))).alias("kind"))


@query("""SELECT page_id, k::BIGINT AS k, k < 3 AS inside FROM pages, range(0, 5) r(k)""")
def links_relative_to(spark, sf_dir):
    """Links that stay within a domain: relative ones, its own and its subdomains; not domains that merely end alike."""
    site = U.domain(F.col("url"))
    urls = F.array(F.lit("/a/b?c"), F.col("url"), joined("https://sub.", site, "/x"), joined("https://not", site), F.lit("https://other.invalid/"))
    each = table(spark, sf_dir, "pages").select("page_id", site.alias("site"), F.posexplode(urls).alias("k", "link"))
    return each.select("page_id", F.col("k").cast("long").alias("k"), U.relative_to(F.col("site"), F.col("link")).alias("inside"))


# --- text ------------------------------------------------------------------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_all(pattern: str, value: str = "text") -> str:
    return f"regexp_extract_all({value}, '{pattern}', 0)"


@query(f"SELECT doc_id, {sql_hits(fixed.ADMISSION_KEYWORDS, 'lower(text)')}::BIGINT AS n_admission, {sql_hits(fixed.PLACEMENT_KEYWORDS, 'lower(text)')}::BIGINT AS n_placement FROM documents")
def kw_hit_count(spark, sf_dir):
    low = F.lower("text")
    return documents(spark, sf_dir).select(
        "doc_id", C.hit_count(low, fixed.ADMISSION_KEYWORDS).cast("long").alias("n_admission"),
        C.hit_count(low, fixed.PLACEMENT_KEYWORDS).cast("long").alias("n_placement"),
    )


@query("""WITH words AS (SELECT DISTINCT left(text, 6) AS word FROM documents WHERE length(text) >= 6)
SELECT doc_id, count(*) AS n, min(word) AS first_word FROM documents JOIN words ON contains(text, word) GROUP BY doc_id""")
def keyword_table_hits(spark, sf_dir):
    """Documents against a list of keywords that is data: the beginnings of all documents."""
    docs = documents(spark, sf_dir)
    words = docs.where(F.length("text") >= 6).select(F.substring("text", 1, 6).alias("word"))
    found = keywords.keyword_hits(docs, "doc_id", "text", words, list_bytes=1 << 18)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


SQL_DATES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS pattern, unnest({sql_all('(?i)' + p)}) AS date_str FROM documents" for k, p in enumerate(fixed.DATE_PATTERNS)
)


@query(f"SELECT doc_id, date_str, count(*) AS n FROM ({SQL_DATES}) GROUP BY doc_id, date_str")
def dates_extract(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", F.explode(X.dates(F.col("text"))).alias("d"))
    return each.groupBy("doc_id", "d.date_str").agg(F.count("*").alias("n"))


SQL_DEADLINE_TEXT = """'Important dates' || chr(10) || 'Last date to apply: ' || strftime(o_orderdate, '%d/%m/%Y')"""


def deadline_text() -> Column:
    return joined("Important dates\nLast date to apply: ", F.date_format("o_orderdate", "dd/MM/yyyy"))


@query(f"""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_str, CAST(36 + 120 AS BIGINT) AS position,
  '...' || right(repeat('x', 120) || {SQL_DEADLINE_TEXT}, 110) || ' and more '|| repeat('y', 80) || '...' AS context FROM orders""")
def dates_context(spark, sf_dir):
    whole = joined(F.repeat(F.lit("x"), 120), deadline_text(), " and more ", F.repeat(F.lit("y"), 200))
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    each = orders.select("o_orderkey", F.explode(X.dates(whole)).alias("d"))
    return each.select("o_orderkey", "d.date_str", F.col("d.position").cast("long").alias("position"), "d.context")


SQL_NUMBERS = " UNION ALL ".join(f"SELECT doc_id, unnest({sql_all(p)}) AS match FROM documents" for p in fixed.NUMBER_PATTERNS)


@query(f"SELECT doc_id, match, count(*) AS n FROM ({SQL_NUMBERS}) GROUP BY doc_id, match")
def numbers_extract(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", F.explode(X.numbers(F.col("text"))).alias("x"))
    return each.groupBy("doc_id", "x.match").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n, max(CAST(x AS DOUBLE)) AS largest FROM (SELECT doc_id, unnest({sql_all(fixed.PLAIN_NUMBER)}) AS x FROM documents) GROUP BY doc_id")
def numbers_plain(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", F.explode(X.plain_numbers(F.col("text"))).alias("x"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("x").alias("largest"))


@query(f"SELECT doc_id, unnest({sql_all(fixed.EMAIL)}) AS email FROM documents")
def emails(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@query(f"SELECT doc_id, unnest({sql_all(fixed.PHONE)}) AS phone FROM documents")
def phones(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(X.phones(F.col("text"))).alias("phone"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.clean(F.col("text")).alias("cleaned"))


SQL_WRITTEN = """(['%Y-%m-%d', '%d/%m/%Y', '%d.%m.%Y', '%B %d, %Y', '%d %b %Y'])[1 + o_orderkey % 5]"""


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def date_parse(spark, sf_dir):
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MMMM dd, yyyy", "dd MMM yyyy"]
    written = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        written = F.when(F.pmod("o_orderkey", F.lit(5)) == k, F.date_format("o_orderdate", form)).otherwise(written)
    day = F.date_format(X.parse_date(joined(" ", written, " ")), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), X.format_datetime(F.col("o_orderdate")).alias("stamp"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parse_blanks(spark, sf_dir):
    """Dates between tabs, line ends and other white space than blanks."""
    around = F.get(F.array(*map(F.lit, ["\t", "\n", "\u00a0", "\u2003\x0b", " \r\n", "\x1c\u3000"])), F.pmod("o_orderkey", F.lit(6)).cast("int"))
    day = X.parse_date(joined(around, F.date_format("o_orderdate", "dd/MM/yyyy"), around))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, CASE WHEN b = 0 THEN '0B' WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS size
FROM (SELECT o_orderkey, (o_orderkey % 64) * (o_orderkey % 64) * 524288 AS b FROM orders)""")
def human_size(spark, sf_dir):
    part = F.pmod("o_orderkey", F.lit(64))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.human_size(part * part * 524288).alias("size"))


@query("SELECT doc_id, left(text, 1000) AS text, length(left(text, 1000)) AS n FROM documents")
def truncate(spark, sf_dir):
    cut = X.truncated(F.col("text"), 1000)
    return documents(spark, sf_dir).select("doc_id", cut.alias("text"), F.length(cut).cast("long").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0b]+'))::BIGINT AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""SELECT doc_id, CASE WHEN a > p THEN 'admission' WHEN p > a THEN 'placement' ELSE 'general' END AS kind
FROM (SELECT doc_id, {} AS a, {} AS p FROM documents)""".format(sql_hits(fixed.FILE_ADMISSION_WORDS, "lower(text)"), sql_hits(fixed.FILE_PLACEMENT_WORDS, "lower(text)")))
def pdf_type(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", C.file_type(F.col("text")).alias("kind"))


# --- urls ------------------------------------------------------------------------------------------------------------
SQL_AUTHORITY, SQL_PATH = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)", "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT page_id, 'https://' || lower({SQL_AUTHORITY}) || {SQL_PATH} AS normal FROM pages""")
def normalize_url(spark, sf_dir):
    loud = joined(F.upper(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)), F.regexp_extract("url", "^[^:]*://[^/?#]*(.*)$", 1), "?q=1#top")
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace(U.normalize(loud), "^http:", "https:").alias("normal"))


@query(f"SELECT page_id, {SQL_AUTHORITY} AS host, true AS valid, false AS relative_valid FROM pages")
def domain(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.domain(u).alias("host"), U.is_valid(u).alias("valid"), U.is_valid(U.path(u)).alias("relative_valid")
    )


@query(f"""SELECT a.page_id, {SQL_AUTHORITY.replace('url', 'a.url')} = {SQL_AUTHORITY.replace('url', 'b.url')} AS same
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def same_domain(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select("page_id", "url")
    b = a.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return a.join(b, "page_id").select("page_id", U.same_domain(F.col("url"), F.col("other")).alias("same"))


@query(f"SELECT p_partkey, lower(regexp_extract(link, '[.]([^.]*)$', 1)) AS ext FROM ({SQL_FILES}) UNION ALL SELECT page_id, 'html' FROM pages")
def file_ext(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["pdf", "doc", "xlsx", "csv", "PNG", "html"]))
    key = F.col("p_partkey")
    link = joined("https://files.example/", key, ".", F.get(kinds, F.pmod(key, F.lit(6)).cast("int")), "?v=1.2")
    files = table(spark, sf_dir, "part").select("p_partkey", U.extension(link).alias("ext"))
    pages = table(spark, sf_dir, "pages").select("page_id", U.extension(joined(F.col("url"), "/x")).alias("ext"))
    return files.union(pages)


@query(rf"""SELECT page_id, 'p_' || CASE WHEN b <> '' THEN regexp_replace(b, '[\\/*?:"<>|]', '_', 'g') ELSE replace({SQL_AUTHORITY}, '.', '_') END || '_s' AS name
FROM (SELECT page_id, url, regexp_extract({SQL_PATH}, '([^/]*)$', 1) AS b FROM pages)""")
def gen_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.file_name(F.col("url"), "p", "s").alias("name"))


@query(rf"""SELECT page_id, CASE WHEN length(f) > 100 THEN left(f, 90) || '_' || left(md5(u), 10) ELSE f END || '.html' AS name
FROM (SELECT page_id, u, replace(regexp_replace({SQL_AUTHORITY.replace('url', 'u')} || {SQL_PATH.replace('url', 'u')}, '[\\/*?:"<>|]', '_', 'g'), '.', '_') AS f
      FROM (SELECT page_id, url || repeat('/a.b', CAST(page_id % 30 AS BIGINT)) AS u FROM pages))""")
def url_filename(spark, sf_dir):
    longer = joined(F.col("url"), F.repeat(F.lit("/a.b"), F.pmod("page_id", F.lit(30)).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", U.to_file_name(longer).alias("name"))


# --- tables and facts, rendered from rows ------------------------------------------------------------------------------
def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: a table of its lines in order, the third cell beyond the two headers."""
    order = F.struct("l_linenumber", "l_partkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("lines"))
    rows = F.transform(
        "lines",
        lambda x: joined("<tr><td>Course ", x["l_partkey"], "</td><td>", x["l_quantity"].cast("long"), "</td><td>z", x["l_linenumber"], "</td></tr>"),
    )
    html = joined("<html><body><table><tr><th>Course</th><th>Seats</th></tr>", F.array_join(rows, ""), "</table></body></html>")
    return lines.select("l_orderkey", html.alias("html"))


SQL_LINE_ROWS = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS place,
  'Course ' || l_partkey AS course, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS seats, 'z' || l_linenumber AS extra FROM lineitem"""


@query(f"SELECT l_orderkey, place, course, seats FROM ({SQL_LINE_ROWS})")
def table_rows(spark, sf_dir):
    pages = H.parse_pages(line_tables(spark, sf_dir), "tables")
    each = H.each_of(pages, F.flatten(F.transform("page.tables", lambda t: t["raw_rows"])), "row", "l_orderkey")
    return each.select("l_orderkey", F.col("place").cast("long").alias("place"), F.col("row")[0].alias("course"), F.col("row")[1].alias("seats"))


@query(f"SELECT l_orderkey, place, course, seats, extra FROM ({SQL_LINE_ROWS})")
def table_cells_overflow(spark, sf_dir):
    pages = H.parse_pages(line_tables(spark, sf_dir), "tables")
    maps = F.flatten(F.transform(H.data_tables(F.col("page")), H.table_rows))
    each = H.each_of(pages, maps, "row", "l_orderkey")
    return each.select(
        "l_orderkey", F.col("place").cast("long").alias("place"), F.col("row")["Course"].alias("course"),
        F.col("row")["Seats"].alias("seats"), F.col("row")["column_3"].alias("extra"),
    )


@query(f"SELECT l_orderkey, place, course AS name, seats FROM ({SQL_LINE_ROWS})")
def courses(spark, sf_dir):
    pages = H.parse_pages(line_tables(spark, sf_dir), "text", "tables")
    found = A.courses(F.col("page.text"), H.data_tables(F.col("page")))
    each = H.each_of(pages, found, "c", "l_orderkey")
    return each.select("l_orderkey", F.col("place").cast("long").alias("place"), "c.name", "c.seats")


@query("""SELECT p_partkey, unnest(['Course ' || p_partkey, 'Brand ' || p_size]) AS name FROM part""")
def courses_in_text(spark, sf_dir):
    body = joined("Courses offered: Course ", F.col("p_partkey"), ", 12, Brand ", F.col("p_size"), ";x")
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(A.courses(body, no_tables())).alias("c"))
    return each.select("p_partkey", "c.name")


@query("""SELECT o_orderkey, (['application', 'entrance_exam', 'result_declaration', 'interview_counselling', 'fee_payment',
  'class_commencement', 'other'])[1 + o_orderkey % 7] AS kind FROM orders""")
def deadline_type(spark, sf_dir):
    said = ["Information bulletin", "Entrance round", "RESULT day", "Counselling", "Deposit due", "Classes", "Holiday"]
    word = F.get(F.array(*map(F.lit, said)), F.pmod("o_orderkey", F.lit(7)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", A.deadline_type(word).alias("kind"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_str, 'application' AS event_type FROM orders
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), 'entrance_exam' FROM orders""")
def deadlines(spark, sf_dir):
    rows = F.array(F.array(F.lit("Entrance test"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    found = A.deadlines(deadline_text(), one_table(["Event", "Date"], rows))
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("d"))
    return each.select("o_orderkey", "d.date_str", "d.event_type")


def segment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    pair = F.array("c_mktsegment", F.col("n").cast("string"))
    return counts.groupBy("c_nationkey").agg(F.collect_list(pair).alias("rows"))


@query("SELECT c_nationkey, c_mktsegment AS category, count(*)::DOUBLE AS seats FROM customer GROUP BY ALL")
def seats_category(spark, sf_dir):
    found = A.seats(F.lit(""), one_table(["Category", "Seats"], F.col("rows")))
    each = segment_tables(spark, sf_dir).select("c_nationkey", F.explode(found["category_wise"]).alias("category", "v"))
    return each.select("c_nationkey", "category", F.col("v.num").alias("seats"))


@query("SELECT c_nationkey, count(*) AS added, CAST(c_nationkey * 10 AS BIGINT) AS stated FROM customer GROUP BY c_nationkey")
def seats_total(spark, sf_dir):
    tables = one_table(["Category", "Seats"], F.col("rows"))
    stated = joined("Total number of seats: ", F.col("c_nationkey") * 10)
    return segment_tables(spark, sf_dir).select(
        "c_nationkey", A.seats(F.lit(""), tables)["total"].alias("added"), A.seats(stated, tables)["total"].alias("stated")
    )


@query("SELECT p_partkey, 'Program ' || p_partkey AS course, floor(p_retailprice)::DOUBLE AS fee FROM part")
def fees_course(spark, sf_dir):
    cells = F.array(F.array(joined("Program ", F.col("p_partkey")), joined("INR ", F.floor("p_retailprice"))))
    found = A.fees(F.lit(""), one_table(["Program", "Fee"], cells))["course_wise"]
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("course", "v"))
    return each.select("p_partkey", "course", F.col("v.num").alias("fee"))


@query("SELECT p_partkey, 'Part ' || p_size || ' due now' AS schedule, (p_size * 100)::DOUBLE AS hostel_fee FROM part")
def payment_schedule(spark, sf_dir):
    body = joined("About us.\nPayment schedule: Part ", F.col("p_size"), " due now")
    cells = F.array(F.array(joined("Hostel, Rs ", F.col("p_size") * 100)))
    found = A.fees(body, one_table(["Amount"], cells))
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", found["payment_schedule"].alias("schedule"), found["hostel_fee"]["num"].alias("hostel_fee"))


@query("""SELECT p_partkey, (p_size * 10)::DOUBLE AS first_year, 'on request' AS general_fee, (p_size * 1000 + 0.5)::DOUBLE AS hostel_fee,
  'Branch ' || p_partkey AS course, 'see office' AS course_fee FROM part""")
def fees_kinds(spark, sf_dir):
    """Fees without a course by the words of their row, the last of a kind counting; cells that are no numbers stay text."""
    size, key = F.col("p_size"), F.col("p_partkey")
    plain = one_table(["Item", "Amount"], F.array(
        F.array(F.lit("1st part"), F.lit("5")), F.array(F.lit("FIRST year"), joined("Rs ", size * 10)), F.array(F.lit("Library"), F.lit("on request")),
        F.array(F.lit("Hostel"), joined("INR ", size * 1000, ".5")), F.array(F.lit("no fee cell")),
    ))
    named = one_table(["Branch", "Fees"], F.array(F.array(joined("Branch ", key), F.lit("70")), F.array(joined("Branch ", key), F.lit("see office"))))
    found, by_course = A.fees(F.lit(""), plain), A.fees(F.lit(""), named)["course_wise"]
    part = table(spark, sf_dir, "part").select(
        "p_partkey", found["first_year"]["num"].alias("first_year"), found["general_fee"]["raw"].alias("general_fee"),
        found["hostel_fee"]["num"].alias("hostel_fee"), F.explode(by_course).alias("course", "v"),
    )
    return part.select("p_partkey", "first_year", "general_fee", "hostel_fee", "course", F.col("v.raw").alias("course_fee"))


@query("""SELECT c_custkey, c_nationkey::DOUBLE AS open_seats, 'as needed' AS other_seats, c_nationkey::BIGINT AS total FROM customer""")
def seats_text(spark, sf_dir):
    """Seats that are no whole numbers stay text and are not added up; white space of any kind around numbers is none of them."""
    rows = F.array(F.array(F.lit("Open"), joined("\u00a0", F.col("c_nationkey"), "\t")), F.array(F.lit("Other"), F.lit("as needed")), F.array(F.lit("short row")))
    found = A.seats(F.lit(""), one_table(["Quota", "Count"], rows))
    customer = table(spark, sf_dir, "customer").select("c_custkey", found.alias("f"))
    return customer.select(
        "c_custkey", F.col("f.category_wise")["Open"]["num"].alias("open_seats"), F.col("f.category_wise")["Other"]["raw"].alias("other_seats"),
        F.col("f.total").alias("total"),
    )


@query("""SELECT o_orderkey, (o_orderkey % 3 <> 0) AS boys, CASE WHEN o_orderkey % 2 = 0 THEN true END AS girls,
  (o_custkey * 10)::DOUBLE AS fee FROM orders""")
def hostel(spark, sf_dir):
    key = F.col("o_orderkey")
    boys = F.when(F.pmod(key, F.lit(3)) == 0, "Boys hostel is not available. ").otherwise("Separate hostel for boys. ")
    girls = F.when(F.pmod(key, F.lit(2)) == 0, "Girls  hostel nearby. ").otherwise("")
    found = A.hostel(joined(boys, girls, "Hostel fees: Rs. ", F.format_number(F.col("o_custkey") * 10, 0)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", found["boys_hostel"].alias("boys"), found["girls_hostel"].alias("girls"), found["hostel_fee"].alias("fee")
    )


@query("""SELECT o_orderkey, exam FROM (SELECT o_orderkey, unnest(['GATE', (['NEET','CLAT'])[1 + o_orderkey % 2]]) AS exam FROM orders)""")
def eligibility_exams(spark, sf_dir):
    other = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "neet").otherwise("CLAT")
    found = A.eligibility(joined("We take gate scores and ", other, ". No matter."))["entrance_exams"]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("exam"))


@query("""SELECT o_orderkey, 'GATE' AS exam, (o_custkey % 900)::DOUBLE AS score FROM orders
UNION ALL SELECT o_orderkey, '12th_percentage', (o_custkey % 60 + 40)::DOUBLE FROM orders""")
def eligibility_cutoff(spark, sf_dir):
    customer = F.col("o_custkey")
    body = joined("GATE score is ", F.pmod(customer, F.lit(900)), ". Minimum marks required: ", F.pmod(customer, F.lit(60)) + 40, " %")
    found = A.eligibility(body)["cutoff_scores"]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(found).alias("exam", "score"))


@query("""SELECT o_orderkey, (o_custkey % 40 + 0.5)::DOUBLE AS average, (o_custkey % 90 + 5)::DOUBLE AS highest,
  (o_custkey * 100 + 1000000)::DOUBLE / 100000 AS median FROM orders""")
def placement_stats(spark, sf_dir):
    customer = F.col("o_custkey")
    body = joined(
        "Average package is ", F.pmod(customer, F.lit(40)), ".5 lakh. Highest CTC: ", F.pmod(customer, F.lit(90)) + 5,
        " lac. Median salary of ", customer * 100 + 1000000, " a year",
    )
    found = P.statistics(body, no_tables())
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", found["avg_package"].alias("average"), found["highest_package"].alias("highest"),
        found["median_package"].alias("median"),
    )


@query("""SELECT o_orderkey, round((o_custkey % 80 + 1)::DOUBLE / 99 * 100, 2) AS percentage FROM orders""")
def placement_pct_derived(spark, sf_dir):
    body = joined(F.pmod("o_custkey", F.lit(80)) + 1, " students were placed. Total students: 99.")
    found = P.statistics(body, no_tables())["placement_percentage"]
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("percentage"))


@query("""SELECT o_orderkey, (o_custkey % 40 + 0.5)::DOUBLE AS average, (o_custkey * 100 + 1000000)::DOUBLE AS median, 7.25::DOUBLE AS highest, CAST(NULL AS DOUBLE) AS none
FROM orders""")
def placement_stats_tables(spark, sf_dir):
    """Small summary tables fill what the text leaves open, unscaled; tables of more than three rows and without such a header don't."""
    customer = F.col("o_custkey")
    rows = F.array(
        F.array(F.lit("Average package"), joined("is ", F.pmod(customer, F.lit(40)), ".5 lakh")), F.array(F.lit("Highest package"), F.lit("is 99 lakh")),
        F.array(F.lit("Median salary"), joined("of ", customer * 100 + 1000000)),
    )
    text_ = F.lit("Highest package is 7.25 lakh.")
    found = P.statistics(text_, one_table(["CTC", "Value"], rows))
    large = P.statistics(text_, one_table(["CTC", "Value"], F.concat(rows, F.array(F.array(F.lit("more"), F.lit("rows"))))))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", found["avg_package"].alias("average"), found["median_package"].alias("median"), found["highest_package"].alias("highest"),
        large["avg_package"].alias("none"),
    )


@query("""SELECT o_orderkey, (o_custkey % 90 + 10)::DOUBLE AS placed, (o_custkey % 90 + 110)::DOUBLE / 100000 AS total,
  round((o_custkey % 90 + 10)::DOUBLE / ((o_custkey % 90 + 110)::DOUBLE / 100000) * 100, 2) AS percentage FROM orders""")
def placement_counts_scaled(spark, sf_dir):
    """Counts of 100 and more are divided by 100,000 where their pattern names no lakh, and the percentage follows from what is left."""
    part = F.pmod("o_custkey", F.lit(90))
    found = P.statistics(joined(part + 10, " students were placed. Total students: ", part + 110, "."), no_tables())
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", found["students_placed_count"].alias("placed"), found["total_students"].alias("total"), found["placement_percentage"].alias("percentage")
    )


def nation_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.sort_array(F.collect_list("s_name"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(names.alias("names"))


@query("SELECT s_nationkey, s_name AS company, count(*) OVER (PARTITION BY s_nationkey) + 100 AS visited FROM supplier")
def recruiters(spark, sf_dir):
    body = joined("Top recruiters include: ", F.array_join("names", ", "), ", etc. Then ", F.size("names") + 100, " companies visited")
    found = P.recruiters(body, no_tables())
    base = nation_suppliers(spark, sf_dir).select("s_nationkey", found.alias("r"))
    return base.select("s_nationkey", F.explode("r.top_companies").alias("company"), F.col("r.total_companies_visited").cast("long").alias("visited"))


@query("SELECT DISTINCT s_nationkey, s_name AS company FROM supplier")
def companies_distinct(spark, sf_dir):
    rows = F.transform(F.concat("names", "names"), lambda n: F.array(F.lit("1"), joined(" ", n, " ")))
    found = P.recruiters(F.lit(""), one_table(["No", "Company"], rows))["top_companies"]
    return nation_suppliers(spark, sf_dir).select("s_nationkey", F.explode(found).alias("company"))


@query("""SELECT CAST(year(o_orderdate) + 20 AS VARCHAR) AS year, count(*)::DOUBLE AS package, (count(*) % 100)::DOUBLE::VARCHAR || '%' AS placed
FROM orders GROUP BY year(o_orderdate)""")
def history_year(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    row = F.array(joined(F.col("y") + 20, "-", F.pmod(F.col("y") + 21, F.lit(100))), joined("INR ", F.col("n")), joined(F.pmod("n", F.lit(100)), " %"))
    found = P.history(one_table(["Academic Year", "Average Package", "Percentage"], F.col("rows")))["year_wise"]
    whole = counts.groupBy().agg(F.collect_list(row).alias("rows"))  # a row a year
    each = whole.select(F.explode(found).alias("year", "v"))
    return each.select("year", F.col("v.avg_package.num").alias("package"), F.col("v.placed").alias("placed"))


@query("""SELECT o_orderkey, (o_custkey % 50)::DOUBLE AS higher, (o_custkey % 100 + 101)::DOUBLE AS abroad, (o_custkey % 7)::DOUBLE AS startups FROM orders""")
def alt_paths(spark, sf_dir):
    customer = F.col("o_custkey")
    body = joined(F.pmod(customer, F.lit(50)), "% students opted for higher studies. ", F.pmod(customer, F.lit(100)) + 101, " students went abroad.")
    rows = F.array(F.array(joined(F.pmod(customer, F.lit(7)), " %")))
    found = P.alternative_paths(body, one_table(["Startups"], rows))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", found["higher_studies"]["num"].alias("higher"), found["abroad_studies"]["num"].alias("abroad"),
        found["startups_founded"]["num"].alias("startups"),
    )


@query("""SELECT s_nationkey, s_name AS company, count(*) OVER (PARTITION BY s_nationkey) AS n, 42.5::DOUBLE AS share FROM supplier""")
def internships(spark, sf_dir):
    body = joined(
        F.size("names"), " students received internships, 42.5 % were offered internship. Internship companies include: ",
        F.array_join("names", "; "), ". Next",
    )
    base = nation_suppliers(spark, sf_dir).select("s_nationkey", P.internships(body, no_tables()).alias("i"))
    return base.select("s_nationkey", F.explode("i.companies").alias("company"), F.col("i.count").cast("long").alias("n"), F.col("i.percentage").alias("share"))


@query("""SELECT o_orderkey, (o_custkey % 100)::DOUBLE AS on_campus, (o_custkey % 300)::DOUBLE AS off_campus, CAST(NULL AS DOUBLE) AS pool_campus FROM orders""")
def recruitment_types(spark, sf_dir):
    customer = F.col("o_custkey")
    body = joined(
        "On-campus placement percentage: ", F.pmod(customer, F.lit(100)), " %. ", F.pmod(customer, F.lit(300)),
        " students recruited through off campus.",
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", P.recruitment_types(body).alias("r")).select("o_orderkey", "r.*")


def span(value: Column, x: float, flags: int, size: float | Column) -> Column:
    return F.struct(
        value.cast("string").alias("text"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit("f").alias("font"),
        F.lit(size).alias("size"), F.lit(flags).alias("flags"),
    )


def part_lines(spark: SparkSession, sf_dir: str, flags: int, size: float | Column) -> DataFrame:
    """Lines of spans for each order: a header of these flags and this size, then a line for each of its parts in size 9."""
    head = F.struct(F.array(span(F.lit(" Part "), 10.0, flags, size), span(F.lit("Quantity"), 80.0, flags, size)).alias("spans"))
    pairs = F.collect_list(F.struct("l_partkey", "l_quantity"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pairs.alias("pairs"))
    body = F.transform("pairs", lambda p: F.struct(F.array(span(p["l_partkey"], 10.0, 0, 9.0), span(p["l_quantity"], 80.0, 0, 9.0)).alias("spans")))
    return grouped.select("l_orderkey", F.concat(F.array(head), body).cast(schemas.SPAN_LINES).alias("lines"))


@query("""SELECT l_orderkey, count(*) AS n_rows, 'Part | Quantity' AS head FROM lineitem GROUP BY l_orderkey""")
def pdf_table_geom(spark, sf_dir):
    """Lines of positioned spans, a bold header first, read back as a table."""
    found = part_lines(spark, sf_dir, 2, 9.0)
    found = found.where(layout.is_table(F.col("lines"))).select("l_orderkey", layout.as_table(F.col("lines")).alias("t"))
    return found.select("l_orderkey", F.size("t.rows").cast("long").alias("n_rows"), F.array_join("t.headers", " | ").alias("head"))


@query("""SELECT l_orderkey, CAST(count(*) + (l_orderkey % 2) AS BIGINT) AS n_rows, CASE WHEN l_orderkey % 2 = 0 THEN 'Part | Quantity' ELSE ' | ' END AS head,
  'Part | Quantity' AS first_line FROM lineitem GROUP BY l_orderkey""")
def pdf_table_by_size(spark, sf_dir):
    """Without a bold line the header is told by its font size: two points larger in every other order, one point in the rest."""
    size = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, 11.0).otherwise(10.0)
    found = part_lines(spark, sf_dir, 0, size).select("l_orderkey", layout.as_table(F.col("lines")).alias("t"))
    return found.select(
        "l_orderkey", F.size("t.rows").cast("long").alias("n_rows"), F.array_join("t.headers", " | ").alias("head"),
        F.substring_index("t.raw_text", "\n", 1).alias("first_line"),
    )


@query("""SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || o_custkey || chr(10) || chr(10) || '- ' || o_orderstatus || chr(10) || o_custkey || '. item' || chr(10) AS text FROM orders""")
def pdf_formatted(spark, sf_dir):
    """Blocks of lines as text: a paragraph of two lines and a blank one, a list item, a numbered item, and a blank block."""

    def line(*texts: str | Column) -> Column:
        return F.struct(F.array(*(span(text(t), 0.0, 0, 9.0) for t in texts)).alias("spans"))

    blocks = F.array(
        F.array(line("\u2003Order ", F.col("o_orderkey")), line("\t", "\u00a0"), line("of ", F.col("o_custkey"), "\n")),
        F.array(line("- ", F.col("o_orderstatus"))), F.array(line(F.col("o_custkey"), ". item")), F.array(line(" \x0b")),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", layout.formatted(blocks.cast(f"array<{schemas.SPAN_LINES}>")).alias("text"))


@query("""SELECT 'K' || o_orderkey || '.pdf' AS path, 'Order ' || o_orderkey || chr(10) || chr(10) || '• ' || o_orderstatus || chr(10) || 'Key Size   ' || o_custkey || ' 7' || chr(10) || chr(10) AS text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Key | Size' ELSE ' | ' END AS headers, CAST(1 + o_orderkey % 2 AS BIGINT) AS n_rows FROM orders""")
def pdf_dumps(spark, sf_dir):
    """Landed dumps of positioned text, read again: text in reading order, and the tables among its blocks, headed by a larger font."""

    def dumped(*texts: str | Column, size: float | Column = 9.0) -> Column:
        spans = (F.struct(text(t).alias("text"), F.array(F.lit(10.0 + 70 * k), F.lit(5.0)).alias("origin"), F.lit(size).alias("size")) for k, t in enumerate(texts))
        return F.struct(F.array(*spans).alias("spans"))

    def block(*lines: Column) -> Column:
        return F.struct(F.lit(0).alias("type"), F.array(*lines).alias("lines"))

    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    large = F.when(F.pmod(key, F.lit(2)) == 0, 10.5).otherwise(9.5)
    none = F.struct(F.lit(1).alias("type"), F.lit(None).cast("array<struct<spans:array<struct<text:string,origin:array<double>,size:double>>>>").alias("lines"))
    grid = block(dumped("Key", " Size ", size=large), dumped(joined(" ", customer), " 7"))
    page = F.struct(joined("K", key, ".pdf").alias("path"), F.lit(1).alias("page"), F.array(
        block(dumped(joined("Order ", key))), none, block(dumped(joined("• ", F.col("o_orderstatus")))), grid
    ).alias("blocks"))
    folder = fresh(spark)
    table(spark, sf_dir, "orders").select(F.to_json(page)).write.text(folder)
    found = tables.span_pages(spark, folder).select("path", layout.formatted(F.col("blocks")).alias("text"), F.get(layout.tables_of(F.col("blocks")), F.lit(0)).alias("t"))
    return found.select("path", "text", F.array_join("t.headers", " | ").alias("headers"), F.size("t.rows").cast("long").alias("n_rows"))


@query("""SELECT o_orderkey::VARCHAR AS raw_data_id, 'admission' AS kind, strftime(o_orderdate, '%d/%m/%Y') AS fact, 0.7::DOUBLE AS confidence
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey::VARCHAR, 'placement', CAST((o_custkey % 40 + 0.5)::DOUBLE AS VARCHAR), 0.7 FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0""")
def pipeline_end_to_end(spark, sf_dir):
    """Raw documents without those processed already, through both assemblers."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    even = F.pmod(key, F.lit(2)) == 0
    package = joined("Average package is ", F.pmod("o_custkey", F.lit(40)), ".5 lakh")
    raw = orders.select(
        key.cast("string").alias("raw_id"), F.lit("x").alias("college_name"),
        F.when(even, "admission").otherwise("placement").alias("page_type"),
        F.when(even, deadline_text()).otherwise(package).alias("raw_content"),
    )
    done = orders.where(F.pmod(key, F.lit(3)) == 0).select(key.cast("string").alias("raw_data_id"))
    a, p = extract.process(raw, done, F.lit("2024-01-01").cast("timestamp"))
    date = F.get(F.col("admission_data.application_deadlines"), F.lit(0))["date_str"]
    left = a.select("raw_data_id", F.lit("admission").alias("kind"), date.alias("fact"), F.col("confidence_score").alias("confidence"))
    pay = F.col("placement_data.statistics.avg_package").cast("string")
    right = p.select("raw_data_id", F.lit("placement").alias("kind"), pay.alias("fact"), F.col("confidence_score").alias("confidence"))
    return left.unionByName(right)
