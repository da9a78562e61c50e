"""Reports and files: checks of verbs, the evaluation's report, crawl folders, map summaries, robots by age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, evaluation, links, store
from ..session import table
from .synthetic import _items

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: What each verb returned, well and badly, by its category.
_RETURNED = {
    "wall": ("error fetching x: HTTP 403", "verify you are a human"),
    "consent": ("head\n---\n" + "text " * 200, "We use a cookie"),
    "json": ('{\n  "a": 1\n}', "plain"),
    "pdf": ("via: pypdf\n---\n" + "text " * 200, "error fetching x: HTTP 500"),
    "map": ("site\n/a\n/b\nhttps://x.example/c\n/d\n /e", "site\n/a"),
    "crawl": ("crawl: x  Pages: 3", "nothing"),
    "search": ("1. https://x.example/", "no results"),
}


@query("""SELECT c_custkey, CASE WHEN good THEN CASE WHEN k = 0 THEN 'walled' ELSE 'pass' END ELSE CASE k WHEN 3 THEN 'unreachable' WHEN 6 THEN 'walled' ELSE 'FAIL' END END AS status
 FROM (SELECT c_custkey, c_custkey % 7 AS k, c_custkey % 2 = 0 AS good FROM customer)""")
def eval_verbs(spark: SparkSession, d: str) -> DataFrame:
    k, good = F.col("c_custkey") % 7, F.col("c_custkey") % 2 == 0
    category = F.coalesce(*[F.when(k == i, name) for i, name in enumerate(_RETURNED)])
    out = F.coalesce(*[F.when(k == i, F.when(good, F.lit(well)).otherwise(F.lit(badly))) for i, (well, badly) in enumerate(_RETURNED.values())])
    return table(spark, d, "customer").select("c_custkey", evaluation.judge_verb(category, out).alias("status"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 8 = 1) AS fab, count(*) FILTER (p_partkey % 8 = 3) AS lost, count(*) FILTER (p_partkey % 8 = 2) AS minor FROM part),
 g AS (SELECT unnest([('00', 'fabrications', fab, 0), ('01', 'calibration', lost, 0), ('02', 'omissions', lost, 1), ('03', 'minor', minor, 3), ('04', 'poisoned', 0, 0), ('05', 'timeouts', 0, 2), ('06', 'other_failures', 0, 1), ('07', 'exceptions', 0, 0), ('08', 'drifted', 0, 0)]) AS g FROM n)
 SELECT unnest([0, 1, 2, 3, 4, 5, 7, 8, 9]) AS section, '' AS key, unnest(['# Report', '**VERDICT: RED**', '- ' || n || ' items scored', '## Gates', '| gate | status | detail |', '|---|---|---|', '## Items', '| id | category | status | detail |', '|---|---|---|---|']) AS line FROM n
 UNION ALL SELECT 6, g[1], '| ' || g[2] || ' | ' || CASE WHEN g[3] <= g[4] THEN 'PASS' ELSE '**FAIL**' END || ' | ' || g[3] || ' (at most ' || g[4] || ') |' FROM g
 UNION ALL SELECT 10, CAST(p_partkey AS VARCHAR), '| ' || p_partkey || ' | ' || p_type || ' | ' || CASE p_partkey % 8 WHEN 1 THEN '**FAIL**' WHEN 2 THEN 'minor-omission' WHEN 3 THEN '**FAIL**' WHEN 4 THEN 'warn-correct' WHEN 7 THEN 'walled' ELSE 'pass' END || ' | ' || substr(repeat(p_name, 9), 1, 100) || ' |' FROM part""")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    judged = evaluation.judge_content(_items(spark, d))
    named = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"), F.repeat("p_name", F.lit(9)).alias("detail"))
    results = judged.join(named, "p_partkey").select(F.col("p_partkey").alias("id"), "category", "status", "detail")
    return evaluation.report(results, evaluation.verdict(judged), "Report")


@query("""SELECT 'https://h' || c_custkey || '.example' AS site, CASE WHEN young THEN 'cached' ELSE 'live' END AS body, CASE WHEN young THEN read_at ELSE 100000 END AS fetched_at
 FROM (SELECT c_custkey, c_custkey * 1000 % 100000 AS read_at, c_custkey * 1000 % 100000 > 50000 AS young FROM customer) WHERE young OR c_custkey % 3 <> 0""")
def robots_ttl(spark: SparkSession, d: str) -> DataFrame:
    site = F.concat(F.lit("https://h"), F.col("c_custkey").cast("string"), F.lit(".example"))
    c = table(spark, d, "customer").withColumn("site", site)
    cached = c.select("site", F.lit("cached").alias("body"), (F.col("c_custkey") * 1000 % 100_000).alias("fetched_at"))
    return store.robots_files(cached, c.where("c_custkey % 3 <> 0").withColumn("body", F.lit("live")), ttl_seconds=50_000, now=100_000)


_PAGE = "printf('%03d', number) || '-' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '.md'"


@query(f"""WITH met AS (SELECT c_custkey, c_name, 'https://s.example/c/' || c_custkey AS url, '/c/' || c_custkey AS path, c_custkey % 4 AS k, c_mktsegment AS markdown, length(c_mktsegment) // 4 AS tokens FROM customer),
 saved AS (SELECT *, {_PAGE} AS file FROM (SELECT *, row_number() OVER (ORDER BY c_custkey % 3, url) AS number FROM met WHERE k > 1) WHERE number <= 50),
 n AS (SELECT (SELECT count(*) FROM saved) AS pages, count(*) FILTER (k = 0) AS errors, count(*) FILTER (k = 1) AS skipped FROM met),
 lines AS (SELECT 0 AS s, 0 AS pos, '' AS path, 'crawl: s.example  pages: ' || pages || '  errors: ' || errors || '  skipped(robots/dupe/type): ' || skipped AS line FROM n UNION ALL SELECT 0, 1, '', 'dir: /crawls/s'
  UNION ALL SELECT 1, number, path, rpad(file, CAST(greatest(32, length(file)) AS INTEGER), ' ') || ' ~' || tokens || 'tok  ' || rpad(c_name, CAST(greatest(28, length(c_name)) AS INTEGER), ' ') || ' ' || path FROM saved
  UNION ALL SELECT 2, 0, path, 'errors: ' || path || ' (500)' FROM met WHERE k = 0)
 SELECT file, '---' || chr(10) || 'url: ' || url || chr(10) || 'title: ' || c_name || chr(10) || 'fetched: 2026-01-02' || chr(10) || 'tokens: ' || tokens || chr(10) || '---' || chr(10) || chr(10) || markdown AS content FROM saved
 UNION ALL SELECT 'INDEX.md', string_agg(line, chr(10) ORDER BY s, pos, path) || chr(10) FROM lines
 UNION ALL SELECT 'index.json', '[' || chr(10) || string_agg('  {{' || chr(10) || '    "url": "' || url || '",' || chr(10) || '    "title": "' || c_name || '",' || chr(10) || '    "file": "' || file || '",' || chr(10) || '    "tokens": ' || tokens || chr(10) || '  }}', ',' || chr(10) ORDER BY number) || chr(10) || ']' FROM saved""")
def crawl_files(spark: SparkSession, d: str) -> DataFrame:
    way = F.concat(F.lit("/c/"), F.col("c_custkey").cast("string"))
    url, k = F.concat(F.lit("https://s.example"), way), F.col("c_custkey") % 4
    met = table(spark, d, "customer").select(
        url.alias("url"), url.alias("final_url"), way.alias("path"), (F.col("c_custkey") % 3).alias("depth"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("markdown"),
        F.when(k == 0, "error").when(k == 1, "skipped_type").otherwise("saved").alias("outcome"), F.when(k == 0, "500").alias("reason"),
    )
    kept = crawl.index(met.where("outcome = 'saved'"), max_pages=50)
    return crawl.files(kept.unionByName(met.where("outcome <> 'saved'"), allowMissingColumns=True), "s.example", "/crawls/s", "2026-01-02")


@query("""SELECT 'site: https://s.example — ' || count(*) || ' urls (sitemap ' || count(*) FILTER (s = 0) || ', links ' || count(*) FILTER (s = 1) || '); showing ' || least(10, count(*) FILTER (u LIKE '%/p/1%')) || ' matching "/P/1"' AS line
 FROM (SELECT u, min(s) AS s FROM (SELECT c_custkey % 50 AS u, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS s FROM customer WHERE c_custkey % 7 <> 0) GROUP BY u) JOIN (SELECT unnest(range(50)) AS i, '/p/' || i AS u_) ON u = i, LATERAL (SELECT u_ AS p)""".replace("u LIKE", "u_ LIKE"))
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    host = F.when(F.col("c_custkey") % 7 == 0, "https://other.example/p/").otherwise("https://S.example/p/")
    rows = c.select(F.when(F.col("c_custkey") % 3 == 0, "sitemap").otherwise("links").alias("source"), F.col("c_custkey").alias("pos"), F.concat(host, (F.col("c_custkey") % 50).cast("string")).alias("url"))
    return links.map_summary(rows, "https://s.example/", search="/P/1", max_urls=10)
