"""Histories, graphs, statistics, pages, and rules over literal rows."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import audit as A, graph as G, history as H, stats as S
from ..sources.tables import read
from .registry import query


@query("SELECT event_type AS file, count(*) AS commits, count(DISTINCT user_id) AS authors FROM events GROUP BY event_type ORDER BY commits DESC, file LIMIT 20")
def hotspots(spark, d):
    return H.hotspots(read(spark, d, "events"), "event_type", "user_id", 20)


@query("SELECT user_id AS author, count(*) AS commits, count(DISTINCT event_type) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM events GROUP BY user_id")
def author_summary(spark, d):
    return H.author_summary(read(spark, d, "events"), "user_id", "event_type")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
  i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos) AS island FROM x)
  SELECT l_orderkey, l_returnflag, min(pos)::INT AS start, max(pos)::INT AS end, arg_min(substr(l_linestatus, 1, 60), pos) AS preview FROM i GROUP BY l_orderkey, l_returnflag, island""")
def blame_blocks(spark, d):
    rows = read(spark, d, "lineitem").withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return H.blame_blocks(rows, "l_orderkey", "pos", "l_returnflag", "l_linestatus")


@query("SELECT o_orderpriority AS type, count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS breaking, CASE WHEN max(o_totalprice) > 490000 THEN 'major' ELSE 'minor' END AS bump FROM orders GROUP BY o_orderpriority")
def change_types(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("commits"), F.sum((F.col("o_orderstatus") == "F").cast("bigint")).alias("breaking"), F.when(F.max("o_totalprice") > 490000, "major").otherwise("minor").alias("bump"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_review(spark, d):
    """The last status of each customer."""
    return H.latest(read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS used FROM events) WHERE used <= 200")
def cache_eviction(spark, d):
    rows = read(spark, d, "events").withColumn("bytes", F.floor("value"))
    return H.evict(rows, "user_id", "event_id", "bytes", 200).select("user_id", "event_id")


_PARTS = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


def _edges(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")


@query(f"WITH {_PARTS} SELECT dst, count(DISTINCT src) AS importers, min(src) AS first_importer FROM e GROUP BY dst")
def reverse_edges(spark, d):
    return G.importers(_edges(spark, d))


@query(f"""WITH RECURSIVE {_PARTS}, seed AS (SELECT dst AS node FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
  r AS (SELECT node, 0 AS depth FROM seed UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 2)
  SELECT node, min(depth)::INT AS depth FROM r GROUP BY node HAVING min(depth) > 0""")
def impact_depth2(spark, d):
    """What imports the most imported part, directly or through one other."""
    edges = _edges(spark, d)
    seed = G.importers(edges).orderBy(F.desc("importers"), "dst").limit(1).select(F.col("dst").alias("node"))
    return G.impact(edges, seed, 2)


@query(f"""WITH {_PARTS}, two AS (SELECT a.src AS x, a.dst AS y FROM e a JOIN e b ON a.dst = b.src AND a.src = b.dst WHERE a.src < a.dst),
  three AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
  SELECT x || '>' || y AS path FROM two UNION ALL SELECT x || '>' || y || '>' || z FROM three""")
def cycles_up_to_3(spark, d):
    return G.cycles(_edges(spark, d), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""WITH o AS (SELECT o_custkey AS name, max(o_orderstatus) AS sig FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), n AS (SELECT o_custkey AS name, max(o_orderstatus) AS sig FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
  SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.sig <> n.sig""")
def export_diff(spark, d):
    orders = read(spark, d, "orders")
    cut = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    old, new = (orders.where(c).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("sig")) for c in (cut, ~cut))
    return G.export_diff(old, new, "o_custkey", "sig")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id % 2 = 1)
  SELECT user_id, 'now passing' AS change FROM a ANTI JOIN b ON a.user_id = b.user_id UNION ALL SELECT user_id, 'new failure' FROM b ANTI JOIN a ON a.user_id = b.user_id""")
def run_diff(spark, d):
    """Failures of one run that the other lacks (even and odd events stand for two runs)."""
    errors = read(spark, d, "events").where("event_type = 'error'")
    a, b = (errors.where(F.col("event_id") % 2 == k).select("user_id").distinct() for k in (0, 1))
    return a.join(b, "user_id", "left_anti").withColumn("change", F.lit("now passing")).unionByName(b.join(a, "user_id", "left_anti").withColumn("change", F.lit("new failure")))


@query("""SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS stdev FROM events GROUP BY event_type""")
def bench_stats(spark, d):
    out = S.summary(read(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "count", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "stdev")))


@query("""WITH p AS (SELECT event_type, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type), s AS (SELECT max(p50) FILTER (event_type = 'view') AS base, quantile_cont(p50, 0.5) FILTER (event_type <> 'view') AS work FROM p)
  SELECT round(base / work, 4) AS share, CASE WHEN base / work >= 0.30 THEN 'startup-first' WHEN base / work <= 0.15 AND work >= 250 THEN 'workload-first' ELSE 'mixed' END AS advice FROM s""")
def startup_share(spark, d):
    medians = S.quantiles(read(spark, d, "events"), "event_type", "value", 0.5)
    both = medians.agg(F.max(F.when(F.col("event_type") == "view", F.col("quantile"))).alias("base"), F.percentile(F.when(F.col("event_type") != "view", F.col("quantile")), 0.5).alias("work"))
    share = F.col("base") / F.col("work")
    return both.select(F.round(share, 4).alias("share"), F.when(share >= 0.30, "startup-first").when((share <= 0.15) & (F.col("work") >= 250), "workload-first").otherwise("mixed").alias("advice"))


def _sql(text: str) -> str:
    """A replacement as an SQL literal."""
    return "E'" + text.replace("\\", "\\\\").replace(chr(10), "\\n").replace("'", "''") + "'"


def _stripped_sql(html: str) -> str:
    for pattern, plain in X.TAG_RULES:
        html = f"regexp_replace({html}, '{pattern}', {_sql(plain)}, 'g')"
    return f"regexp_replace({html}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


_ENTITIES = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&#32;', ' '), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' ')"
_MAIN = "coalesce(nullif(regexp_extract(html, '(?is)<main[^>]*>(.*)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), html)"


def _markdown_sql() -> str:
    out = _MAIN
    for tag in X.DROPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}(?: [^>]*)?>.*?</{tag}>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    for level in range(1, 7):
        mark = _sql("\n" + "#" * level + " \\1\n\n")
        out = f"regexp_replace({out}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', {mark}, 'g')"
    out = f"""regexp_replace({out}, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"""
    out = f"regexp_replace({out}, '(?is)<(?:b|strong)>(.*?)</(?:b|strong)>', '**\\1**', 'g')"
    return _ENTITIES.format(_stripped_sql(out))


@query(f"SELECT page_id, sha1({_ENTITIES.format(_stripped_sql('html'))}) AS digest FROM pages")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha1(X.decode_entities(X.strip_tags(F.col("html")))).alias("digest"))


@query(f"SELECT page_id, sha1({_MAIN}) AS digest FROM pages")
def html_main(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha1(X.main_content(F.col("html"))).alias("digest"))


@query(f"SELECT page_id, ceil(length(html) / 4.0)::BIGINT AS raw_tokens, markdown, ceil(length(markdown) / 4.0)::BIGINT AS tokens FROM (SELECT *, {_markdown_sql()} AS markdown FROM pages)")
def html_markdown(spark, d):
    """Pages as Markdown, with the tokens that this saves."""
    pages = read(spark, d, "pages").select("page_id", X.token_estimate(F.col("html")).alias("raw_tokens"), X.markdown(F.col("html")).alias("markdown"))
    return pages.withColumn("tokens", X.token_estimate(F.col("markdown")))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))::INT AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def link_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_PATH = "lower(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1))"


@query(f"""SELECT page_id, {_HOST} AS host, ({_HOST} = '' OR {_HOST} IN ('localhost', '0.0.0.0', '::1') OR regexp_matches({_HOST}, '^(127|10)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]')
  OR starts_with({_HOST}, 'api.') OR regexp_matches({_PATH}, '^/(api|graphql)(/|$)')) AS api_like, regexp_replace(url, '[?#].*$', '') AS canonical FROM pages""")
def url_policy(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(url, "^https?://([^/:?#]+)", 1)).alias("host"), A.api_like(url).alias("api_like"), F.regexp_replace(url, "[?#].*$", "").alias("canonical"))


@query("""SELECT event_type AS name, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type""")
def json_usage(spark, d):
    """Records parsed from JSON, by kind."""
    return read(spark, d, "events").select(F.col("event_type").alias("name"), F.from_json("props", "k bigint").alias("p")).groupBy("name").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))
