"""Further reports: command kinds, recent rows, dominance, usage, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.tables import lines, read
from .registry import query

@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY event_type")
def recent_events(spark, d):
    """Events of the last week before the newest."""
    return R.since(read(spark, d, "events"), "ts", 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY p_brand), 4)::DOUBLE AS share, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type)::INT AS nth FROM c),
  b AS (SELECT *, max(share) FILTER (nth = 1) OVER (PARTITION BY p_brand) AS best FROM r) SELECT p_brand, p_type, n, share, nth FROM b WHERE nth = 1 OR (nth = 2 AND best < 0.6)""")
def dominant_style(spark, d):
    return R.dominant(read(spark, d, "part"), "p_brand", "p_type")


@query("SELECT coalesce(role, 'all') AS provider, CASE WHEN length(text) >= 500 THEN 'long' ELSE 'short' END AS kind, count(*) AS n FROM conversations GROUP BY GROUPING SETS ((role, CASE WHEN length(text) >= 500 THEN 'long' ELSE 'short' END), (CASE WHEN length(text) >= 500 THEN 'long' ELSE 'short' END))")
def provider_breakdown(spark, d):
    """Two-level counts by provider and kind, with totals by kind."""
    rows = read(spark, d, "conversations").withColumn("kind", F.when(F.length("text") >= 500, "long").otherwise("short"))
    sets = rows.groupingSets([["role", "kind"], ["kind"]], "role", "kind").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("role", F.lit("all")).alias("provider"), "kind", "n")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus NOT IN ('F', 'P', 'O')) AS skipped FROM orders GROUP BY o_custkey""")
def check_digest(spark, d):
    """Checks by state; what has no known state is skipped."""
    state = F.col("o_orderstatus")
    counted = {"passed": state == "F", "failed": state == "P", "pending": state == "O", "skipped": ~state.isin("F", "P", "O")}
    return read(spark, d, "orders").groupBy("o_custkey").agg(*(F.sum(c.cast("bigint")).alias(k) for k, c in counted.items()))


@query("SELECT l_partkey AS binding, count(*) AS uses FROM lineitem GROUP BY l_partkey ORDER BY uses DESC, binding LIMIT 50")
def binding_usage(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("binding")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "binding").limit(50)


@query("SELECT doc_id, pos FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, len(string_split(text, chr(10))) AS n FROM documents) WHERE pos > n - 3")
def tail_lines(spark, d):
    return R.tail(lines(read(spark, d, "documents")), "doc_id", "pos", 3).select("doc_id", "pos")


@query("""SELECT a.l_orderkey, count(*) FILTER (NOT (a.l_shipdate <= b.l_shipdate + INTERVAL 30 DAYS AND b.l_shipdate <= a.l_shipdate + INTERVAL 30 DAYS)) AS apart, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey""")
def overlapping_ranges(spark, d):
    """Of the pairs of lines of one order, those whose 30 days from shipping do not overlap (an order holds a few lines)."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("until"))
    a, b = (rows.select("l_orderkey", *(F.col(c).alias(f"{x}_{c}") for c in ("l_linenumber", "l_shipdate", "until"))) for x in "ab")
    near = R.overlaps(F.col("a_l_shipdate"), F.col("a_until"), F.col("b_l_shipdate"), F.col("b_until"))
    return a.join(b, "l_orderkey").where(F.col("a_l_linenumber") < F.col("b_l_linenumber")).groupBy("l_orderkey").agg(F.count(F.when(~near, 1)).alias("apart"), F.count("*").alias("pairs"))
