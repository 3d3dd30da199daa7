"""Small reports over tables and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.tables import read
from .registry import query


@query("""SELECT c_nationkey, lpad(c_custkey::VARCHAR, (max(length(c_custkey::VARCHAR)) OVER w)::INT, ' ') AS c_custkey_shown, rpad(c_mktsegment, (max(length(c_mktsegment)) OVER w)::INT, ' ') AS c_mktsegment_shown FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def table_report(spark, d):
    return R.padded(read(spark, d, "customer"), ["c_custkey", "c_mktsegment"], "c_nationkey")


@query("""WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 100 WHEN starts_with(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_name), 'red') THEN 60 WHEN contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'red') THEN 50 ELSE 0 END AS score FROM part)
  SELECT p_partkey, p_name, score FROM s ORDER BY score DESC, p_partkey LIMIT 12""")
def symbol_suggestions(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_name").withColumn("score", R.suggestion_score(F.col("p_name"), "red"))
    return rows.orderBy(F.desc("score"), "p_partkey").limit(12)


@query("""SELECT user_id, event_id, greatest(n - 20, 0)::BIGINT AS omitted FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 20""")
def detail_cap(spark, d):
    return R.capped(read(spark, d, "events"), "user_id", "event_id", 20).select("user_id", "event_id", "omitted")
