"""Budgets, duplicates, ranking and scans over documents and parts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import duplicates as D, rules as R
from ..sources.tables import lines, read
from .registry import query


@query("""SELECT source, count(*) AS files, sum(ceil(length(text) / 4.0)::BIGINT)::BIGINT AS tokens,
  round(100.0 * sum(ceil(length(text) / 4.0)::BIGINT) / sum(sum(ceil(length(text) / 4.0)::BIGINT)) OVER (), 2)::DOUBLE AS percent
  FROM documents GROUP BY source ORDER BY tokens DESC, source LIMIT 10""")
def context_by_source(spark, d):
    """Tokens by folder with their share, the ten largest."""
    sums = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    return sums.withColumn("percent", F.round(100.0 * F.col("tokens") / F.sum("tokens").over(W.partitionBy()), 2)).orderBy(F.desc("tokens"), "source").limit(10)


@query("""SELECT doc_id, source, ceil(length(text) / 4.0)::BIGINT AS tokens,
  CASE WHEN ceil(length(text) / 4.0) >= 1000 THEN printf('%.1fk', floor((ceil(length(text) / 4.0) + 50) / 100) / 10.0) ELSE ceil(length(text) / 4.0)::BIGINT::VARCHAR END AS shown
  FROM documents ORDER BY tokens DESC, doc_id LIMIT 25""")
def largest_documents(spark, d):
    tokens = X.token_estimate(F.col("text"))
    return read(spark, d, "documents").select("doc_id", "source", tokens.alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(25).withColumn("shown", X.format_tokens(F.col("tokens")))


@query("""SELECT coalesce(r_name, '') AS region, coalesce(n_name, '') AS nation, grouping(r_name)::INT + grouping(n_name)::INT AS depth, count(*) AS files, sum(length(c_name))::BIGINT AS size
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def folder_rollup(spark, d):
    """Subtotals up a folder tree."""
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = rows.rollup("r_name", "n_name").agg((F.grouping("r_name") + F.grouping("n_name")).cast("int").alias("depth"), F.count("*").alias("files"), F.sum(F.length("c_name")).cast("bigint").alias("size"))
    return sums.select(F.coalesce("r_name", F.lit("")).alias("region"), F.coalesce("n_name", F.lit("")).alias("nation"), "depth", "files", "size")


@query("""SELECT substr(sha1(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))), 1, 12) AS key, count(*) AS n, min(doc_id) AS first_member
  FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def exact_duplicates(spark, d):
    return D.groups(read(spark, d, "documents"), X.digest(X.collapse(F.col("text"))), "doc_id")


_STRUCTURE = "regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), '[A-Za-zÀ-ÿ]+', '_', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')"


@query(f"""SELECT substr(sha1({_STRUCTURE}), 1, 12) AS key, count(*) AS n, count(DISTINCT trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS bodies, min(doc_id) AS first_member
  FROM documents GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) > 1""")
def structural_duplicates(spark, d):
    """Documents of one structure (words as underscores) whose bodies differ."""
    body = X.collapse(F.col("text"))
    return D.structural_groups(read(spark, d, "documents"), X.digest(F.regexp_replace(body, "[A-Za-zÀ-ÿ]+", "_")), body, "doc_id")


@query("""SELECT p_name AS name, count(*) AS n, count(DISTINCT p_type) AS bodies FROM part WHERE p_name NOT IN ('main', 'init', 'run') GROUP BY p_name HAVING count(*) >= 2""")
def repeated_names(spark, d):
    return D.repeated_names(read(spark, d, "part"), "p_name", F.col("p_type"), ["main", "init", "run"])


_SETS = """words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents),
  every AS (SELECT doc_id, len(w) AS tok, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
  sets AS (SELECT min(doc_id) AS doc_id, min(tok) AS tok, s FROM every GROUP BY s)"""


@query(f"""WITH {_SETS}, x AS (SELECT doc_id, tok, len(s) AS k, unnest(s) AS h FROM sets),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.k AS ka, b.k AS kb, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
    WHERE greatest(a.tok, b.tok) <= 1.25 * least(a.tok, b.tok) GROUP BY ALL)
  SELECT a, b, round(n / (ka + kb - n)::DOUBLE, 4) AS similarity FROM shared WHERE n / (ka + kb - n)::DOUBLE >= 0.85 ORDER BY similarity DESC, a, b""")
def near_duplicates(spark, d):
    """Pairs of documents whose 5-word shingle sets have a Jaccard index of 0.85 or more, the most alike first; documents of equal sets stand as one, the smallest."""
    from ..operators.tables import materialize

    words = read(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), f"{X.SPACE}+"), lambda x: x != "").alias("w"))
    words = materialize(words, "words")
    sets = words.select("doc_id", F.size("w").alias("tok"), F.array_distinct(F.transform(X.shingles(F.col("w"), 5), lambda s: F.xxhash64(s))).alias("hs"))
    pairs = D.near_pairs(materialize(D.representatives(sets, "doc_id", "tok", "hs"), "sets"), "doc_id", "tok", "hs", 0.85)
    return pairs.withColumn("similarity", F.round("similarity", 4)).orderBy(F.desc("similarity"), "a", "b")


@query(f"""WITH {_SETS} SELECT min(doc_id) AS doc_id, count(*) AS copies FROM every GROUP BY s HAVING count(*) >= 2""")
def shingle_classes(spark, d):
    """Documents of equal shingle sets: the one that stands for them in ``near_duplicates``, and how many they are."""
    words = read(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), f"{X.SPACE}+"), lambda x: x != "").alias("w"))
    sets = words.select("doc_id", F.size("w").alias("tok"), F.array_distinct(F.transform(X.shingles(F.col("w"), 5), lambda s: F.xxhash64(s))).alias("hs"))
    return D.representatives(sets, "doc_id", "tok", "hs").where("copies >= 2").select("doc_id", "copies")


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def cross_set_overlap(spark, d):
    """Documents that hold a whole item of the benchmark."""
    return D.containing(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "item_id")


_QUERY = ["small", "red", "widget"]
_W = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH s AS (SELECT p_partkey, p_name, p_type, p_brand,
   len(list_filter(['small', 'red', 'widget'], lambda q: list_contains({_W.format('p_name')}, q))) / 3::DOUBLE AS n,
   len(list_filter(['small', 'red', 'widget'], lambda q: list_contains({_W.format('p_type')}, q))) / 3::DOUBLE AS g,
   CASE WHEN lower(p_name) = 'smallredwidget' THEN 0.6 WHEN contains(lower(p_name), 'smallredwidget') OR contains('smallredwidget', lower(p_name)) THEN 0.25 ELSE 0 END AS bonus FROM part)
  SELECT p_partkey, p_name, round(least(1.0, n + bonus + 0.3 * g), 2)::DOUBLE AS score, greatest(1, ceil(length(p_type) / 4.0))::BIGINT AS tokens FROM s
  WHERE least(1.0, n + bonus + 0.3 * g) >= 0.3 ORDER BY score DESC, tokens, p_partkey LIMIT 15""")
def lookup_rank(spark, d):
    """Parts ranked by how much of a phrase their name and type cover."""
    from ..operators.ranking import lookup

    rows = read(spark, d, "part").select("p_partkey", "p_name", "p_type", F.lit("").alias("none"))
    return lookup(rows, " ".join(_QUERY), name="p_name", signature="p_type", body="none", size="p_type", key="p_partkey").select("p_partkey", "p_name", "score", "tokens")


@query("""SELECT doc_id, pos, CASE WHEN regexp_matches(line, '(?i)licen[sc]e') THEN 'license' WHEN regexp_matches(line, 'token = ') THEN 'secret' ELSE 'mail' END AS first_pattern,
   (regexp_matches(line, '(?i)licen[sc]e')::INT + regexp_matches(line, 'token = ')::INT + regexp_matches(line, '[a-z]+@[a-z]+')::INT) AS patterns
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
  WHERE regexp_matches(line, '(?i:licen[sc]e)|token = |[a-z]+@[a-z]+')""")
def multi_pattern(spark, d):
    """One pass over all lines for several patterns; every line names its first and counts all."""
    rows = lines(read(spark, d, "documents")).where(F.col("line").rlike("(?i)licen[sc]e") | F.col("line").rlike("token = |[a-z]+@[a-z]+"))
    hits = {"license": F.col("line").rlike("(?i)licen[sc]e"), "secret": F.col("line").rlike("token = "), "mail": F.col("line").rlike("[a-z]+@[a-z]+")}
    return rows.select("doc_id", "pos", F.when(hits["license"], "license").when(hits["secret"], "secret").otherwise("mail").alias("first_pattern"), sum(h.cast("int") for h in hits.values()).alias("patterns"))


@query("""SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS secret, 'hex-token' AS kind, 'high' AS severity FROM documents""")
def secret_scan(spark, d):
    """Hard-coded secrets by rules of our own."""
    return read(spark, d, "documents").where(F.col("text").contains("token = ")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("secret"), F.lit("hex-token").alias("kind"), F.lit("high").alias("severity"))


@query("""SELECT source, count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0e-\\x1f]')) AS files_with_control, sum(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f]', '', 'g')))::BIGINT AS control_bytes FROM documents GROUP BY source""")
def control_bytes(spark, d):
    n = F.length("text") - F.length(F.regexp_replace("text", "[\\x00-\\x08\\x0e-\\x1f]", ""))
    return read(spark, d, "documents").groupBy("source").agg(F.sum((n > 0).cast("int")).cast("bigint").alias("files_with_control"), F.sum(n).cast("bigint").alias("control_bytes"))


@query("""WITH l AS (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n FROM documents),
   r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) AS k, count(*) OVER (PARTITION BY source) AS m FROM l)
  SELECT source, max(m) AS lines, max(n) FILTER (k = floor(m * 0.5) + 1)::BIGINT AS p50, max(n) FILTER (k = floor(m * 0.95) + 1)::BIGINT AS p95, max(n)::BIGINT AS longest FROM r GROUP BY source""")
def line_lengths(spark, d):
    """Nearest-rank percentiles of line length, from the histogram of lengths."""
    histogram = lines(read(spark, d, "documents").select("doc_id", F.struct("source", "text").alias("t")).select("doc_id", "t.source", "t.text").withColumn("doc_id", F.col("source"))).groupBy(F.col("doc_id").alias("source"), F.length("line").alias("n")).count()
    upto = W.partitionBy("source").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = histogram.withColumn("upto", F.sum("count").over(upto)).withColumn("m", F.sum("count").over(W.partitionBy("source")))

    def at(q: float):
        return F.min(F.when(F.col("upto") > F.floor(F.col("m") * q), F.col("n"))).cast("bigint")

    return rows.groupBy("source").agg(F.max("m").alias("lines"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("n").cast("bigint").alias("longest"))


@query("""SELECT source, count(*) AS files, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 2)::DOUBLE AS percent
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def coverage_percent(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").select(F.col("doc_id").alias("covered_id"))
    return docs.join(labels, F.col("doc_id") == F.col("covered_id"), "left").groupBy("source").agg(F.count("*").alias("files"), F.count("covered_id").alias("covered")).withColumn("percent", F.round(100.0 * F.col("covered") / F.col("files"), 2))


@query("""SELECT d.doc_id, source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id""")
def untested_sources(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH m AS (SELECT d.source, d.doc_id, d.doc_id // 1000 AS part FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id),
   i AS (SELECT source, part, doc_id, doc_id - row_number() OVER (PARTITION BY source, part ORDER BY doc_id) * 20 AS island FROM m),
   r AS (SELECT source, part, min(doc_id) AS a, max(doc_id) AS b FROM i GROUP BY source, part, island)
  SELECT source, part, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY source, part""")
def line_ranges(spark, d):
    """Numbers that follow each other in steps of twenty, as ranges, by source and thousand (so that no group grows with the table)."""
    missing = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left_anti").withColumn("part", F.floor(F.col("doc_id") / 1000))
    return R.ranges(missing, ["source", "part"], "doc_id", 20)
