"""Listings, threads, workspaces, notes and further forms of earlier reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget as B, classify as C, code as K, duplicates as D, pages as W, ranking as L, rules as U
from ..sources.tables import read
from ..streaming import events as E
from . import project as P
from .line_queries import pick, pick_sql
from .registry import query

_LISTED = ["src/m~k~.js", "README.md", "logo~k~.png", "a~e~/package.json", "b/x~k~.zip"]


@query(f"SELECT k, {pick_sql(_LISTED)} AS path, s * 10 AS size, ceil(s * 10 / 4.0)::BIGINT AS tokens, k % 5 IN (1, 3) AS important, k % 5 IN (2, 4) AS binary FROM {P._ROWS}")
def file_listing(spark, d):
    """Files with their size, estimated tokens and flags."""
    rows = P.rows(spark, d).select("k", pick(_LISTED).alias("path"), (F.col("s") * 10).alias("size"))
    return rows.select("k", "path", "size", F.ceil(F.col("size") / 4).cast("bigint").alias("tokens"), C.important(X.basename(F.col("path"))).alias("important"), C.binary(F.col("path")).alias("binary"))


@query(f"""SELECT folder, depth::INT AS depth, count(*) AS files, sum(s)::BIGINT AS size, ceil(sum(s) / 4.0)::BIGINT AS tokens FROM (SELECT unnest(['', 'src', 'src/d' || d]) AS folder, unnest([0, 1, 2]) AS depth, s FROM {P._ROWS}) GROUP BY folder, depth""")
def folder_tree(spark, d):
    """Subtotals of all folders of the project, to any depth."""
    sizes = P.rows(spark, d).select(F.concat(P.fill("src/d~d~/m~k~.x")).alias("path"), "s")
    return U.folder_tree(sizes, "path", "s")


_CONTROLLED = ["plain ~k~", "a~k~\\u0000b", "\\u001b[3~e~m", "\\u0001\\u0002\\u0003\\u0004\\u0005~k~", "x.png"]


@query(f"SELECT k, CASE k % 5 WHEN 1 THEN 1 + length(k::VARCHAR) WHEN 2 THEN 0 END::INT AS \"offset\", CASE k % 5 WHEN 1 THEN 'NUL' WHEN 2 THEN 'ESC' END AS name FROM {P._ROWS} WHERE k % 5 IN (1, 2)")
def control_marks(spark, d):
    """The first control character of texts that are no binaries."""
    texts = [t.encode().decode("unicode_escape") for t in _CONTROLLED]
    rows = P.rows(spark, d).select("k", C.control_mark(P.fill("a~k~.txt"), pick(texts)).alias("m")).where("m is not null")
    return rows.select("k", "m.offset", "m.name")


@query("""SELECT substr(sha1(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))), 1, 12) AS key, count(*) AS n, max(ceil(length(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) / 4.0))::BIGINT AS tokens FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, tokens DESC, key LIMIT 20""")
def largest_copies(spark, d):
    """Groups of copies, the largest first."""
    body = X.collapse(F.col("text"))
    rows = read(spark, d, "documents").groupBy(X.digest(body).alias("key")).agg(F.count("*").alias("n"), F.max(X.token_estimate(body)).alias("tokens"))
    return rows.where("n >= 2").orderBy(F.desc("n"), F.desc("tokens"), "key").limit(20)


_WORDS = """words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents),
  every AS (SELECT doc_id, len(w) AS tok, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
  sets AS (SELECT min(doc_id) AS doc_id, min(tok) AS tok, s FROM every GROUP BY s HAVING count(*) = 1)"""


@query(f"""WITH {_WORDS}, x AS (SELECT doc_id, tok, len(s) AS k, unnest(s) AS h FROM sets),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.k AS ka, b.k AS kb, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id WHERE greatest(a.tok, b.tok) <= 1.25 * least(a.tok, b.tok) GROUP BY ALL)
  SELECT a, b, round(n / (ka + kb - n)::DOUBLE, 2) AS similarity FROM shared WHERE n / (ka + kb - n)::DOUBLE >= 0.3""")
def near_only(spark, d):
    """Documents of which three tenths are alike, among those that have no exact copy."""
    from ..operators.tables import materialize

    words = materialize(read(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), f"{X.SPACE}+"), lambda x: x != "").alias("w")), "words")
    sets = words.select("doc_id", F.size("w").alias("tok"), F.array_distinct(F.transform(X.shingles(F.col("w"), 5), lambda s: F.xxhash64(s))).alias("hs"))
    classes = materialize(D.representatives(sets, "doc_id", "tok", "hs"), "classes")
    pairs = D.near_pairs(classes, "doc_id", "tok", "hs", 0.3, skip=classes.where("copies > 1").select("doc_id"))
    return pairs.withColumn("similarity", F.round("similarity", 2))


@query(f"""SELECT {P.path_sql()} AS path, 'hidden' || k AS name, round(least(1.0, 1 / 3.0::DOUBLE + 0.25 + 0.3 * 1 / 3.0::DOUBLE + 0.12 * 2 / 3.0::DOUBLE), 2)::DOUBLE AS score FROM {P._ROWS} WHERE k % 6 = 0""")
def lookup_functions(spark, d):
    """Functions ranked by a phrase that is spread over name, signature and body."""
    found = K.scan(P.files(spark, d), "functions").where("startswith(name, 'hidden')")
    rows = found.select("path", "name", F.regexp_replace("name", "[0-9]+$", "").alias("called"), F.lit("hidden").alias("told"), "body", "line")
    return L.lookup(rows, "hidden lib go", name="called", signature="told", body="body", key="path", limit=1 << 30).select("path", "name", "score")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 3 OR c_mktsegment = 'MACHINERY'")
def section_budget_medium(spark, d):
    rows = read(spark, d, "customer").withColumn("required", F.col("c_mktsegment") == "MACHINERY")
    return B.sections(rows, "c_nationkey", "c_custkey", "required", 2000).select("c_nationkey", "c_custkey")


_URLS = [("https://www.reddit.com/r/a~e~/x?utm=~k~", "https://old.reddit.com/r/a~e~/x"), ("reddit.com/r/b~k~", "https://old.reddit.com/r/b~k~"), ("https://example.com/~k~", None), ("http://new.reddit.com", "https://old.reddit.com/")]


@query(f"SELECT k, {pick_sql([u[1] for u in _URLS])} AS url FROM {P._ROWS}")
def thread_urls(spark, d):
    return P.rows(spark, d).select("k", W.thread_url(pick([u[0] for u in _URLS])).alias("url"))


_THREAD = '<a class="title x" href="/r/s~e~/1">T &amp; ~k~</a><div class="score unvoted"><span class="number">~s~</span></div><a class="bylink comments">2 comments</a><div class="usertext-body side"><div class="md"><p>about</p></div></div><div class="usertext-body may"><div class="md"><p>Body <b>~k~</b></p></div></div><div class=" thing comment x" data-depth="0"><a class="author id">ann~e~</a><span title="~s~ points">x</span><div class="usertext-body"><div class="md"><p>first &lt;~k~&gt;</p></div></div></div><div class="thing comment y" data-depth="1"><div class="usertext-body"><div class="md"><p>second</p></div></div></div><div class="thing comment z"></div>'


@query(f"SELECT k, unnest([1, 2])::INT AS nth, unnest(['ann' || e, '[deleted]']) AS author, unnest([s::VARCHAR, '']) AS score, unnest([0, 1])::INT AS depth, unnest(['first <' || k || '>', 'second']) AS body FROM {P._ROWS}")
def thread_comments(spark, d):
    return W.thread(P.rows(spark, d).select("k", P.fill(_THREAD).alias("html")), "k")


@query(f"SELECT k, 'T & ' || k AS title, 's' || e AS place, s::VARCHAR AS score, 'Body ' || k AS body, 2::INT AS comments FROM {P._ROWS}")
def thread_posts(spark, d):
    return P.rows(spark, d).select("k", W.post(P.fill(_THREAD)).alias("p")).select("k", "p.*")


@query("SELECT page_id, sha1(html) AS digest FROM pages WHERE page_id % 3 < 2")
def fetched_text(spark, d):
    """Bodies that came as Markdown or plain text are kept as they are."""
    kind = F.when(F.col("page_id") % 3 == 0, "text/markdown; charset=utf-8").when(F.col("page_id") % 3 == 1, "text/plain").otherwise("text/html")
    return read(spark, d, "pages").where("page_id % 3 < 2").select("page_id", F.sha1(W.as_text(kind, F.col("html"))).alias("digest"))


@query(f"SELECT 'packages/p' || k AS path, '@x/p' || k AS name FROM {P._ROWS} WHERE k % 3 = 0 UNION ALL SELECT 'apps/web' || k, 'web' || e FROM {P._ROWS} WHERE k % 3 = 1")
def workspace_packages(spark, d):
    """Packages that a workspace's patterns name."""
    files = P.rows(spark, d).select(pick(["packages/p~k~/package.json", "apps/web~k~/package.json", "other/z~k~/package.json"]).alias("path"), pick(['{"name":"@x/p~k~"}', '{"name":"web~e~","private":true}', '{"name":"z"}']).alias("content"))
    return U.workspace_packages(files, ["packages/*", "apps/*"])


_LONG = "npm run build -- --name=~k~   " + "x" * 200


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN 'ls -l ' || k ELSE substr('npm run build -- --name=' || k || ' ' || repeat('x', 200), 1, 177) || '...' END AS command FROM {P._ROWS}")
def compact_commands(spark, d):
    return P.rows(spark, d).select("k", U.compact_command(pick([" ls   -l\n~k~", _LONG])).alias("command"))


@query(f"SELECT 'V' || e AS name, true AS required, count(DISTINCT k) AS files FROM {P._ROWS} WHERE k % 6 = 2 GROUP BY e")
def required_variables(spark, d):
    """Environment variables, whether any use has no default, and in how many files they are read."""
    pattern = F.lit("(?:process[.]env[.]|getenv\\([\"']|environ\\[[\"'])([A-Za-z_][A-Za-z0-9_]*)[^\\n]{0,3}")
    uses = P.files(spark, d).select("path", F.explode(F.regexp_extract_all("content", pattern, F.lit(0))).alias("use"))
    named = uses.select("path", F.regexp_extract("use", "([A-Za-z_][A-Za-z0-9_]*)[^A-Za-z0-9_]{0,4}$", 1).alias("name"), (~F.col("use").rlike("[|?]{2}|, *['\"]")).alias("required"))
    return named.groupBy("name").agg(F.bool_or("required").alias("required"), F.countDistinct("path").alias("files"))


@query(f"""WITH t AS (SELECT k, k % 7 AS minor FROM {P._ROWS}), c AS (SELECT max(minor) AS m FROM t WHERE minor < 5), cut AS (SELECT min(k) AS at FROM t, c WHERE minor = m)
  SELECT section, count(*) AS n, list_position(['Features', 'Fixes', 'Docs', 'Other'], section)::INT AS place FROM (SELECT ['Features', 'Fixes', 'Docs', 'Other'][k % 4 + 1] AS section, k FROM {P._ROWS}), cut WHERE k > cut.at GROUP BY section""")
def notes_since_tag(spark, d):
    """Release notes of 1.5.0: what changed after the highest version below it."""
    rows = P.rows(spark, d)
    tags = rows.groupBy((F.col("k") % 7).alias("minor")).agg(F.min("k").alias("at")).select(F.concat(F.lit("v1."), F.col("minor").cast("string"), F.lit(".0")).alias("tag"), "at")
    changes = rows.select(pick(["feat: x~k~", "Fix y~k~", "docs: z~e~", "chore ~k~"]).alias("title"), F.col("k").alias("at"))
    return U.notes_since(tags, changes, "1.5.0")


@query("""SELECT user_id AS author, count(*) AS commits, count(DISTINCT event_type) AS files FROM events GROUP BY user_id ORDER BY commits DESC, author LIMIT 20""")
def busiest_authors(spark, d):
    from ..operators import history as H

    sums = H.author_summary(read(spark, d, "events"), "user_id", "event_type").select("author", "commits", "files")
    return sums.orderBy(F.desc("commits"), "author").limit(20)


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type = 'click' ELSE event_id % 600 <= 300 END AS valid FROM events")
def cache_validity(spark, d):
    """Whether cached results still hold: by commit where there is one, else by age."""
    commit = F.when(F.col("user_id") % 2 == 0, F.lit("click"))
    rows = read(spark, d, "events")
    return rows.select("event_id", E.still_valid(F.col("event_type"), commit, F.lit("x"), F.lit("x"), F.col("event_id") % 600).alias("valid"))
