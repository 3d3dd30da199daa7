"""Web pages: addresses, discussion threads, and what was fetched as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

#: Hosts that stand for one site, and the host that is read.
THREAD_HOSTS, THREAD_HOST = ("www.reddit.com", "reddit.com", "new.reddit.com", "old.reddit.com"), "old.reddit.com"


#: Where a thread's page says what.
TITLE = '(?s)<a class="title[^"]*"[^>]*>(.*?)</a>'
SCORE = '(?s)<div class="score[^"]*"[^>]*>.*?<span class="number">([0-9.,]+)</span>'
COMMENTS = '<a[^>]*class="[^"]*comments[^"]*"[^>]*>([0-9]+) +comments?</a>'
COMMENT, BODY, MARKED = 'class="[^"]*\\bcomment\\b[^"]*"', 'class="usertext-body[^"]*"', '(?s)^[^>]*>\\s*<div class="md">(.*?)</div>'
AUTHOR, POINTS, DEPTH = 'class="author[^"]*"[^>]*>([^<]+)</a>', 'title="(\\d+) points?"', 'data-depth="(\\d+)"'


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def thread_url(url: Column) -> Column:
    """The address under which a thread is read, without its query; null for any other site."""
    whole = with_scheme(url)
    host = F.lower(F.regexp_extract(whole, "(?i)^https?://([^/?#]+)", 1))
    path = F.regexp_extract(whole, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.when(host.isin(*THREAD_HOSTS), F.concat(F.lit(f"https://{THREAD_HOST}"), F.when(path == "", "/").otherwise(path)))


def as_text(content_type: Column, body: Column) -> Column:
    """What is kept of a fetched body: Markdown and plain text as they are, pages as Markdown."""
    kind = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    return F.when(kind == "text/markdown", body).when(kind.contains("html"), X.markdown(body)).otherwise(body)


def _plain(html: Column) -> Column:
    inner = F.regexp_extract(html, MARKED, 1)
    return F.trim(X.decode_entities(X.strip_tags(inner)))


def thread(pages: DataFrame, key: str, html: str = "html", most: int = 50) -> DataFrame:
    """key, nth, author, score, depth, body of the comments of a thread's page, the first ``most``; comments without author and body are passed over."""
    areas = F.slice(F.split(html, COMMENT, -1), 2, 1 << 20)
    rows = pages.select(key, F.posexplode(areas).alias("at", "area"))
    author = F.nullif(F.regexp_extract("area", AUTHOR, 1), F.lit(""))
    body = _plain(F.coalesce(F.get(F.split("area", BODY, -1), F.lit(1)), F.lit("")))
    depth = F.coalesce(F.nullif(F.regexp_extract("area", DEPTH, 1), F.lit("")).cast("int"), F.lit(0))
    told = rows.select(key, "at", author.alias("a"), F.regexp_extract("area", POINTS, 1).alias("score"), depth.alias("depth"), body.alias("b")).where("a is not null or b <> ''")
    nth = F.row_number().over(_within(key))
    return told.select(key, nth.alias("nth"), F.coalesce("a", F.lit("[deleted]")).alias("author"), "score", "depth", F.when(F.col("b") == "", "[deleted]").otherwise(F.col("b")).alias("body")).where(F.col("nth") <= most)


def _within(key: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy("at")


def post(html: Column) -> Column:
    """title, place, score, body and comments (their number) of a thread's page."""
    parts = F.split(html, BODY, -1)
    title = F.nullif(F.trim(X.decode_entities(X.strip_tags(F.regexp_extract(html, TITLE, 1)))), F.lit(""))
    return F.struct(
        F.coalesce(title, F.lit("(no title)")).alias("title"),
        F.regexp_extract(html, "/r/([A-Za-z0-9_]+)", 1).alias("place"),
        F.regexp_extract(html, SCORE, 1).alias("score"),
        _plain(F.coalesce(F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.lit(""))).alias("body"),
        F.nullif(F.regexp_extract(html, COMMENTS, 1), F.lit("")).cast("int").alias("comments"),
    )
