"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers that a not-modified answer may change in the stored response (fixed
#: values of the HTTP caching standard); all others stay as stored.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

#: Pieces that the captures of one URL are cut into along time.
PIECES = 64


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, default port, fragment, tracking parameters, index pages and a last slash dropped."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "/index[.]html?$", "/"), "/+$", "")
    return F.concat(host, rest)


def resolve_revisits(records: DataFrame, pieces: int = PIECES) -> DataFrame:
    """Give each revisit the latest earlier full response of its canonical URL.

    ``records``: record_id BIGINT, url STRING, at BIGINT (capture time), kind
    STRING (response or revisit), etag STRING, modified STRING, headers
    MAP<STRING, STRING>; other columns are left aside. One row per record:
    record_id, canonical_url, kind, at, refers_to (record_id of the response),
    outcome, headers.

    outcome is full for a response; for a revisit resolved, mismatch (its etag,
    or without one its modified, differs from the response's), unvalidated (no
    validator on either side to compare; it still refers to the response) or
    missing (no earlier response). A resolved revisit has the response's headers,
    with those permitted replaced by its own; others keep their own. Records of
    one URL and time are in order of record_id, and a response serves revisits
    of its own time with larger record_id. Null urls, times or kinds match
    nothing: outcome missing (full for a response). Repeated rows stay.

    As-of without one task per URL: time is cut into pieces, the last response
    is searched within (url, piece) and else taken from the latest earlier piece
    that has one, found over one row per (url, piece).
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "kind", "at", "etag", "modified", "headers")
    span = r.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // pieces + 1)
    r = r.withColumn("_piece", F.expr(f"(at - {span['a'] or 0}L) div {width}L"))
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    full = F.when((F.col("kind") == "response") & usable, F.struct("at", "record_id", "etag", "modified", "headers"))
    order = W.partitionBy("canonical_url", "_piece").orderBy("at", "record_id")
    within = r.withColumn("_full", full).withColumn("_near", F.last("_full", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    ends = within.where("_full IS NOT NULL").groupBy("canonical_url", "_piece").agg(F.max_by("_full", F.struct(F.col("_full.at"), F.col("_full.record_id"))).alias("_end"))
    asked = within.where("_near IS NULL AND kind = 'revisit'").select("canonical_url", "_piece").distinct()
    both = ends.unionByName(asked.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))).groupBy("canonical_url", "_piece").agg(F.max_by("_end", F.col("_end.at")).alias("_end"))
    # at most ``pieces`` rows for each URL
    carried = both.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.where("_before IS NOT NULL").select(F.col("canonical_url").alias("_u"), F.col("_piece").alias("_p"), "_before")
    found = within.join(carried, (F.col("canonical_url") == F.col("_u")) & (F.col("_piece") == F.col("_p")), "left")
    found = found.withColumn("_of", F.when((F.col("kind") == "revisit") & usable, F.coalesce("_near", "_before")))
    strong = F.col("etag").isNotNull() & F.col("_of.etag").isNotNull()
    weak = F.col("modified").isNotNull() & F.col("_of.modified").isNotNull()
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(F.col("kind") == "response", "full").when(F.col("_of").isNull(), "missing")
        .when(strong, F.when(bare(F.col("etag")) == bare(F.col("_of.etag")), "resolved").otherwise("mismatch"))
        .when(weak, F.when(F.col("modified") == F.col("_of.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    none = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("headers", none), F.coalesce(F.col("_of.headers"), none)
    changed = F.map_filter(own, lambda k, _: F.lower(k).isin(PERMITTED))
    kept = F.map_filter(stored, lambda k, _: ~F.exists(F.map_keys(changed), lambda c: F.lower(c) == F.lower(k)))
    found = found.withColumn("outcome", outcome)
    refers = F.when(F.col("outcome").isin("resolved", "unvalidated"), F.col("_of.record_id"))
    return found.select("record_id", "canonical_url", "kind", "at", refers.alias("refers_to"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, changed)).otherwise(own).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two crawls of a table of pages (page_id, url, html) as WARC records.

    The first crawl fetches every page in order of page_id, with the SHA-256 of
    its content as etag. The second asks for every page again, in that order and
    with the etag it was given, and is answered "not modified", with a new date
    and a server header that a merge must not take over.
    """
    text = lambda prefix: F.concat(F.lit(prefix), F.col("page_id").cast("string"))
    crawl = (pages.agg(F.max("page_id").alias("m")).first()["m"] or 0) + 1
    etag = F.concat(F.lit('"'), F.sha2(F.coalesce("html", F.lit("")), 256), F.lit('"'))
    rows = pages.select("page_id", "url", etag.alias("etag"), F.lit(None).cast("string").alias("modified"))
    first = F.struct((2 * F.col("page_id")).alias("record_id"), F.col("page_id").alias("at"), F.lit("response").alias("kind"), F.create_map(F.lit("Date"), text("d"), F.lit("Server"), F.lit("one"), F.lit("Content-Type"), F.lit("text/html")).alias("headers"))
    again = F.struct((2 * F.col("page_id") + 1).alias("record_id"), (F.col("page_id") + crawl).alias("at"), F.lit("revisit").alias("kind"), F.create_map(F.lit("date"), text("e"), F.lit("server"), F.lit("two")).alias("headers"))
    return rows.select("url", "etag", "modified", F.explode(F.array(first, again)).alias("_r")).select("url", "etag", "modified", "_r.*")
