"""WARC: resolving revisits that a server answered with "not modified".

A revisit record takes the latest earlier full response of the same canonical
URL. Its validators are checked, and the headers that a 304 answer may update
are merged into those of the response.

The as-of join has two levels, so that one URL with a third of all records is
not one task: within spans of time of a URL, and over one row for each span.
Only keys and times are sorted; headers are joined afterwards by record number and
payloads stay where they are, referred to by digest.

Defined results: ``resolved`` when at least one validator is on both sides and
all such agree (entity tags by weak comparison); ``mismatch`` when one differs;
``unverified`` when none is on both sides; ``orphan`` without an earlier
response, also for null URLs. A response at the very time of the revisit is not
earlier; of several at the latest time the greatest record id counts. Header names are compared and
returned in lower case, null headers are none. Records are told apart by a number
of their own, so revisits with equal or null record ids, and repeated ones, are
resolved one by one, and so are responses. A record without a time is neither
earlier nor later than any: such a revisit is an orphan. An empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.llm.shared import let, materialize

#: Headers that a 304 answer must not change in a stored response.
KEPT_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Time units of one span of the two-level as-of join.
SPAN = 1024
#: Time units after which the crawl of `captures` asks again for a page.
REVISIT_AFTER = 5000


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme and default port, path, sorted query.

    Fragments, tracking parameters (``utm_*``, ``ref``) and one trailing slash
    of the path are dropped.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def captures(pages: DataFrame, revisit_after: int = REVISIT_AFTER) -> DataFrame:
    """Each page as a full response, and a later revisit that was not modified.

    record_id, kind, url, time, headers, payload_digest. The revisit repeats
    the entity tag (weak) of the page's own response, as a server would confirm
    it, with headers of its own.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    page = F.col("page_id").cast("long")
    first = pages.select(
        (page * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        page.alias("time"),
        F.create_map(
            F.lit("content-length"), size,
            F.lit("content-type"), F.lit("text/html"),
            F.lit("date"), page.cast("string"),
            F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')),
        ).alias("headers"),
        tag.alias("payload_digest"),
    )
    again = pages.select(
        (page * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        "url",
        (page + revisit_after).alias("time"),
        F.create_map(
            F.lit("cache-control"), F.lit("max-age=60"),
            F.lit("content-length"), F.lit("0"),
            F.lit("date"), (page + revisit_after).cast("string"),
            F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"')),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return first.unionByName(again)


def latest_earlier(records: DataFrame, span: int = SPAN) -> DataFrame:
    """number and refers (the number of the response) of each revisit that has one; keys and times only."""
    rows = records.filter(F.col("key").isNotNull() & F.col("time").isNotNull()).select(  # no hot key of nulls
        "number",
        "record_id",
        (F.col("kind") == "response").alias("full"),
        "key",
        F.col("time").cast("long").alias("time"),
        F.floor(F.col("time") / span).alias("bin"),
    )
    mark = F.when(F.col("full"), F.struct("time", "record_id", "number"))
    rows = rows.withColumn("mark", mark)
    inside = Window.partitionBy("key", "bin").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("key", "bin").agg(F.max("mark").alias("last"))
    bins = bins.select("key", "bin", F.max("last").over(before).alias("carried"))
    near = rows.withColumn("near", F.max("mark").over(inside)).filter(~F.col("full"))
    found = near.join(bins, ["key", "bin"], "left")
    return found.select("number", F.coalesce("near", "carried")["number"].alias("refers")).filter("refers IS NOT NULL")


def plain_headers(headers: Column) -> Column:
    """Names in lower case; of names that differ in case alone the first in order counts; null is none."""
    none = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.map_entries(F.coalesce(headers, none)))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return let(lower, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: F.array_position(F.transform(all_, lambda x: x["key"]), e["key"]) == i + 1)))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those of the 304 answer that may replace them."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    old = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(old), F.map_entries(allowed))))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records``: record_id, kind, url, time, headers, payload_digest. Output: record_id, key, time, status, refers_to, headers
    (merged if resolved, else the revisit's own), payload_digest.
    """
    keyed = records.select("record_id", "kind", canonical_url(F.col("url")).alias("key"), "time", plain_headers(F.col("headers")).alias("headers"), "payload_digest")
    keyed = materialize(keyed.withColumn("number", F.monotonically_increasing_id()), "warc-records")
    stored = keyed.filter(F.col("kind") == "response").select(
        F.col("number").alias("refers"), F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), F.col("payload_digest").alias("stored_digest")
    )
    found = latest_earlier(keyed, span).join(stored, "refers")
    rows = keyed.filter(F.col("kind") == "revisit").drop("payload_digest").join(found, "number", "left")
    pairs = {
        "etag": (weak_tag(F.col("headers")["etag"]), weak_tag(F.col("stored")["etag"])),
        "last-modified": (F.col("headers")["last-modified"], F.col("stored")["last-modified"]),
    }
    same = F.array(*[a == b for a, b in pairs.values()])
    status = (
        F.when(F.col("refers").isNull(), "orphan")
        .when(F.exists(same, lambda x: ~x), "mismatch")
        .when(F.exists(F.array_compact(same), lambda x: x), "resolved")
        .otherwise("unverified")
    )
    rows = rows.withColumn("status", status)
    done = F.col("status") == "resolved"
    return rows.select(
        "record_id",
        "key",
        "time",
        "status",
        "refers_to",
        F.when(done, merge_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("stored_digest")).alias("payload_digest"),
    )
