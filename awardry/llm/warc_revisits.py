"""Operator 5: not-modified revisits of web captures, resolved by an as-of join.

A revisit (a 304 answer, or a record whose profile is "server-not-modified") has no payload. It is joined to the
latest earlier full response of the same canonical URL. Its validators are compared with that
response's (entity tag first, by weak comparison; else the date of last change): if they agree, the
revisit takes the response's payload and headers, and the headers that a 304 answer may carry
replace those of the response. If they differ, or the response has none of them, the outcome says
so and nothing is merged. A response counts as earlier if its date is smaller, or equal and its record id smaller.

The join takes no window over a whole URL: captures are cut into slots at quantiles of their dates,
and those of a date that fills slots alone at quantiles of their record ids, so that slots hold about
equally many captures however these cluster. Inside a slot the last response is carried forward, and a
slot without one takes the last of the slots before, which are aggregated before the shuffle to a row
each. So a URL with a third of all captures is spread over its slots.

Columns: record_id (long), url, date (long), status (int), headers (map<string,string>, any case),
payload_digest and, if there, profile. Edge cases: records with a null URL or date are returned as
unresolved ("orphan"). Null headers count as none. Repeated records are each returned; of responses with
one date and record id that with the greatest digest stands. Records that aren't not-modified revisits aren't in the result, and one
with another profile (identical payload) is no full response. Very long URLs and headers are carried
whole. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots into which the captures are cut: at least, records in each at most, and at most.
SLOTS, SLOT_ROWS, MAX_SLOTS = 64, 1_000_000, 1024
#: Headers which a 304 answer may carry and which then replace the stored ones (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Fixed value: how the profile of a not-modified revisit ends (WARC 1.0 and 1.1).
NOT_MODIFIED = "server-not-modified"
#: Query parameters that only say where a visit came from.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> Column:
    """A URL without scheme, "www.", default port, fragment, tracking parameters and final slash; host in lower case."""
    rest = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the last stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), last(n).alias("value"))))


def cuts(records: DataFrame, column: str, slots: int) -> list[int]:
    """The inner quantiles of a column of integers, in order; a value that holds several slots comes several times."""
    at = F.percentile_approx(column, [i / slots for i in range(1, slots)] or [0.5], 10 * slots + 1000)
    return sorted(records.agg(at).first()[0] or [])


def slot_of(records: DataFrame, slots: int) -> Column:
    """A number for each record that rises with date and record id, strictly between slots."""
    dates = cuts(records, "date", slots)
    alone = sorted({d for d in dates if dates.count(d) > 1})
    before = lambda values, x: F.size(F.filter(F.array(*map(F.lit, values)).cast("array<bigint>"), lambda v: v < x))
    date, record = F.col("date"), F.col("record_id")
    own = F.lit(False)
    inside = F.lit(0)
    if alone:  # dates with slots of their own, cut by record id
        own = date.isin(alone)
        inside = F.when(own, before(cuts(records.where(own), "record_id", slots), record)).otherwise(0)
    return (before(sorted(set(dates)), date) * 2 + own.cast("int")).cast("long") * (slots + 1) + inside


def with_earlier(records: DataFrame, key: str, slots: int | None = None) -> DataFrame:
    """records with earlier: the latest full response (struct) of the same key before each record.

    records has key, date, record_id, is_response, payload_digest and the struct "response".
    """
    slots = slots or min(MAX_SLOTS, max(SLOTS, records.count() // SLOT_ROWS))
    records = records.withColumn("slot", slot_of(records, slots))
    order = F.struct("date", "record_id", "payload_digest")
    lasts = records.where("is_response").groupBy(key, "slot").agg(F.max_by("response", order).alias("last"))
    seen = Window.partitionBy(key).orderBy("slot")  # a row for each slot at most
    inside = Window.partitionBy(key, "slot").orderBy("date", "record_id", "is_response", "payload_digest").rowsBetween(Window.unboundedPreceding, -1)
    records = records.withColumn("here", F.last(F.when(F.col("is_response"), F.col("response")), ignorenulls=True).over(inside))
    # the slots with records, each with the last response of the slots before it
    spans = records.select(key, "slot").distinct().join(lasts, [key, "slot"], "left")
    spans = spans.withColumn("before", F.last("last", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.where("before is not null").select(key, "slot", "before")
    return records.join(spans, [key, "slot"], "left").withColumn("earlier", F.coalesce("here", "before")).drop("here", "before", "slot")


def resolve_revisits(records: DataFrame, slots: int | None = None) -> DataFrame:
    """For each revisit: record_id, canonical_url, outcome, source_id, payload_digest and headers (merged, sorted map).

    outcome: "resolved", "changed" (validators differ), "unverified" (no validator to compare) or "orphan".
    """
    profile = F.col("profile") if "profile" in records.columns else F.lit(None)
    rows = records.select("record_id", "url", "date", "status", lowered(F.col("headers")).alias("headers"), "payload_digest", profile.cast("string").alias("profile"))
    rows = rows.withColumn("canonical_url", canonical(F.col("url")))
    not_modified = F.coalesce(F.lower("profile").endswith(NOT_MODIFIED), F.lit(False))
    rows = rows.withColumn("is_revisit", not_modified | (F.col("profile").isNull() & F.coalesce(F.col("status") == 304, F.lit(False))))
    rows = rows.withColumn("is_response", F.coalesce(F.col("status") == 200, F.lit(False)) & F.col("payload_digest").isNotNull() & F.col("profile").isNull())
    rows = rows.withColumn("response", F.struct("record_id", "headers", "payload_digest"))
    whole = F.col("url").isNotNull() & F.col("date").isNotNull()
    joined = with_earlier(rows.where(whole), "canonical_url", slots).where("is_revisit")
    lost = rows.where(~whole & F.col("is_revisit")).withColumn("earlier", F.lit(None).cast(joined.schema["earlier"].dataType))
    both = joined.select(*lost.columns).unionByName(lost)
    tag = lambda m: F.regexp_replace(F.try_element_at(m, F.lit("etag")), "^W/", "")
    changed = lambda m: F.try_element_at(m, F.lit("last-modified"))
    own, old = F.col("headers"), F.col("earlier.headers")
    same = F.coalesce(tag(own) == tag(old), changed(own) == changed(old))
    outcome = (
        F.when(F.col("earlier").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    )
    new = F.map_filter(own, lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    good = outcome == "resolved"
    return both.select(
        "record_id", "canonical_url", outcome.alias("outcome"),
        F.when(good, F.col("earlier.record_id")).alias("source_id"),
        F.when(good, F.col("earlier.payload_digest")).alias("payload_digest"),
        F.when(good, merged).alias("headers"),
    )


#: The page of a capture was fetched at page_id; the revisit came so much later.
REVISIT_AFTER = 1000


def captures(pages: DataFrame) -> DataFrame:
    """Two records for each page: its capture, with validators, and a later revisit that asks with these validators.

    Pages give no record stream of their own. A capture has the page's URL, the date page_id, an entity tag
    from the html and the language's header; the revisit has the URL without what follows ``?`` or
    ``#``, a date REVISIT_AFTER later and a header that may be merged and one that may not. Where
    another capture of the same canonical URL comes between, the tags differ.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    language = F.regexp_extract(F.coalesce("html", F.lit("")), 'lang="([a-z]*)"', 1)
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("date"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Language"), language, F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
        digest.alias("payload_digest"),
    )
    later = F.col("page_id") + REVISIT_AFTER
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", r"(?s)[?#].*$", "").alias("url"), later.alias("date"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), later.cast("string"), F.lit("content-language"), F.lit("xx")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)


def op5_warc_revisits(spark, sf_dir) -> DataFrame:
    """source_page_id is -1 where nothing is merged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve_revisits(captures(pages))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return found.select(page("record_id").alias("page_id"), "canonical_url", "outcome", F.coalesce(page("source_id"), F.lit(-1)).alias("source_page_id"), "payload_digest", listed.alias("headers"))


_HOST = rf"regexp_replace(regexp_replace(translate(regexp_extract(r, '^([^/?]*)', 1), '{UPPER}', '{LOWER}'), ':(80|443)$', ''), '^www\.', '')"
_QUERY = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\?((?s:.)*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^({TRACKING})(=|$)'))), '&')"
ORACLE = rf"""
with rec as (select page_id, url as u, page_id as d, 0 as k, html from pages
  union all select page_id, regexp_replace(url, '[?#](?s:.)*$', ''), page_id + {REVISIT_AFTER}, 1, html from pages),
raw as (select *, regexp_replace(regexp_replace(u, '#(?s:.)*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as r, md5(coalesce(html, '')) as dig from rec),
parts as (select *, {_HOST} || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/$', '') as base, {_QUERY} as q from raw),
c as (select *, base || case when q <> '' then '?' || q else '' end as cu from parts),
j as (select v.page_id, v.cu, v.dig, v.d, f.page_id as fp, f.dig as fdig, regexp_extract(coalesce(f.html, ''), 'lang="([a-z]*)"', 1) as lang,
  row_number() over (partition by v.page_id order by f.d desc, f.page_id desc) as n
  from c v left join c f on f.k = 0 and f.cu = v.cu and (f.d < v.d or (f.d = v.d and f.page_id * 2 < v.page_id * 2 + 1)) where v.k = 1)
select page_id, cu as canonical_url, case when fp is null then 'orphan' when left(dig, 12) = left(fdig, 12) then 'resolved' else 'changed' end as outcome,
  case when left(dig, 12) = left(fdig, 12) then fp else -1 end as source_page_id, case when left(dig, 12) = left(fdig, 12) then fdig end as payload_digest,
  case when left(dig, 12) = left(fdig, 12) then 'content-language=' || lang || ';date=' || d || ';etag=W/"' || left(dig, 12) || '"' end as headers
from j where n = 1
"""
