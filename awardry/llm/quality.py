"""Operator 8: quality rules with adaptive thresholds.

Cutoffs are not fixed numbers. For each language and source a mergeable quantile sketch of four
text measures is kept: a histogram whose buckets have a relative width of 1/32 at most (whole
numbers below 64 are exact). Sketches merge by adding counts, so the result is the same in
whatever order partitions arrive. They hold the documents that pass the base rule, which is fixed.

Three measures are rates (symbols, repeated lines, repeated words), which most documents have none of. A rate
is measured by what its count surely shows, Z standard deviations of the count below it: one
repeated line is no rate. A sketch's fence for a rate lies

- in the first gap of its tail: between neighbouring buckets of which the upper is GAP times the lower one or more, with at
  most a share of 100 - HIGH per cent of the documents beyond, at their geometric mean (values up to RESOLUTION count as equal);
- where the tail has no gap, FENCE times as far from the median of its positive values as their 85th percentile lies.

The fourth, the mean length of words, has a fence on either side, FENCE times as far from the median as the
85th (below: 15th) percentile. A language's fence stands (that over everything, where a language has too few documents
or none). A source's own stands in its place if its width is within a factor of WIDER of it: a source may
widen or narrow a fence, but one that is junk for a seventh or more, so that its sketch shows no gap or a far
percentile, is judged by its language. Only DataFrame functions are used.

Edge cases: a null text counts as empty (no words; base_failed). Null lang or source form groups
of their own. Repeated rows each get a verdict, and count each. An empty table gives an empty
result. Other columns pass through; a column with the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, filled, join_small, stored

#: Rates per thousand: name -> (count, of how many).
RATES = {
    "symbols_permille": ("n_symbols", "n_words"),
    "dup_lines_permille": ("n_dup_lines", "n_lines"),
    "repeats_permille": ("n_repeat_words", "n_words"),
}
#: The mean length of words in hundredths of a character, which has a low fence too.
LENGTH = "word_length_centi"
MEASURES = (*RATES, LENGTH)
#: Percentiles of a sketch: low, median, high; distances from the median at which fences lie; standard deviations.
LOW, MIDDLE, HIGH, FENCE, Z = 15, 50, 85, 10, 3.0
#: A gap's upper end by its lower one; the rate in thousandths up to which values count as equal; a source's fence by its language's.
GAP, RESOLUTION, WIDER = 4, 10, 4
#: Sketches of fewer documents don't count.
LEAST_DOCS = 100
#: Up to so many repeated windows are looked up one by one.
FEW = 12
#: Threshold tables of up to so many rows are broadcast.
BROADCAST_ROWS = 50_000

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of FEATURES and n_lines, as long."""
    df = docs.drop(*FEATURES, "n_lines").withColumn("__text", filled(docs, text))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumns(
        {
            "n_symbols": (F.char_length("__text") - F.char_length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__words": F.filter(F.split("__text", f"[{SPACE}]+"), lambda w: w != ""),
        }
    ).drop("__text", "__lines")
    df = df.withColumns({"n_words": F.size("__words").cast("long"), "word_chars": F.char_length(F.array_join("__words", "")).cast("long")})
    # windows by their 64-bit hashes: two of one text's 20,000 windows clash once in 10^11 such texts
    inner = F.slice("__words", 1, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    df = df.withColumn("__hashes", F.transform(inner, lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))).drop("__words")
    df = df.withColumn("__sorted", F.sort_array("__hashes"))
    df = df.withColumn("__again", F.array_distinct(F.filter("__sorted", lambda h, i: F.coalesce(h == F.get("__sorted", i + 1), F.lit(False))))).drop("__sorted")
    places = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # a few repeated windows are looked up one by one; many are found by a sort, in n log n
    df = df.withColumn("__many", F.when(F.size("__again") > FEW, F.sort_array(places)))
    beside = lambda s, i, k: F.coalesce(s["h"] == F.get("__many", i + k)["h"], F.lit(False))
    df = df.withColumn(
        "__at",
        F.when(F.size("__again") == 0, F.array().cast("array<int>"))
        .when(F.size("__again") <= FEW, F.transform(F.filter(places, lambda s: F.array_contains("__again", s["h"])), lambda s: s["i"]))
        .otherwise(F.sort_array(F.transform(F.filter("__many", lambda s, i: beside(s, i, -1) | beside(s, i, 1)), lambda s: s["i"]))),
    )
    repeats = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0)).cast("long"))
    return df.drop("__again", "__hashes", "__many", "__at")


def measures() -> dict[str, Column]:
    """MEASURES from the columns of features(), as whole numbers; null without words."""
    number = lambda c: F.col(c).cast("double")
    sure = lambda n, of: F.floor(F.greatest(number(n) - F.sqrt(number(n)) * Z, F.lit(0.0)) * 1000.0 / F.expr(f"nullif({of}, 0)"))
    return {k: sure(*c) for k, c in RATES.items()} | {LENGTH: F.floor(F.col("word_chars") * 100 / F.expr("nullif(n_words, 0)"))}


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated windows of three words."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketches(featured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of each language and source."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures().items()])
    rows = featured.select("lang", "source", F.explode(values).alias("m")).where("m.v is not null")
    shift = F.greatest(F.length(F.bin("m.v")) - 6, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(m.v, __s), __s)")
    rows = rows.withColumn("__s", shift).select("lang", "source", "m.measure", bucket.alias("bucket"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """The sketches of the union of what each part has seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def level_fences(sketch: DataFrame, by: list[str], least_docs: int, fence: int) -> DataFrame:
    """(*by, measure, low, high) of the sketches merged to a level; a sketch of few documents has none."""
    level = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "measure")  # a row for each bucket: some hundreds at most
    ordered = part.orderBy("bucket")
    level = level.withColumns(
        {
            "upto": F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(part), "after": F.lead("bucket").over(ordered),
            "zeros": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(part),
        }
    )
    top = lambda c: F.expr(f"{c} + shiftleft(1L, greatest(length(bin({c})) - 6, 0)) - 1")  # noqa: E731  the bucket's greatest value
    begins = F.greatest(top("bucket"), F.lit(RESOLUTION))
    gap = (F.col("upto") * 100 >= F.col("total") * HIGH) & (F.col("after") >= begins * GAP)
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    positive = lambda q: F.min(F.when((F.col("bucket") > 0) & ((F.col("upto") - F.col("zeros")) * 100 >= (F.col("total") - F.col("zeros")) * q), F.col("bucket")))
    level = level.groupBy(*by, "measure").agg(
        at(LOW).alias("a"), at(MIDDLE).alias("m"), at(HIGH).alias("b"), positive(MIDDLE).alias("pm"), positive(HIGH).alias("pb"), F.max("total").alias("total"), F.max("zeros").alias("zeros"),
        F.min(F.when(gap, F.floor(F.sqrt((begins * F.col("after")).cast("double"))))).alias("gap"),
    )
    tail = F.when(F.col("total") - F.col("zeros") >= least_docs, F.col("pm") + (top("pb") - F.col("pm")) * fence)
    length = F.col("measure") == LENGTH
    low = F.when(length, top("m") - (top("m") - F.col("a")) * fence)
    high = F.when(length, F.col("m") + (top("b") - F.col("m")) * fence).otherwise(F.coalesce("gap", tail))
    enough = F.col("total") >= (least_docs if by else 0)
    return level.select(*by, "measure", F.when(enough, low).alias("low"), F.when(enough, high).alias("high"))


def thresholds(sketch: DataFrame, least_docs: int = LEAST_DOCS, fence: int = FENCE) -> DataFrame:
    """One row for each (lang, source): __low_<measure> and __high_<measure>, null where nothing is too low or too high."""
    groups = sketch.select("lang", "source", "measure").distinct()
    for rank, by in enumerate((["lang", "source"], ["lang"], [])):
        level = level_fences(sketch, by, least_docs, fence)
        right = level.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("measure").alias("__measure"), F.when(F.col("high").isNotNull(), F.struct("low", "high")).alias(f"t{rank}"))
        on = [groups[c].eqNullSafe(right[f"__{c}"]) for c in by] + [groups["measure"] == right["__measure"]]
        groups = groups.join(right, on, "left").drop("__measure", *[f"__{c}" for c in by])
    groups = groups.withColumn("above", F.coalesce("t1", "t2"))
    width = lambda t: F.col(f"{t}.high") - F.coalesce(f"{t}.low", F.lit(0))
    own = (width("t0") <= width("above") * WIDER) & (width("t0") * WIDER >= width("above"))
    groups = groups.select("lang", "source", "measure", F.when(own, F.col("t0")).otherwise(F.col("above")).alias("t"))
    return groups.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == k, F.col(f"t.{side}"))).alias(f"__{side}_{k}") for k in MEASURES for side in ("low", "high")]
    )


def quality_rules(
    docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, fence: int = FENCE, carry_text: bool = True
) -> DataFrame:
    """docs with FEATURES, n_lines, base_failed and kept; without the text unless carry_text.

    Both the sketches and the filter need the counts, so these are stored once, with the texts if they are carried.
    kept: not base_failed, and no measure lies beyond the fences of the document's language and source.
    """
    featured = features(docs, text)
    featured = stored(featured if carry_text else featured.drop(text), "quality_features")
    limits = stored(thresholds(sketches(featured.where(~base_failed())), least_docs, fence), "quality_thresholds")
    out = join_small(featured, limits, ["lang", "source"], BROADCAST_ROWS)
    beyond = F.lit(False)
    for k, v in measures().items():
        beyond = beyond | F.coalesce(v > F.col(f"__high_{k}"), F.lit(False)) | F.coalesce(v < F.col(f"__low_{k}"), F.lit(False))
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | beyond))
    return out.drop(*[c for c in limits.columns if c not in ("lang", "source")])


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_rules(docs, carry_text=False).select("doc_id", *FEATURES, "base_failed", "kept")


_BEYOND = " or ".join(f"coalesce(v_{k} > high_{k}, false) or coalesce(v_{k} < low_{k}, false)" for k in MEASURES)
_TOP = "({0} + (1::bigint << greatest(length(bin({0})) - 6, 0)::bigint) - 1)"
_BASE = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
_SURE = "floor(greatest({0}::double - sqrt({0}::double) * 3.0, 0.0) * 1000.0 / nullif({1}, 0))::bigint"
_BEGINS = f"greatest({_TOP.format('bucket')}, {RESOLUTION})"


def quality_sql(documents: str = "documents", tail: str = "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged") -> str:
    """The same by DuckDB; judged has every row of documents with the verdicts."""
    values = " union all ".join(f"select lang, source, '{k}' as measure, v_{k} as v from measured where not {_BASE}" for k in MEASURES)
    pivot = ", ".join(f"max(case when measure = '{k}' then {s} end) as {s}_{k}" for k in MEASURES for s in ("low", "high"))
    return rf"""
with src as (select *, row_number() over () as rid, coalesce(text, '') as t from {documents}),
words as (select rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from src),
tri as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w
    from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from words where len(ws) > 2)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from tri) where c > 1),
covered as (select rid, count(distinct i + k) as n from twice, (values (0), (1), (2)) as o(k) group by rid),
counted as (select src.rid, src.doc_id, src.lang, src.source, len(ws)::bigint as n_words,
    length(array_to_string(ws, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
    from src join words on src.rid = words.rid left join covered on src.rid = covered.rid),
measured as (select *, {", ".join(f"{_SURE.format(n, of)} as v_{k}" for k, (n, of) in RATES.items())}, word_chars * 100 // nullif(n_words, 0) as v_{LENGTH} from counted),
vals as (select lang, source, measure, (v >> s) << s as bucket from (select *, greatest(length(bin(v)) - 6, 0)::bigint as s from ({values}) where v is not null)),
sk as (select lang, source, measure, bucket, count(*) as n from vals group by all),
lev as (select 0 as tier, lang, source, measure, bucket, n from sk
    union all select 1, lang, null, measure, bucket, sum(n) from sk group by lang, measure, bucket
    union all select 2, null, null, measure, bucket, sum(n) from sk group by measure, bucket),
cum as (select *, sum(n) over w as upto, sum(n) over p as total, lead(bucket) over w as after, sum(case when bucket = 0 then n else 0 end) over p as zeros
    from lev window p as (partition by tier, lang, source, measure), w as (partition by tier, lang, source, measure order by bucket)),
ends as (select tier, lang, source, measure, max(total) as total, max(zeros) as zeros,
    min(case when upto * 100 >= total * {LOW} then bucket end) as a, min(case when upto * 100 >= total * {MIDDLE} then bucket end) as m, min(case when upto * 100 >= total * {HIGH} then bucket end) as b,
    min(case when bucket > 0 and (upto - zeros) * 100 >= (total - zeros) * {MIDDLE} then bucket end) as pm, min(case when bucket > 0 and (upto - zeros) * 100 >= (total - zeros) * {HIGH} then bucket end) as pb,
    min(case when upto * 100 >= total * {HIGH} and after >= {_BEGINS} * {GAP} then floor(sqrt(({_BEGINS} * after)::double)) end)::bigint as gap
    from cum group by tier, lang, source, measure),
quart as (select * from (select tier, lang, source, measure,
    case when measure = '{LENGTH}' then {_TOP.format('m')} - ({_TOP.format('m')} - a) * {FENCE} end as low,
    case when measure = '{LENGTH}' then m + ({_TOP.format('b')} - m) * {FENCE} else coalesce(gap, case when total - zeros >= {LEAST_DOCS} then pm + ({_TOP.format('pb')} - pm) * {FENCE} end) end as high
    from ends where tier = 2 or total >= {LEAST_DOCS}) where high is not null),
fences as (select lang, source, measure, case when own then low0 else low1 end as low, case when own then high0 else high1 end as high from (
    select *, coalesce(high0 - coalesce(low0, 0) <= (high1 - coalesce(low1, 0)) * {WIDER} and (high0 - coalesce(low0, 0)) * {WIDER} >= high1 - coalesce(low1, 0), false) as own from (
    select g.lang, g.source, g.measure, a.low as low0, a.high as high0, case when b.high is null then c.low else b.low end as low1, coalesce(b.high, c.high) as high1
    from (select distinct lang, source, measure from sk) g
    left join quart a on a.tier = 0 and a.measure = g.measure and a.lang is not distinct from g.lang and a.source is not distinct from g.source
    left join quart b on b.tier = 1 and b.measure = g.measure and b.lang is not distinct from g.lang
    left join quart c on c.tier = 2 and c.measure = g.measure))),
limits as (select lang, source, {pivot} from fences group by lang, source),
judged as (select m.*, {_BASE} as base_failed, not ({_BASE} or {_BEYOND}) as kept
    from measured m left join limits on m.lang is not distinct from limits.lang and m.source is not distinct from limits.source)
{tail}"""


ORACLE = quality_sql()
