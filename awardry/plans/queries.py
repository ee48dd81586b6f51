"""Queries of the award operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, predicates, scores, text
from ..functions.patterns import all_matches
from ..operators import boolean_query, consolidate, embedding, entities, gram_index, inflation, ingest, keyword_index, outliers, reports, search, statistics
from ..streaming.keyed import latest, upserted
from ..streaming.running import ERROR, running_sketches, running_statistics, statistics_of
from ..working import new_path
from . import adapters as A
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles with so many digits; medians with four, as they may end with half a cent."""
    places = lambda c: 4 if c.startswith("median") else digits
    return df.select(*[F.round(c, places(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stats_sql(by: str, source: str) -> str:
    money = "case when amount > 0 then coalesce(nullif(adjusted, 0), amount) end"
    award = "case when amount > 0 then amount end"
    five = lambda e, n: ", ".join(f"round(coalesce({f}({e}), 0), {2 if k in ('mean', 'std') else 4}) as {k}_{n}" for k, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")))
    return f"""select {by}, count(*) as total_cases, count({award}) as cases_with_award, {five(award, 'award')}, {five(money, 'adjusted')},
  min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year from {source} group by {by}"""


@query(f"with {A.ADJUSTED_SQL} {stats_sql('category', 'adj')}")
def adjusted_stats_by_category(spark, sf_dir):
    return rounded(statistics.award_statistics(A.adjusted_cases(spark, sf_dir), ["category"]), 2)


@query(f"with {A.JUDGED_SQL} {stats_sql('judge', 'jc')}")
def adjusted_stats_by_judge(spark, sf_dir):
    return rounded(statistics.award_statistics(entities.judge_cases(A.judged_cases(spark, sf_dir), tasks=A.line_tasks(spark, sf_dir)), ["judge"]), 2)


@query(f"with {A.ADJUSTED_SQL} select id, year, amount, adjusted, round(coalesce(nullif(adjusted, 0), amount) - amount, 4) as delta, round((adjusted - amount) / nullif(amount, 0) * 100, 4) as delta_percent from adj")
def inflation_adjust(spark, sf_dir):
    delta, percent = inflation.change(inflation.in_money(F.col("adjusted"), F.col("amount")), F.col("amount"))
    return A.adjusted_cases(spark, sf_dir).select("id", "year", "amount", "adjusted", F.round(delta, 4).alias("delta"), F.round(percent, 4).alias("delta_percent"))


@query(f"""with {A.CPI_SQL}, {A.CASES_SQL}, y as (select distinct year from cases)
select a.year as start_year, b.year as end_year, round((t.cpi - f.cpi) / f.cpi * 100, 2) as rate
from y a join y b on a.year < b.year left join cpi f on f.year = a.year left join cpi t on t.year = b.year""")
def inflation_rate(spark, sf_dir):
    years = A.cases(spark, sf_dir).select("year").distinct()  # a row for each year
    ends = years.select(F.col("year").alias("end_year"))
    if ends.count() > 10_000:
        raise ValueError("years are some hundred at most")
    pairs = years.select(F.col("year").alias("start_year")).join(F.broadcast(ends), F.col("start_year") < F.col("end_year"))
    return inflation.rate(pairs, A.cpi(spark))


@query(f"with {A.JUDGED_SQL} select judge, year as value, count(*) as n from jc group by 1, 2")
def judge_distributions(spark, sf_dir):
    return statistics.distribution(entities.judge_cases(A.judged_cases(spark, sf_dir), tasks=A.line_tasks(spark, sf_dir)), ["judge"], F.col("year"))


@query(f"with {A.JUDGED_SQL} select judge, court, count(*) as n from jc group by 1, 2")
def court_distribution(spark, sf_dir):
    return statistics.distribution(entities.judge_cases(A.judged_cases(spark, sf_dir), tasks=A.line_tasks(spark, sf_dir)), ["judge"], F.col("court"), "court")


@query(f"with {A.JUDGED_SQL} select judge, count(*) as n from jc group by 1 order by n desc, judge limit 10")
def judge_case_counts_top10(spark, sf_dir):
    return entities.judge_counts(A.judged_cases(spark, sf_dir)).orderBy(F.desc("n"), "judge").limit(10)


@query(f"with {A.JUDGED_SQL} select judge, year, amount as award, coalesce(nullif(adjusted, 0), amount) as adjusted, court from jc where year is not null and amount > 0")
def judge_timeline_points(spark, sf_dir):
    return entities.timeline_points(entities.judge_cases(A.judged_cases(spark, sf_dir), tasks=A.line_tasks(spark, sf_dir)), "judge", keep=("court",))


@query("select distinct s_name as judge from lineitem join supplier on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey")
def all_judges(spark, sf_dir):
    return entities.all_judges(A.judged_cases(spark, sf_dir))


@query(f"with {A.CLAIMS_SQL} select distinct relationship from aw")
def all_relationships(spark, sf_dir):
    return entities.all_relationships(A.claimed_cases(spark, sf_dir))


@query(f"with {A.CASES_SQL} select min(nullif(year, 0)) as first, max(nullif(year, 0)) as last from cases")
def year_bounds(spark, sf_dir):
    return entities.year_bounds(A.cases(spark, sf_dir))


@query(f"with {A.CASES_SQL} select category, count(*) as n from cases group by 1 order by n desc, 1 limit 10")
def category_counts_top10(spark, sf_dir):
    return statistics.counts(A.cases(spark, sf_dir), "category").orderBy(F.desc("n"), "category").limit(10)


def outlier_sql(by: str) -> str:
    on = f"on b.{by} is not distinct from cases.{by}" if by else "on true"
    group = f"group by {by}" if by else ""
    return f"""with {A.CASES_SQL}, b as (select {by + ',' if by else ''} quantile_cont(amount, 0.25) as q1, quantile_cont(amount, 0.75) as q3, count(*) as n from cases where amount > 0 {group})
select cases.id, cases.category, cases.amount from cases left join b {on} where coalesce(amount <= 0, true) or coalesce(n, 0) < 4 or amount between q1 - 0.5 * (q3 - q1) and q3 + 0.5 * (q3 - q1)"""


@query(outlier_sql(""))
def iqr_outliers_global(spark, sf_dir):
    return outliers.without_outliers(A.cases(spark, sf_dir), "amount", threshold=0.5).select("id", "category", "amount")


@query(outlier_sql("category"))
def iqr_outliers_by_category(spark, sf_dir):
    return outliers.without_outliers(A.cases(spark, sf_dir), "amount", ["category"], threshold=0.5).select("id", "category", "amount")


@query(f"with {A.ADJUSTED_SQL} select category, year, round(avg(adjusted), 4) as mean, round(median(adjusted), 4) as median, count(adjusted) as n from adj group by 1, 2")
def yearly_timeline(spark, sf_dir):
    return rounded(statistics.timeline(A.adjusted_cases(spark, sf_dir), "adjusted", ["category"]))


@query(f"""with {A.ADJUSTED_SQL}, f as (select regr_slope(adjusted, year) as s, regr_intercept(adjusted, year) as i, min(year) as lo, max(year) as hi from adj)
select p::int as point, round(lo + (hi - lo) * p / 99, 4) as x, round(s * (lo + (hi - lo) * p / 99) + i, 1) as y from f, range(100) r(p)""")
def trend_line(spark, sf_dir):
    line = statistics.trend_line(A.adjusted_cases(spark, sf_dir), "adjusted")
    return line.select("point", F.round("x", 4).alias("x"), F.round("y", 1).alias("y"))


@query(f"""with {A.ADJUSTED_SQL}, s as (select min(adjusted) as lo, median(adjusted) as mid, max(adjusted) as hi from adj),
r as (select 'min' as measure, lo as amount from s union all select 'median', mid from s union all select 'max', hi from s)
select measure, amount, round(amount / {fixed.DAMAGES_CAP} * 100, 4) as percent, case when amount / {fixed.DAMAGES_CAP} < 0.25 then 'low' when amount / {fixed.DAMAGES_CAP} < 0.5 then 'moderate'
  when amount / {fixed.DAMAGES_CAP} < 0.75 then 'high' else 'very high' end as band from r""")
def cap_bands(spark, sf_dir):
    return rounded(statistics.cap_comparison(A.adjusted_cases(spark, sf_dir), "adjusted"))


@query(f"with {A.ADJUSTED_SQL} select round(median(amount), 4) as median_original, round(median(adjusted), 4) as median_adjusted, round(avg((adjusted - amount) / nullif(amount, 0) * 100), 4) as mean_change from adj")
def change_summary(spark, sf_dir):
    return rounded(statistics.change_summary(A.adjusted_cases(spark, sf_dir)))


@query(f"""with {A.CASES_SQL} select category, court, case when court is null and category is null then 3 when court is null then 1 else 0 end as level, count(*) as n, round(avg(amount), 4) as mean, min(amount) as min, max(amount) as max
from cases group by rollup(category, court)""")
def category_rollup(spark, sf_dir):
    out = statistics.rolled_up(A.cases(spark, sf_dir), ["category", "court"], "amount")
    return rounded(out.withColumn("level", F.col("level").cast("int")))


@query(f"with {A.CLAIMS_SQL} select id, relationship, amount from aw")
def claim_awards(spark, sf_dir):
    return entities.awards(A.claimed_cases(spark, sf_dir)).select("id", "relationship", "amount")


@query(f"with {A.CLAIMS_SQL} select relationship, min(amount) as min, quantile_cont(amount, 0.25) as q25, median(amount) as median, quantile_cont(amount, 0.75) as q75, max(amount) as max, count(*) as n from aw group by 1 having count(*) >= 2")
def claim_distribution(spark, sf_dir):
    return statistics.five_numbers(entities.awards(A.claimed_cases(spark, sf_dir)), ["relationship"], "amount")


@query(f"with {A.CLAIMS_SQL} select relationship, count(*) as n from aw group by 1")
def claim_counts(spark, sf_dir):
    return statistics.counts(entities.awards(A.claimed_cases(spark, sf_dir)), "relationship")


@query(f"with {A.CLAIMS_SQL} select year, round(avg(amount), 4) as mean, round(median(amount), 4) as median, count(*) as n from aw where relationship in ('A', 'R') group by 1")
def claim_timeline(spark, sf_dir):
    rows = entities.awards(A.claimed_cases(spark, sf_dir)).where(F.col("relationship").isin("A", "R"))
    return rounded(statistics.timeline(rows, "amount"))


@query(f"with {A.CLAIMS_SQL} select count(distinct id) as cases, count(*) as awards, round(sum(amount), 2) as total, median(amount) as median from aw")
def claim_overview(spark, sf_dir):
    rows = entities.awards(entities.with_claims(A.claimed_cases(spark, sf_dir)))
    one = rows.agg(F.count_distinct("id").alias("cases"), F.count("*").alias("awards"), F.round(F.sum("amount"), 2).alias("total"))
    return statistics.with_quantiles(one, rows, [], "amount", {"median": 0.5})


@query(f"""with {A.CASES_SQL}, l as (select *, round(l_extendedprice, 2) as amount, l_linestatus = 'F' as good from lineitem),
k as (select distinct l_orderkey, lower(trim(l_returnflag)) as rel from l where good and amount > 0),
f as (select l_orderkey, lower(trim(l_returnflag)) as rel, amount, good, row_number() over (partition by l_orderkey, lower(trim(l_returnflag)) order by l_linenumber, amount, good) as r from l)
select 'FLA: ' || k.rel as category, count(*) as n, count(case when good and f.amount > 0 then 1 end) as n_awards, round(coalesce(median(case when good and f.amount > 0 then f.amount end), 0), 4) as median
from k join f on f.l_orderkey = k.l_orderkey and f.rel = k.rel and f.r = 1 join cases on cases.id = k.l_orderkey group by 1""")
def claim_category_statistics(spark, sf_dir):
    rows = entities.by_claim_category(A.claimed_cases(spark, sf_dir))
    out = rows.groupBy("category").agg(F.count("*").alias("n"), F.count("amount").alias("n_awards"))
    out = statistics.with_quantiles(out, rows, ["category"], "amount", {"median": 0.5})
    return out.withColumn("median", F.round(F.coalesce("median", F.lit(0.0)), 4))


@query(f"""with {A.CLAIMS_SQL} select distinct upper(trim(category)) as category from cases where upper(trim(category)) in ('5-LOW', '1-URGENT', '2-HIGH')
union select distinct 'FLA: ' || lower(relationship) from aw""")
def category_union(spark, sf_dir):
    valid = spark.createDataFrame([("5-LOW",), ("1-URGENT",), ("2-HIGH",)], "category string")
    cases = A.claimed_cases(spark, sf_dir).withColumn("regions", F.array("category"))
    return entities.all_categories(cases, valid)


@query(f"with {A.CASES_SQL} select id, case_name, amount from cases where category in ('5-LOW', '2-HIGH')")
def category_cases(spark, sf_dir):
    cases = A.cases(spark, sf_dir)
    return cases.where(predicates.in_categories(F.array("category"), ["5-low", "2-High "])).select("id", "case_name", "amount")


@query(f"with {A.CASES_SQL} select id, category from cases where not exists (select 1 from lineitem where l_orderkey = id and l_returnflag = 'R')")
def dismissed_anti(spark, sf_dir):
    gone = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return A.cases(spark, sf_dir).join(gone, "id", "left_anti").select("id", "category")


@query(f"with {A.CASES_SQL} select id, year, amount from cases where year between 1996 and 1999 and amount >= 50000 and (court = '' or upper(court) = 'F') and abs(year - 1997) <= 1")
def range_filters(spark, sf_dir):
    year, amount = F.col("year"), predicates.damages_value(F.col("amount"))
    tests = predicates.in_range(year, 1996, 1999) & predicates.in_range(amount, 50000) & predicates.of_gender(F.col("court"), "female") & predicates.of_age(year, 1997, 1)
    return A.cases(spark, sf_dir).where(tests).select("id", "year", "amount")


_BOOLEAN: dict[str, tuple[str, str]] = {}


def _boolean(name: str, q: str, sql: str) -> None:
    def run(spark, sf_dir):
        docs = A.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
        body = boolean_query.searchable(F.col("source"), comments=F.col("text"))
        return boolean_query.boolean_search(docs, q, body, regions=F.array("lang"), selected=["EN", "fr"]).select("doc_id")

    run.__name__ = name
    x = "lower(concat_ws(' ', nullif(source, ''), nullif(text, '')))"
    _BOOLEAN[name] = q, sql.replace("$", x)
    query(f"select doc_id from documents where lang in ('en', 'fr') and ({sql.replace('$', x)})")(run)


_boolean("boolean_search_basic", "the AND ingenes", "contains($, 'the') and contains($, 'ingenes')")
_boolean("boolean_search_not", "idiot NOT clown", "contains($, 'idiot') and not contains($, 'clown')")
_boolean("boolean_search_phrase", '"of the" tion', "contains($, 'of the') and contains($, 'tion')")
_boolean("boolean_search_or", "worthless OR idiot scum", "contains($, 'worthless') or (contains($, 'idiot') and contains($, 'scum'))")
_boolean("boolean_search_grouped", "(worthless OR idiot) AND NOT (scum clown) the", "(contains($, 'worthless') or contains($, 'idiot')) and not (contains($, 'scum') and contains($, 'clown')) and contains($, 'the')")

@query(" union all ".join(f"select '{n}' as query, doc_id from documents where {sql}" for n, (_, sql) in _BOOLEAN.items()))
def boolean_search_indexed(spark, sf_dir):
    """The Boolean searches, over all languages, from one index of three-character sequences."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", boolean_query.searchable(F.col("source"), comments=F.col("text")).alias("body"))
    path = new_path(spark, "gram_index")
    gram_index.write_gram_index(docs, path, "doc_id", "body")
    index = gram_index.read_gram_index(spark, path)
    out = [gram_index.indexed_boolean_search(docs, index, q, F.col("body"), "doc_id").select(F.lit(n).alias("query"), "doc_id") for n, (q, _) in _BOOLEAN.items()]
    return reduce(DataFrame.unionByName, out)


TOKENS_SQL = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}'))"


@query(f"select doc_id, len({TOKENS_SQL.format('text')})::int as n_tokens, len(list_distinct({TOKENS_SQL.format('text')}))::int as n_different from documents")
def tokenize_counts(spark, sf_dir):
    t = A.table(spark, sf_dir, "documents").withColumn("t", text.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_different"))


WORDS = ["the", "tion", "idiot", "the"]
BM25_SQL = f"""tok as (select doc_id as id, {TOKENS_SQL.format('text')} as ts from documents),
q(query_id, token) as (values (1, 'the'), (1, 'tion'), (1, 'idiot'), (1, 'the'), (2, 'le'), (2, 'les')),
qn as (select query_id, count(distinct token) as d from q group by 1),
tf as (select id, len(ts) as l, unnest(ts) as token from tok),
tc as (select id, l, token, count(*)::double as tf from tf group by all),
kw as (select q.query_id, id, least(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / 100)) / d) / 10, 1.0) as keyword from tc join q on q.token = tc.token join qn on qn.query_id = q.query_id group by 1, 2)"""


@query(f"with {BM25_SQL} select query_id, id, round(keyword, 6) as keyword, rank::int as rank from (select *, row_number() over (partition by query_id order by round(keyword, 9) desc, id) as rank from kw) where rank <= 20")
def bm25_keyword_topk(spark, sf_dir):
    """From an inverted index that is written once for all queries; blocks that can't hold one of the best are never read."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    queries = spark.createDataFrame([(1, WORDS), (2, ["le", "les"])], "query_id int, tokens array<string>")
    path = new_path(spark, "keyword_index")
    keyword_index.write_index(docs, path)
    best, _ = keyword_index.indexed_top(keyword_index.read_index(spark, path), queries, 20)
    return best.select("query_id", "id", F.round("keyword", 6).alias("keyword"), "rank")


VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"{x}::double" for x in VECTOR) + "]"
COSINE_SQL = f"list_dot_product(embedding::double[], {VECTOR_SQL}) / coalesce(nullif(sqrt(list_dot_product(embedding::double[], embedding::double[])), 0), 1) / sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL}))"


@query(f"select vec_id as id, round({COSINE_SQL}, 6) as similarity from embeddings order by 2 desc, 1 limit 25")
def cosine_topk(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = e.select("id", F.round(scores.cosine(F.col("vec"), F.array(*[F.lit(x) for x in VECTOR])), 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "id").limit(25)


@query(f"select vec_id as id, round({COSINE_SQL}, 6) as similarity from embeddings")
def cosine_bulk(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return embedding.similarities(e, VECTOR).select("id", F.round("similarity", 6).alias("similarity"))


def count_sql(x: str, words: list[str]) -> str:
    return " + ".join(f"contains({x}, '{w}')::int" for w in words)


def severity_sql(x: str) -> str:
    return f"""case when coalesce(trim({x}), '') = '' then 0.5 when {count_sql(x, fixed.CATASTROPHIC)} > 0 then 1.0 when {count_sql(x, fixed.SEVERE)} > 0 then least(0.7 + ({count_sql(x, fixed.SEVERE)}) * 0.05, 0.9)
  when {count_sql(x, fixed.MODERATE)} > 0 then 0.5 when {count_sql(x, fixed.MILD)} > 0 then greatest(0.1, 0.3 - ({count_sql(x, fixed.MILD)}) * 0.05) else 0.5 end::double"""


#: Documents in which frequent syllables are exchanged for severity terms, as the prose is invented.
SEVERE_TEXT_SQL = "replace(replace(replace(replace(lower(coalesce(text, '')), 'ingenes', 'severe'), 'idiot', 'paraplegia'), 'ouing', 'mild'), 'clown', 'chronic')"


def severe_text() -> F.Column:
    out = F.lower(F.coalesce("text", F.lit("")))
    for a, b in (("ingenes", "severe"), ("idiot", "paraplegia"), ("ouing", "mild"), ("clown", "chronic")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@query(f"select doc_id, round({severity_sql(SEVERE_TEXT_SQL)}, 6) as severity, round(exp(-3 * abs({severity_sql(SEVERE_TEXT_SQL)} - 0.75)), 6) as proximity from documents")
def severity_score(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", severe_text().alias("low"))
    d = d.withColumn("severity", scores.severity(F.col("low"), F.col("low")))
    s = F.col("severity")
    return d.select("doc_id", F.round(s, 6).alias("severity"), F.round(scores.severity_proximity(s, F.lit(0.75)), 6).alias("proximity"))


WANTED = ["the", "thion", "of", "in"]
INJURIES_SQL = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 1))"
_OVERLAP = f"case when len(injuries) = 0 then 0.0 else len(list_intersect(injuries, {WANTED!r})) / {len(WANTED)}.0 end"
_GAP = "abs(age - 40)"
META_SQL = f"""greatest(0, least(1, ({_OVERLAP}) * 0.6 + exp(-3 * abs({severity_sql('ctext')} - 0.5)) * 0.2 + case when sex is null then 0.5 when sex = 'F' then 1 else 0 end * 0.1
  + case when age is null then 0.5 when {_GAP} = 0 then 1 when {_GAP} <= 5 then 0.85 when {_GAP} <= 10 then 0.7 when {_GAP} <= 20 then 0.5 else 0.3 end * 0.1))"""
TEXT_CASES_SQL = f"""tcases as (select *, lower(concat_ws(' ', nullif(array_to_string(injuries, ' '), ''), nullif(comments, ''))) as ctext from (
  select doc_id as id, concat_ws(' ', source, lang) as case_name, {INJURIES_SQL} as injuries, text as comments, lang, source, embedding,
  case doc_id % 3 when 0 then 'F' when 1 then 'M' end as sex, case when doc_id % 5 <> 0 then (doc_id % 80)::int end as age, doc_id * 100.0::double as damages, (doc_id % 7 + 2010)::int as year
  from documents join embeddings on doc_id = vec_id))"""


@query(f"with {TEXT_CASES_SQL} select id, round({META_SQL}, 6) as meta, round({_OVERLAP}, 6) as overlap from tcases")
def meta_score(spark, sf_dir):
    c = A.text_cases(spark, sf_dir).withColumn("low", search.case_text())
    wanted = F.array(*[F.lit(w) for w in WANTED])
    meta = scores.meta_score(F.col("injuries"), F.col("comments"), F.col("sex"), F.col("age"), wanted, F.lit("female"), F.lit(40), F.lit("plain words"), F.col("low"))
    return c.select("id", F.round(meta, 6).alias("meta"), F.round(scores.injury_overlap(F.col("injuries"), wanted), 6).alias("overlap"))


QUERY = search.Query("plain words", WANTED, WORDS, VECTOR, VECTOR, ["en", "fr"], "female", 40)
_DOC = "concat_ws(' ', case when len(injuries) > 0 then concat_ws(' ', array_to_string(injuries, ' '), array_to_string(injuries, ' '), nullif(comments, '')) else concat_ws(' ', nullif(comments, ''), nullif(comments, ''), nullif(comments, '')) end, case_name)"
_TF = lambda w: f"len(list_filter(ts, lambda x: x = '{w}'))::double"
_PART = lambda w, n: f"{n} * {_TF(w)} * 2.5 / ({_TF(w)} + 1.5 * (0.25 + 0.75 * len(ts) / 100))"
_KW = f"least((case when len(ts) > 0 then ({_PART('the', 2)} + {_PART('tion', 1)} + {_PART('idiot', 1)}) / 3 else 0 end) / 10, 1.0)"
SEARCH_SQL = f"""{TEXT_CASES_SQL}, dt as (select *, {TOKENS_SQL.format(_DOC)} as ts from tcases where lang in ('en', 'fr')),
sc as (select *, round({COSINE_SQL}, 9) as sim, round({COSINE_SQL} * 0.55 + ({_KW}) * 0.35 + ({META_SQL}) * 0.1, 9) as combined from dt),
dd as (select * from (select *, row_number() over (partition by lower(trim(case_name)) order by combined desc, id) as k from sc) where k = 1),
best as (select *, row_number() over (order by combined desc, id) as rank from dd)"""


def found(spark, sf_dir, n: int) -> DataFrame:
    rows = search.scored(A.text_cases(spark, sf_dir), QUERY).withColumns({"combined": F.round("combined", 9), "injury_sim": F.round("injury_sim", 9)})
    return search.top(search.deduplicated(rows), n)


@query(f"with {SEARCH_SQL} select id, case_name, rank::int as rank, round(sim, 6) as injury_sim, round(combined, 6) as combined from best where rank <= 25")
def hybrid_search(spark, sf_dir):
    return found(spark, sf_dir, 25).select("id", "case_name", "rank", F.round("injury_sim", 6).alias("injury_sim"), F.round("combined", 6).alias("combined"))


#: All languages; the vector of each row whose id is divisible by 20.
MANY_SQL = f"""with {TEXT_CASES_SQL}, dt as (select *, {TOKENS_SQL.format(_DOC)} as ts from tcases),
base as (select *, ({_KW}) * 0.35 + ({META_SQL}) * 0.1 as rest from dt),
qv as (select vec_id as query_id, embedding::double[] as qe from embeddings where vec_id % 20 = 0),
s as (select query_id, id, case_name, rest, list_dot_product(embedding::double[], qe) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / sqrt(list_dot_product(qe, qe)) as sim from base, qv),
sc as (select *, round(sim * 0.55 + rest, 9) as combined from s),
dd as (select * from (select *, row_number() over (partition by query_id, lower(trim(case_name)) order by combined desc, id) as k from sc) where k = 1)
select query_id, id, case_name, round(sim, 6) as similarity, round(combined, 6) as combined, rank::int as rank
from (select *, row_number() over (partition by query_id order by combined desc, id) as rank from dd) where rank <= 5"""


@query(MANY_SQL)
def hybrid_search_multi(spark, sf_dir):
    """The query set are the rows whose id is divisible by 20; each is held against all rows."""
    cases = A.text_cases(spark, sf_dir)
    e = A.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    best = search.search_many(cases, e, QUERY, 5)
    return best.select("query_id", "id", "case_name", F.round("similarity", 6).alias("similarity"), F.round("combined", 6).alias("combined"), "rank")


@query(f"with {SEARCH_SQL} select rank::int as number, case_name, year, source as court, damages, round(combined * 100, 1) as match_percent, case when length(comments) > 400 then left(comments, 400) || '...' else comments end as summary_text from best where rank <= 10")
def report_top_cases(spark, sf_dir):
    rows = found(spark, sf_dir, 25).withColumn("summary_text", F.col("comments"))
    return reports.damages_report(rows)[1]


@query(f"with {SEARCH_SQL}, t as (select * from best where rank <= 25 and damages > 0) select median(damages) as median, round(avg(damages), 4) as mean, min(damages) as min, max(damages) as max, count(damages) as n from t")
def report_summary(spark, sf_dir):
    return rounded(reports.damages_report(found(spark, sf_dir, 25))[0])


@query("""with c as (select o_orderkey as ord, c_name as case_name, year(o_orderdate)::int as year, o_orderstatus as court, o_orderpriority as category, round(o_totalprice, 2) as amount from orders join customer on o_custkey = c_custkey),
i as (select case_name, year, court, string_agg(distinct p_type, '|' order by p_type) as injuries from c join lineitem on l_orderkey = ord join part on p_partkey = l_partkey group by 1, 2, 3),
g as (select case_name, year, court, min(ord) as ord, count(*) as n_records, string_agg(distinct category, '|' order by category) as categories, arg_min('c' || ord, ord) as comments,
  count(*)::int as num_plaintiffs, round(sum(amount), 2) as damages, count(*)::double as pecuniary_damages, round(sum(amount) + count(*), 2) as total_award from c group by 1, 2, 3)
select g.ord, g.case_name, g.year, g.court, n_records, categories, coalesce(i.injuries, '') as injuries, comments, num_plaintiffs, damages, pecuniary_damages, total_award
from g left join i on i.case_name = g.case_name and i.year = g.year and i.court = g.court""")
def consolidate_cases(spark, sf_dir):
    merged = consolidate.consolidate(A.parsed_rows(spark, sf_dir))
    d = consolidate.dashboard(merged, ids=False).join(merged.select("ord", "n_records"), "ord")
    money = lambda c: F.round(c, 2).alias(c)
    return d.select(
        "ord", "case_name", "year", "court", "n_records", F.array_join("extended_data.categories", "|").alias("categories"), F.array_join("extended_data.injuries", "|").alias("injuries"),
        "comments", F.col("extended_data.num_plaintiffs").alias("num_plaintiffs"), money("damages"), "pecuniary_damages", money("total_award"),
    )


@query("""with c as (select o_orderkey as ord, c_name as case_name, year(o_orderdate)::int as year, o_orderstatus as court, o_orderpriority as category, o_totalprice from orders join customer on o_custkey = c_custkey),
g as (select case_name, year, court, min(ord) as ord from c group by 1, 2, 3)
select ord, case_name, 'case_' || lpad((row_number() over (order by ord))::varchar, greatest(4, length((row_number() over (order by ord))::varchar))::int, '0') as id from g""")
def case_ids(spark, sf_dir):
    merged = consolidate.consolidate(A.parsed_rows(spark, sf_dir)).select("ord", "case_name")
    return consolidate.numbered(merged)


@query("""with c as (select o_orderkey as ord, c_name as case_name, year(o_orderdate)::int as year, o_orderstatus as court, o_orderpriority as category, round(o_totalprice, 2) as np from orders join customer on o_custkey = c_custkey)
select ord, 0 as plaintiff_no, case_name, category || '|' || court as regions, court as region, np as non_pecuniary_damages, 1.0::double as pecuniary_damages, round(np + 1, 2) as total_award from c""")
def explode_plaintiffs(spark, sf_dir):
    rows = consolidate.per_plaintiff(A.parsed_rows(spark, sf_dir), ids=False)
    return rows.select("ord", "plaintiff_no", "case_name", F.array_join("regions", "|").alias("regions"), "region", "non_pecuniary_damages", "pecuniary_damages", F.round("total_award", 2).alias("total_award"))


@query("""with c as (select c_name, o_orderkey, year(o_orderdate) as y, o_orderstatus as s from orders join customer on o_custkey = c_custkey)
select count(*) as rows_before, (select count(*) from (select distinct c_name, y, s from c)) as rows_after, count(distinct o_orderkey) filter (exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey)) as with_injuries_before from c""")
def coverage_audit(spark, sf_dir):
    rows = A.parsed_rows(spark, sf_dir)
    return consolidate.coverage(rows, consolidate.consolidate(rows)).select("rows_before", "rows_after", "with_injuries_before")


@query("""with r as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as record from conversations)
select conv_id, record, count(*) as n, max(length(text)) as longest, string_agg(nullif(text, ''), ' | ' order by turn) as comments, arg_min(role, turn) as first_role from r where record > 0 group by 1, 2""")
def merge_continuation(spark, sf_dir):
    rows = ingest.record_numbers(A.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") != "user")
    return rows.where("record > 0").groupBy("conv_id", "record").agg(
        F.count("*").alias("n"), F.max(F.char_length("text")).cast("long").alias("longest"), ingest.joined_comments(["turn"], "text").alias("comments"), F.min_by("role", "turn").alias("first_role")
    )


@query("""with n as (select c_custkey, case c_custkey % 5 when 0 then c_name || ' J.' when 1 then 'Hon. A. ' || c_name || ' J.A.' when 2 then c_name || ', J.' when 3 then 'The ' || upper(c_name) || ' C.J.O.' else '' end as raw from customer)
select c_custkey, case when raw = '' then null else regexp_extract(replace(raw, 'CUSTOMER', 'Customer'), 'Customer#[0-9]+', 0) end as judge from n""")
def judge_name_normalise(spark, sf_dir):
    n, k = F.col("c_name"), F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat(n, F.lit(" J."))).when(k == 1, F.concat(F.lit("Hon. A. "), n, F.lit(" J.A."))).when(k == 2, F.concat(n, F.lit(", J.")))
    raw = raw.when(k == 3, F.concat(F.lit("The "), F.upper(n), F.lit(" C.J.O."))).otherwise("")
    return A.table(spark, sf_dir, "customer").select("c_custkey", text.judge_name(raw).alias("judge"))


#: Turns as pages: of a system turn HEAD, of a user turn GENERAL, of long answers none, of others KNEE.
_SECTION_SQL = "case when role = 'system' then 'Head' when role = 'user' then 'General' when length(text) > 800 then null when turn = 1 then 'Body' else 'Knee' end"


@query(f"""with p as (select conv_id, turn, upper({_SECTION_SQL}) as s from conversations),
m as (select *, last_value(case when s in ('HEAD', 'BODY') then s end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as parent from p)
select conv_id as doc_id, turn as page, coalesce(case when s = 'GENERAL' and parent is not null then parent || ' - ' || s else s end, 'UNKNOWN') as section from m""")
def section_fill(spark, sf_dir):
    pages = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.expr(_SECTION_SQL.replace("length", "char_length")).alias("section"))
    return ingest.filled_sections(pages)


_TERMS = [r"\b(thion \w+)", r"\b(\w+ of the)", r"\b(idiot|clown)\b"]
#: The same with ASCII boundaries, as in SQL: Java's \b may know other letters than its \w.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_ASCII_TERMS = [rf"{_BEFORE}(thion \w+)", rf"{_BEFORE}(\w+ of the)", rf"{_BEFORE}(idiot|clown){_AFTER}"]
def found_sql(x: str, patterns: list[str]) -> str:
    """All of group 1 of each expression in turn, trimmed."""
    return "list_transform(" + " || ".join(f"regexp_extract_all({x}, '{p}', 1)" for p in patterns) + ", lambda x: trim(x))"


def firsts_sql(a: str, most: int = 10) -> str:
    """The first different ones of a list."""
    return f"array_to_string(list_filter({a}, lambda x, i: list_position({a}, x) = i)[1:{most}], '|')"


def extracted_sql(x: str) -> str:
    """The columns of injuries, findings and sequelae of a lower-case text."""
    cut = lambda patterns: f"list_transform({found_sql(x, patterns)}, lambda x: left(x, 80))"
    injuries = f"list_filter({found_sql(x, fixed.COMMENT_INJURIES)}, lambda x: length(x) > 3)"
    return f"{firsts_sql(injuries)} as injuries, {firsts_sql(cut(fixed.REPORT_INJURIES))} as findings, {firsts_sql(cut(fixed.REPORT_SEQUELAE))} as sequelae"


SEVERITY_WORDS_SQL = f"case when regexp_matches(body, '{'|'.join(fixed.REPORT_SEVERE)}') then 'severe' when regexp_matches(body, '{'|'.join(fixed.REPORT_MILD)}') then 'mild' else 'moderate' end"


@query(f"""select doc_id, array_to_string({found_sql('body', _TERMS)}, '|') as terms, {SEVERITY_WORDS_SQL} as severity, {extracted_sql('body')} from (select doc_id, lower(coalesce(text, '')) as body from documents)""")
def extract_terms_regex(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    lists = {"terms": _ASCII_TERMS, "injuries": fixed.COMMENT_INJURIES, "findings": fixed.REPORT_INJURIES, "sequelae": fixed.REPORT_SEQUELAE}
    docs = docs.select("doc_id", "text", all_matches(F.lower(F.coalesce("text", F.lit(""))), **lists).alias("m"))
    joined = lambda found, name: F.array_join(F.coalesce(found, F.array().cast("array<string>")), "|").alias(name)
    return docs.select(
        "doc_id", joined(F.col("m.terms"), "terms"), text.report_severity(F.col("text")).alias("severity"), joined(text.as_injuries(F.col("m.injuries")), "injuries"),
        joined(text.as_findings(F.col("m.findings")), "findings"), joined(text.as_findings(F.col("m.sequelae")), "sequelae"),
    )


_PARTS = [("idiot", ["knee_left", "knee_right"]), ("worthless", ["shoulder_left", "shoulder_right"]), ("scum", ["spine"]), ("trash", [])]


def region_sql(term: str, regions: list[str]) -> str:
    if not regions:
        return ""
    names = ", ".join(f"('{r}')" for r in regions)
    if len(regions) != 2:
        return f"select doc_id, r as region from d, (values {names}) v(r) where contains(x, '{term}')"
    has = lambda words: "(" + " or ".join(f"contains(ctx, '{w}')" for w in words) + ")"
    left, right, both = has(fixed.LEFT), has(fixed.RIGHT), has(fixed.BOTH)
    near = f"substring(x, greatest(instr(x, '{term}') - 30, 1), instr(x, '{term}') - greatest(instr(x, '{term}') - 30, 1) + {len(term)} + 10)"
    return f"""select doc_id, r as region from (select doc_id, {near} as ctx from d where contains(x, '{term}')), (values {names}) v(r)
  where {both} or {left} = {right} or ({left} and r like '%\\_left' escape '\\') or ({right} and r like '%\\_right' escape '\\')"""


@query("with d as (select doc_id, lower(text) as x from documents) select distinct doc_id, region from (" + " union all ".join(s for t, r in _PARTS if (s := region_sql(t, r))) + ")")
def region_laterality(spark, sf_dir):
    from ..operators.anatomy import text_regions

    dictionary = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(_PARTS)], "ord int, term string, regions array<string>")
    return text_regions(A.table(spark, sf_dir, "documents"), dictionary)


@query("""select event_type, count(value) as n, round(avg(value), 4) as mean, min(value) as min, max(value) as max, round(stddev_pop(value), 4) as std, true as median_is_near,
(select count(*) > 1 from (select 1 from events limit 2)) as in_batches from events group by 1""")
def streaming_running_stats(spark, sf_dir):
    """The running statistics after all rows have come through a stream in four batches, each of which puts the groups that it changed.

    The sketch's median is held to the exact one of all rows.
    """
    events = A.table(spark, sf_dir, "events").select("event_type", "value")
    path = new_path(spark, "running")
    events.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    upserted(running_statistics(stream, "event_type", "value"), f"{path}/result", f"{path}/checkpoint").awaitTermination()
    upserted(running_sketches(stream, "event_type", "value"), f"{path}/sketches", f"{path}/checkpoint_sketches").awaitTermination()
    rows = rounded(latest(spark, f"{path}/result", ["event_type"]))
    sketched = statistics_of(latest(spark, f"{path}/sketches", ["event_type", "bucket"]), "event_type").select("event_type", "median")
    exact = statistics.quantiles(events, ["event_type"], "value", {"exact": 0.5})
    # an even number of values has its median between two, of which the sketch gives the lower
    near = statistics.quantiles(events, ["event_type"], "value", {"least": 0.49, "most": 0.51})
    out = rows.join(sketched, "event_type").join(exact, "event_type").join(near, "event_type")
    good = F.col("median").between(F.col("least") - F.abs("exact") / ERROR, F.col("most") + F.abs("exact") / ERROR)
    batches = spark.read.parquet(f"{path}/result").select("batch").distinct().count()
    return out.select(*rows.columns, good.alias("median_is_near"), F.lit(batches > 1).alias("in_batches"))
