"""Queries of the search front end: expansion, presets, outliers, charts, reports, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, predicates, scores, text
from ..operators import anatomy, boolean_query, embedding, entities, outliers, reports, search, statistics
from ..working import stored
from . import adapters as A
from . import queries as Q
from .record_tables import LINES_SQL, lines
from .registry import query


def part_queries(spark, sf_dir):
    """A query for each order: the names of its parts."""
    li = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_join(F.array_sort(F.collect_set(F.initcap("p_name"))), ", ").alias("text"))


def part_expansions(spark, sf_dir):
    """What a part's name, or its last word, relates to."""
    p = A.table(spark, sf_dir, "part")
    names = p.groupBy(F.col("p_name").alias("term")).agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("related"))
    word = F.substring_index("p_name", " ", -1)
    words = p.select(word.alias("term"), F.array(F.concat(F.lit("any "), word)).alias("related")).distinct()
    return names.unionByName(words)


_EXPANDED_SQL = """pq as (select l_orderkey as query_id, string_agg(distinct n, ', ' order by n) as text from (select l_orderkey, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) as n
  from lineitem join part on p_partkey = l_partkey) group by 1),
own as (select distinct l_orderkey as query_id, p_name from lineitem join part on p_partkey = l_partkey),
te as (select query_id, p_name as term from own union select query_id, split_part(p_name, ' ', 2) from own union select query_id, 'any ' || split_part(p_name, ' ', 2) from own
  union select query_id, lower(p_type) from own join part using (p_name) union select query_id, lower(text) from pq)"""


@query(f"with {_EXPANDED_SQL} select query_id, term from te")
def expanded_terms(spark, sf_dir):
    return search.expand_queries(part_queries(spark, sf_dir), part_expansions(spark, sf_dir))


@query(f"with {_EXPANDED_SQL}, t as (select query_id, string_agg(term, '. ' order by term) as terms from te group by 1) select query_id, pq.text || '. ' || pq.text || '. ' || terms as expanded from t join pq using (query_id)")
def expanded_texts(spark, sf_dir):
    return search.expanded_texts(part_queries(spark, sf_dir), part_expansions(spark, sf_dir))


PHRASES = " The, tion ,, In"
_OWN = "list_distinct(list_transform(injuries, lambda x: lower(trim(x))))"


@query(f"""with {Q.TEXT_CASES_SQL} select id, round(case when len(injuries) = 0 then 0 else len(list_filter(['the', 'tion', 'in'], lambda p: len(list_filter(injuries, lambda i: contains(i, p) or contains(p, i))) > 0)) / 3.0 end, 6) as listed from tcases""")
def injury_list_match(spark, sf_dir):
    """The share of a query's phrases that are, contain or are in an injury of each case."""
    c = A.text_cases(spark, sf_dir)
    return c.select("id", F.round(scores.injury_list_match(F.col("injuries"), text.phrases(F.lit(PHRASES))), 6).alias("listed"))


#: Presets, and weights of one's own that are divided by their sum.
WEIGHTS = {**scores.PRESETS, "own": {"semantic": 1.0, "injury": 2.0, "keyword": 4.0, "meta": 1.0}}


def ranked_sql(name: str, w: dict, where: str = "true", n: int = 10, with_categories: bool = True) -> str:
    """SQL of the best n of a search with its weights."""
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    meta = w["meta"] if with_categories else 0.0
    vector = w["semantic"] + w["injury"] + (0.0 if with_categories else w["meta"])
    langs = "lang in ('en', 'fr')" if with_categories else "true"
    return f"""{name} as (select * from (select *, row_number() over (order by combined desc, id)::int as rank from (select *, row_number() over (partition by lower(trim(case_name)) order by combined desc, id) as k from
  (select *, round({Q.COSINE_SQL} * {vector} + ({Q._KW}) * {w['keyword']} + ({Q.META_SQL}) * {meta}, 9) as combined from all_cases where {langs} and {where})) where k = 1) where rank <= {n})"""


_ALL_SQL = f"{Q.TEXT_CASES_SQL}, all_cases as (select *, {Q.TOKENS_SQL.format(Q._DOC)} as ts from tcases)"


def ranked(cases, q, n, **options):
    rows = search.scored(cases, q, **options).withColumn("combined", F.round("combined", 9))
    return search.top(search.deduplicated(rows), n)


@query("with " + ", ".join([_ALL_SQL, *(ranked_sql(k, w) for k, w in WEIGHTS.items())]) + " " + " union all ".join(f"select '{k}' as preset, id, rank, round(combined, 6) as combined from {k}" for k in WEIGHTS))
def search_presets(spark, sf_dir):
    cases = stored(A.text_cases(spark, sf_dir), "text_cases")
    out = None
    for name, w in WEIGHTS.items():
        best = ranked(cases, Q.QUERY, 10, given_weights=scores.weights(True, w, normalise=True)).select(F.lit(name).alias("preset"), "id", "rank", F.round("combined", 6).alias("combined"))
        out = best if out is None else out.unionByName(best)
    return out


@query(f"with {_ALL_SQL}, {ranked_sql('r', scores.WEIGHTS, with_categories=False)} select id, rank, round(combined, 6) as combined from r")
def search_without_categories(spark, sf_dir):
    """Without a category selected all cases are searched, and the weight of their data goes to the injuries."""
    q = search.Query(Q.QUERY.text, Q.QUERY.injuries, Q.QUERY.keywords, Q.VECTOR, Q.VECTOR, [], Q.QUERY.gender, Q.QUERY.age)
    return ranked(A.text_cases(spark, sf_dir), q, 10).select("id", "rank", F.round("combined", 6).alias("combined"))


_DISMISSED = "id % 7 <> 3"
_TRIMMED_SQL = f"""with {_ALL_SQL}, {ranked_sql('r', scores.WEIGHTS, _DISMISSED, 60)}, b as (select quantile_cont(damages, 0.25) as q1, quantile_cont(damages, 0.75) as q3, count(*) as n from r where damages > 0),
t as (select r.*, row_number() over (order by combined desc, id)::int as place from r, b where (select count(*) from r) <= 4 or n < 4 or coalesce(damages <= 0, true) or damages between q1 - 0.2 * (q3 - q1) and q3 + 0.2 * (q3 - q1))"""


def trimmed(spark, sf_dir):
    cases = A.text_cases(spark, sf_dir)
    dismissed = A.table(spark, sf_dir, "documents").where("doc_id % 7 = 3").select(F.col("doc_id").alias("id"))
    return search.search_without_outliers(cases, Q.QUERY, "damages", 20, threshold=0.2, dismissed=dismissed)


@query(f"{_TRIMMED_SQL} select id, place as rank, damages, round(combined, 6) as combined from t where place <= 20")
def search_trimmed(spark, sf_dir):
    """Three times as many results, without dismissed cases and outliers, cut to the number asked for."""
    return trimmed(spark, sf_dir).select("id", "rank", "damages", F.round("combined", 6).alias("combined"))


@query(f"""{_TRIMMED_SQL}, {A.CPI_SQL} select id, t.year, place as rank, damages, round(damages * c.cpi / f.cpi, 2) as adjusted, round(round(damages * c.cpi / f.cpi, 2) - damages, 4) as delta,
  round((round(damages * c.cpi / f.cpi, 2) - damages) / damages * 100, 4) as delta_percent, round(combined * 100, 4) as match_percent from t join cpi f on f.year = t.year join cpi c on c.year = {fixed.REFERENCE_YEAR} where place <= 15 and damages > 0""")
def search_chart_points(spark, sf_dir):
    from ..operators.inflation import adjust

    rows = search.chart_points(adjust(trimmed(spark, sf_dir), A.cpi(spark), "damages"))
    places = lambda c: F.round(c, 4).alias(c)
    return rows.select("id", "year", "rank", "damages", "adjusted", places("delta"), places("delta_percent"), places("match_percent"))


@query(f"with {_ALL_SQL}, {ranked_sql('r', scores.WEIGHTS, n=60)} select id, rank from r where exists (select 1 from labels where doc_id = id and quality = 1)")
def results_of_filtered_ids(spark, sf_dir):
    """Results whose id is among those that a filter leaves."""
    good = A.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return search.only(ranked(A.text_cases(spark, sf_dir), Q.QUERY, 60), good).select("id", "rank")


_BOOLEAN = "contains(lower(concat_ws(' ', nullif(source, ''), nullif(text, ''))), 'the')"


@query(f"""with h as (select doc_id, n_chars::double as n from documents where {_BOOLEAN}), b as (select quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.75) as q3 from h where n > 0)
select doc_id, n from h, b where coalesce(n <= 0, true) or (select count(*) from h where n > 0) < 4 or n between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""")
def boolean_search_outliers(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars").cast("double"))
    found = boolean_query.boolean_search(docs, "the", boolean_query.searchable(F.col("source"), comments=F.col("text")))
    return outliers.without_outliers(found, "n").select("doc_id", "n")


JUDGES = [f"Supplier#{i:09d}" for i in range(1, 9)]


@query(f"with {A.JUDGED_SQL} select * from ({Q.stats_sql('judge', 'jc')}) where judge in ({', '.join(repr(j) for j in JUDGES)})")
def compared_judges(spark, sf_dir):
    """Statistics of up to eight chosen judges in one pass."""
    rows = entities.selected(entities.by_judge(A.judged_cases(spark, sf_dir)), "judge", JUDGES)
    rows = entities.first_of(rows, ["judge", "case_name", "year"], [F.col("ord")])
    return Q.rounded(statistics.award_statistics(rows, ["judge"]), 2)


@query(f"with {A.JUDGED_SQL}, n as (select judge, year, count(*) as n from jc where year is not null group by all) select judge, string_agg(year || ':' || n, ',' order by year) as years from n group by 1")
def judge_year_maps(spark, sf_dir):
    """The distribution of each judge's cases over years as one map."""
    counts = statistics.distribution(entities.judge_cases(A.judged_cases(spark, sf_dir), tasks=A.line_tasks(spark, sf_dir)), ["judge"], F.col("year"))
    entries = F.transform(F.array_sort(F.map_entries("distribution")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return statistics.as_map(counts, ["judge"]).select("judge", F.array_join(entries, ",").alias("years"))


@query("select s_suppkey, s_nationkey::varchar as region, coalesce(case when n_regionkey <> 3 then n_name end, s_nationkey::varchar) as label from supplier left join nation on n_nationkey = s_nationkey")
def region_labels(spark, sf_dir):
    """Labels of suppliers' nations; those of one region have none and show their id."""
    n = A.table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("string").alias("region_id"), F.col("n_name").alias("label"), F.lit("x").alias("term"))
    s = A.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("region"))
    return anatomy.region_labels(s, n)


#: Terms with the regions that they name, in order: a longer one behind a shorter, one that a name contains and one that contains a name.
TERMS = [("widget", ["arm_left", "arm_right"]), ("cold widget", ["hand_left", "hand_right"]), ("bolt", ["spine"]), ("an old ring of gold", ["leg_left", "leg_right"]), ("old ring", []), ("ring", ["eye_left", "eye_right"])]
_SIDES = ["left ", "right ", "both ", ""]


def _term_sql() -> str:
    """The first equal term, else the first that contains the name or is in it."""
    equal = " ".join(f"when t = '{t}' then '{t}'" for t, _ in TERMS)
    near = " ".join(f"when contains(t, '{t}') or contains('{t}', t) then '{t}'" for t, _ in TERMS)
    return f"case {equal} {near} end"


_SIDED_SQL = " ".join(
    f"when k = '{t}' then " + ("''" if not r else f"'{r[0]}'" if len(r) == 1 else f"case side when 'left ' then '{r[0]}' when 'right ' then '{r[1]}' else '{'|'.join(r)}' end") for t, r in TERMS
)


@query(f"with p as (select p_partkey, lower(p_name) as t, case p_partkey % 4 when 0 then 'left ' when 1 then 'right ' when 2 then 'both ' else '' end as side from part), k as (select *, {_term_sql()} as k from p) select p_partkey, case {_SIDED_SQL} else '' end as regions from k")
def term_regions(spark, sf_dir):
    dictionary = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(TERMS)], "ord int, term string, regions array<string>")
    side = F.element_at(F.array(*[F.lit(x) for x in _SIDES]), (F.col("p_partkey") % 4).cast("int") + 1)
    rows = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term"), F.concat(side, "p_name").alias("context"))
    return anatomy.term_regions(rows, dictionary).select("p_partkey", F.array_join("regions", "|").alias("regions"))


#: What a line of an order says in its expert report, by its number; # stands for its part.
SAYINGS = [
    "The patient of bed # was diagnosed with a cervical sprain injury", "History of a chronic lumbar disc herniation after fall #", "This causes difficulty with lifting boxes over # kg",
    "He suffered a torn meniscus and chronic pain", "Severe limitation to walking # steps", "Minor whiplash, no fracture", "She sustained a fractured wrist in room #; traumatic brain injury",
]
_SAID_SQL = "string_agg(replace(case l_linenumber % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SAYINGS)) + " end, '#', l_partkey::varchar), '. ' order by k)"
_REPORTS_SQL = f"{LINES_SQL}, rp as (select l_orderkey as doc_id, case when l_orderkey % 9 = 4 then '  ' else {_SAID_SQL} || '.' end as text from lines group by 1)"


def expert_reports(spark, sf_dir):
    said = F.replace(F.element_at(F.array(*[F.lit(s) for s in SAYINGS]), F.col("l_linenumber") % 7 + 1), F.lit("#"), F.col("l_partkey").cast("string"))
    r = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("k", said.alias("s")))).alias("a"))
    body = F.concat(F.array_join(F.transform("a", lambda x: x["s"]), ". "), F.lit("."))
    return r.select("doc_id", F.when(F.col("doc_id") % 9 == 4, "  ").otherwise(body).alias("text"))


@query(f"""with {_REPORTS_SQL}, x as (select doc_id, lower(text) as body from rp where trim(text) <> ''), e as (select doc_id, {Q.SEVERITY_WORDS_SQL} as severity, {Q.extracted_sql('body')},
  concat_ws('|', case when contains(body, 'wrist') then 'wrist' end, case when contains(body, 'lumbar') then 'spine' end) as parts from x)
select doc_id, severity, injuries as comment_injuries, findings as injuries, sequelae, concat_ws(' | ', nullif(replace(findings, '|', '; '), ''), nullif(replace(sequelae, '|', '; '), '')) as search_text,
  coalesce(nullif(array_to_string(list_sort(string_split(parts, '|')), '|'), ''), '') as regions from e""")
def report_analysis(spark, sf_dir):
    """Findings, sequelae, severity, regions and search text of expert reports; those without text are rejected."""
    dictionary = spark.createDataFrame([(0, "wrist", ["wrist"]), (1, "lumbar", ["spine"])], "ord int, term string, regions array<string>")
    found, _ = reports.analysed(expert_reports(spark, sf_dir), dictionary=dictionary)
    listed = lambda c: F.array_join(c, "|")
    return found.select(
        "doc_id", "severity", listed("comment_injuries").alias("comment_injuries"), listed("injuries").alias("injuries"), listed("sequelae").alias("sequelae"),
        reports.report_search_text(F.col("injuries"), F.col("sequelae")).alias("search_text"), listed(F.coalesce("injured_regions", F.array().cast("array<string>"))).alias("regions"),
    )


@query(f"with {_REPORTS_SQL} select doc_id, 'no text' as error from rp where trim(text) = ''")
def report_rejects(spark, sf_dir):
    return reports.analysed(expert_reports(spark, sf_dir))[1].select("doc_id", "error")


@query("""with c as (select c_custkey as query_id, case c_custkey % 3 when 0 then 'Not Specified' when 1 then 'Female' end as gender, case when c_custkey % 4 > 0 then (c_custkey % 80)::int end as age, c_nationkey, c_mktsegment as text from customer)
select query_id, 0 as place, 'Gender' as name, gender as value from c where gender = 'Female' union all select query_id, 1, 'Age', age::varchar from c where age <> 0 union all select query_id, 10000, 'Injury Description', text from c
union all select query_id, 2, 'Injured Region', n_name from c join nation on n_nationkey = c_nationkey union all select query_id, 3, 'Injured Region', 'other' from c""")
def report_parameters(spark, sf_dir):
    """The search parameters of a report for each customer's query, regions by their label."""
    c = A.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    queries = c.select(
        k.alias("query_id"), F.when(k % 3 == 0, "Not Specified").when(k % 3 == 1, "Female").alias("gender"), F.when(k % 4 > 0, (k % 80).cast("int")).alias("age"),
        F.array(F.col("c_nationkey").cast("string"), F.lit("other")).alias("regions"), F.col("c_mktsegment").alias("text"),
    )
    labels = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("region_id"), F.col("n_name").alias("label"))
    return reports.report_parameters(queries, labels)


_NAMED_SQL = f"""{A.ADJUSTED_SQL}, cl as (select l_orderkey, l_returnflag, round(l_extendedprice, 2) as price, l_linestatus = 'F' as good from lineitem),
ca as (select adj.*, exists (select 1 from cl where l_orderkey = id and l_returnflag = 'R' and good) as r from adj where exists (select 1 from cl where l_orderkey = id))"""


def claimed(spark, sf_dir):
    """Cases with claims, their region and other regions."""
    c = A.claimed_cases(spark, sf_dir).join(A.cases(spark, sf_dir).select("id", F.col("amount").alias("damages")), "id")
    return c.withColumns({"region": F.col("category"), "regions": F.array(F.lower("court"), F.lit("x"))}).drop("category")


@query(f"with {_NAMED_SQL} select 'FLA: r ' as name, id from ca where r union all select '2-high', id from ca where category = '2-HIGH' union all select 'f', id from ca where court = 'F'")
def cases_of_named_categories(spark, sf_dir):
    """A category's cases by its name: a relationship, a region or one of several regions."""
    rows = stored(claimed(spark, sf_dir), "claimed")
    names = ["FLA: r ", "2-high", "f"]
    parts = [entities.category_cases(rows, n).select(F.lit(n).alias("name"), "id") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {_NAMED_SQL} select 'FLA: R' as category, year, amount as award, coalesce(nullif(adjusted, 0), amount) as adjusted, case_name, 'main' as shown from ca where r and amount > 0
union all select 'FLA: R', year, price, price, case_name, 'claims' from ca join cl on l_orderkey = id where l_returnflag = 'R' and good and price > 0 and r
union all select '2-HIGH', year, amount, coalesce(nullif(adjusted, 0), amount), case_name, 'main' from ca where category = '2-HIGH' and amount > 0""")
def category_timeline_points(spark, sf_dir):
    """Points of a category's timeline; a relationship's show the main award, or by option each award of its own."""
    rows = stored(claimed(spark, sf_dir), "claimed")
    parts = [entities.category_points(rows, n, own).withColumn("shown", F.lit(shown)) for n, own, shown in (("FLA: R", False, "main"), ("FLA: R", True, "claims"), ("2-HIGH", False, "main"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Words of each text, their checksums byte by byte, and how often each rest by 256 occurs.
_HASHED_SQL = r"""with recursive steps as (select z, 0 as k, z as x from range(256) r(z) union all select z, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from steps where k < 8),
crc as materialized (select list(x order by z) as t from steps where k = 8),
words as (select vec_id as id, unnest(list_filter(string_split_regex(translate(lower(text), chr(10) || chr(9) || chr(13), '   '), ' +'), lambda x: x <> '')) as w from embeddings join documents on vec_id = doc_id),
sums as (select id, n, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(hx) + 1, 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 256 as d
    from (select id, hex(encode(w)) as hx, count(*) as n from words group by all), crc),
dims as (select id, d, sum(n) as n from sums group by all),
told as (select id, string_agg(d || ':' || floor(n * 1000.0 / least + 0.3)::bigint, ',' order by d) as v from (select *, min(n) over (partition by id) as least from dims) group by id)
select vec_id as id, case when v is null then 0.0 else 1.0 end::double as norm, coalesce(v, '') as vector from embeddings join documents on vec_id = doc_id left join told on told.id = vec_id"""


@query(_HASHED_SQL)
def hashed_vectors(spark, sf_dir):
    """Vectors of texts by the model for tests: the length, and each value that isn't 0 by the least of them, in thousandths."""
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"))
    v = embedding.with_vectors(d, "text", exact=True)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    least = F.array_min(F.filter("vec", lambda x: x > 0))
    values = F.filter(F.transform("vec", lambda x, i: F.when(x > 0, F.concat_ws(":", i, F.floor(x.cast("double") * 1000 / least + 0.3)))), lambda x: x.isNotNull())
    return v.select(F.col("vec_id").alias("id"), F.round(F.sqrt(square), 3).alias("norm"), F.array_join(values, ",").alias("vector"))


@query("""select o_custkey, string_agg(p, '|' order by pos) as names from (select o_custkey, upper(left(p_name, 1)) || substr(p_name, 2) as p, lower(p_name) as low, l_orderkey * 1000 + k as pos, row_number() over (partition by o_custkey, lower(p_name) order by l_orderkey * 1000 + k) as r
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as k from lineitem) join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey) where r = 1 group by 1""".replace("upper(left(p_name, 1)) || substr(p_name, 2) as p", "case when (l_orderkey * 1000 + k) % 2 = 0 then upper(p_name) else ' ' || p_name end as p"))
def distinct_names(spark, sf_dir):
    """Names of a customer's parts without those that equal an earlier one but for case and outer spaces."""
    at = F.col("l_orderkey") * 1000 + F.col("k")
    named = F.when(at % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    li = lines(spark, sf_dir).join(A.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(A.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), named.alias("p")))), lambda x: x["p"]).alias("a"))
    return rows.select("o_custkey", F.array_join(text.distinct_folded(F.col("a")), "|").alias("names"))


@query("select o_orderkey as id, coalesce(case when o_orderkey % 3 <> 0 then nullif(o_totalprice, 0) end, case when o_orderkey % 2 = 0 then o_totalprice / 2 end, (select min(l_quantity) from lineitem where l_orderkey = o_orderkey)) as value from orders")
def first_amounts(spark, sf_dir):
    """The first amount that isn't missing of a case, its general damages and its plaintiffs."""
    k = F.col("o_orderkey")
    people = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_quantity").alias("non_pecuniary_damages")))).alias("plaintiffs"))
    o = A.table(spark, sf_dir, "orders").join(people, k == F.col("l_orderkey"), "left")
    own = F.when(k % 3 == 0, F.lit("0")).otherwise(F.col("o_totalprice").cast("string"))
    return o.select(k.alias("id"), predicates.damages_value(own, F.when(k % 2 == 0, F.col("o_totalprice") / 2), plaintiffs=F.col("plaintiffs")).alias("value"))
