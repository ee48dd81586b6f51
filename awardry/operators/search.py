"""Ranked search: vectors, keywords and case data."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import in_categories
from ..functions.scores import cosine, keyword_score, meta_score, weights
from ..functions.text import given, tokens
from ..working import stored
from . import vector_cells
from .outliers import without_outliers


#: Rows to broadcast at most.
BROADCAST_ROWS = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def expanded_terms(query: str, related: dict[str, list[str]]) -> list[str]:
    """The query's parts, words and word sequences of 2 to 5 that are keys of a dictionary, with all that it relates to them; sorted."""
    low = query.lower().strip()
    words = low.split()
    grams = {" ".join(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)}
    keys = {p.strip() for p in low.split(",")} | grams | {g.strip(",.;") for g in grams}
    out = {low} if low else set()
    for k in keys & related.keys():
        out |= {k, *related[k]}
    return sorted(out)


def expanded_text(query: str, related: dict[str, list[str]]) -> str:
    """The query twice, then its terms."""
    return f"{query}. {query}. " + ". ".join(expanded_terms(query, related))


def _query_keys(queries: DataFrame, text: str) -> DataFrame:
    """queries with __keys: the word sequences of 1 to 5 of each text, with and without outer marks, and its parts between commas.

    The words are a column of their own, so that a text is split once and not for each of its sequences.
    """
    rows = queries.withColumn("__low", F.lower(text)).withColumn("__words", F.split(F.trim("__low"), r"\s+"))
    of_length = lambda n: F.transform("__words", lambda _, i: F.when(i + n <= F.size("__words"), F.array_join(F.slice("__words", i + 1, F.lit(n)), " ")))
    rows = rows.withColumn("__grams", F.array_compact(F.concat(*[of_length(n) for n in range(1, 6)])))
    bare = F.transform("__grams", lambda g: F.btrim(g, F.lit(",.;")))
    keys = F.array_distinct(F.concat("__grams", bare, F.transform(F.split("__low", ","), lambda x: F.trim(x))))
    return rows.withColumn("__keys", keys).drop("__words", "__grams")


def expand_queries(queries: DataFrame, expansions: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term) for a table of queries and a table (term, related): the same by an equi-join of word sequences."""
    keys = _query_keys(queries, text).select("query_id", F.trim("__low").alias("__whole"), F.posexplode_outer("__keys").alias("__at", "term"))
    hit = keys.join(_few(expansions), "term", "left")  # a term of many queries isn't one task then
    found = F.when(F.col("related").isNotNull(), F.array_union(F.array("term"), "related")).otherwise(F.array().cast("array<string>"))
    terms = hit.select("query_id", F.explode(F.when(F.coalesce("__at", F.lit(0)) == 0, F.concat(F.array("__whole"), found)).otherwise(found)).alias("term"))
    return terms.distinct()


def expanded_texts(queries: DataFrame, expansions: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, expanded): each query's text twice, then its terms in order, as expanded_text."""
    terms = expand_queries(queries, expansions, text).where(given(F.col("term")).isNotNull())
    terms = terms.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ". ").alias("__terms"))
    out = queries.select("query_id", text).join(terms, "query_id", "left")
    return out.select("query_id", F.concat(text, F.lit(". "), text, F.lit(". "), F.coalesce("__terms", F.lit(""))).alias("expanded"))


#: Words of a set of queries that are looked for in each document before its tokens are shuffled, at most.
FEW_WORDS = 256


@dataclass
class Query:
    """What is looked for. injuries are phrases, keywords are tokens (of the expanded query), vectors are lists or None."""

    text: str = ""
    injuries: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    full_vector: list[float] | None = None
    injury_vector: list[float] | None = None
    regions: list[str] = field(default_factory=list)
    gender: str | None = None
    age: int | None = None


def document_tokens(injuries: Column, comments: Column, case_name: Column, summary: Column) -> Column:
    """Tokens of a case: injuries twice, comments once or, without injuries, three times, name and summary."""
    listed = F.array_join(injuries, " ")
    note = given(comments)
    weighted = F.when(given(listed).isNotNull(), F.concat_ws(" ", listed, listed, note)).otherwise(F.concat_ws(" ", note, note, note))
    return tokens(F.concat_ws(" ", weighted, case_name, summary))


def keyword_scores(documents: DataFrame, queries: DataFrame, mean_length: float = 100.0) -> DataFrame:
    """(query_id, id, keyword) for many queries at once, by an equi-join of tokens; only pairs that share a token.

    documents: id, tokens. queries: query_id, tokens (with repetitions). A query set is small; what isn't is shuffled by token.
    """
    documents = documents.select("id", F.size("tokens").alias("len"), "tokens")
    words = queries.select(F.explode("tokens").alias("t")).distinct()
    if words.limit(FEW_WORDS + 1).count() <= FEW_WORDS:  # only the queries' words are exploded and shuffled
        held = F.broadcast(words.agg(F.collect_list("t").alias("__words")))  # one row
        documents = documents.crossJoin(held).withColumn("tokens", F.filter("tokens", lambda t: F.array_contains("__words", t)))
    docs = documents.select("id", "len", F.explode("tokens").alias("token")).groupBy("id", "len", "token").agg(F.count("*").alias("tf"))
    q = queries.select("query_id", F.size(F.array_distinct("tokens")).alias("distinct"), F.explode("tokens").alias("token"))
    q = q.groupBy("query_id", "distinct", "token").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / mean_length)) / F.col("distinct")
    score = F.least(F.sum(part) / 10.0, F.lit(1.0))
    return docs.join(_few(q), "token").groupBy("query_id", "id").agg(score.alias("keyword"))


def case_text() -> Column:
    """Injuries and comments of a case, in lower case, in which the severity is looked for."""
    return F.lower(F.concat_ws(" ", "injuries", given(F.col("comments"))))


def case_meta(q: Query) -> Column:
    """The meta score of a case, with case_text() as __low, against a query."""
    wanted = F.array(*[F.lit(i) for i in q.injuries]) if q.injuries else F.array().cast("array<string>")
    return meta_score(F.col("injuries"), F.col("comments"), F.col("sex"), F.col("age"), wanted, F.lit(q.gender), F.lit(q.age), F.lit(q.text), F.col("__low"))


def scored(cases: DataFrame, q: Query, given_weights: dict[str, float] | None = None) -> DataFrame:
    """The cases of the selected categories with injury_sim and combined.

    cases: id, ord, case_name, injuries, comments, summary_text, sex, age, regions and, for the vectors, vec.
    """
    w = weights(bool(q.regions), given_weights)
    rows = cases.where(in_categories(F.col("regions"), q.regions))
    vector = lambda v: cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in v])) if v else F.lit(0.0)
    document = document_tokens(F.col("injuries"), F.col("comments"), F.col("case_name"), F.col("summary_text"))
    total = vector(q.full_vector) * w["semantic"] + F.col("injury_sim") * w["injury"] + keyword_score(F.col("__tokens"), q.keywords) * w["keyword"]
    if w["meta"]:
        total = total + case_meta(q) * w["meta"]
    rows = rows.withColumns({"injury_sim": vector(q.injury_vector), "__tokens": document, "__low": case_text()})
    return rows.withColumn("combined", total).drop("__tokens", "__low")


def deduplicated(results: DataFrame, by: list[str] | None = None, score: str = "combined", order: str = "ord") -> DataFrame:
    """Of the results with one name (trimmed, in lower case) the best; those without a name go."""
    name = F.lower(F.trim("case_name"))
    rank = F.row_number().over(Window.partitionBy(*(by or []), name).orderBy(F.desc(score), F.asc(order)))
    return results.where(F.coalesce(name, F.lit("")) != "").withColumn("__r", rank).where("__r = 1").drop("__r")


def top(results: DataFrame, n: int, score: str = "combined", order: str = "ord") -> DataFrame:
    """The n best with rank from 1; equal scores keep their order."""
    best = results.orderBy(F.desc(score), F.asc(order)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(order))))  # n rows


def top_of_each(results: DataFrame, by: str, n: int, score: str = "combined", order: str = "ord") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(order))
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def block_best(block: pd.DataFrame, units: np.ndarray, ids: np.ndarray, vectors: np.ndarray, weight: float, n: int) -> pd.DataFrame:
    """For each query the n best names of a block of cases, each with its best case; more where the n-th score is shared.

    block is sorted by name and id; units are its vectors of length 1, as those of the queries.
    """
    name = block["name"].to_numpy()
    starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    ends = np.r_[starts[1:], len(block)]
    similarity = vectors @ units.T
    total = similarity * weight
    total += block["rest"].to_numpy()
    np.round(total, 9, out=total)
    best = np.maximum.reduceat(total, starts, axis=1)
    k = min(n, len(starts))
    q, s = np.nonzero(best >= -np.partition(-best, k - 1, axis=1)[:, k - 1 : k])
    at = np.array([a + total[i, a:b].argmax() for i, a, b in zip(q, starts[s], ends[s])], int)
    found = block[["id", "case_name", "name"]].iloc[at].reset_index(drop=True)
    return found.assign(query_id=ids[q], similarity=similarity[q, at], combined=total[q, at])


def batch_best(
    batch: pd.DataFrame, numbers: np.ndarray, parts: list[tuple[int, int, np.ndarray]], ids: np.ndarray, vectors: np.ndarray, weight: float, n: int
) -> Iterator[pd.DataFrame]:
    """block_best of a batch of cases for each part of the queries: its first and last place, and which of the cells (by their numbers) it visits."""
    if batch.empty:
        return
    batch = batch.sort_values(["name", "id"], kind="stable", ignore_index=True)
    units, cell = vector_cells.unit(batch["vec"]), np.searchsorted(numbers, batch["cell"])
    for a, b, visits in parts:
        at = np.flatnonzero(visits[cell])
        if len(at):
            block, own = (batch, units) if len(at) == len(batch) else (batch.iloc[at], units[at])
            yield block_best(block, own, ids[a:b], vectors[a:b], weight, n)


#: Cells that each query visits first, queries that are held against a batch's cases at once, and rows of a task about.
FIRST_CELLS, TOGETHER, TASK_ROWS = 2, 256, 65_536


#: Rows found that a task holds beside the best so far, about.
HELD_ROWS = 50_000


def best_so_far(found: Iterable[pd.DataFrame], n: int, held_rows: int = HELD_ROWS) -> pd.DataFrame | None:
    """The n best rows of each query, one for each name, of many tables; they are folded whenever so many rows are held."""
    best, new, count = None, [], 0

    def folded() -> pd.DataFrame:
        rows = pd.concat([*new, *([] if best is None else [best])])
        rows = rows.sort_values(["combined", "id"], ascending=[False, True]).drop_duplicates(["query_id", "name"])
        return rows.groupby("query_id", sort=False).head(n)

    for rows in found:
        new.append(rows)
        count += len(rows)
        if count >= held_rows:
            best, new, count = folded(), [], 0
    return folded() if new else best


def search_many(
    cases: DataFrame, queries: DataFrame, q: Query, n: int = 5, given_weights: dict[str, float] | None = None, most: int = 8192,
    cell_rows: int = vector_cells.ROWS, told: list | None = None,
) -> DataFrame:
    """(query_id, id, case_name, similarity, combined, rank): for each query the n best of all cases, one for each name.

    queries: query_id and vec, in place of q's vectors; the rest of q holds for all of them. Every category counts as
    selected. cases as for scored; those without a vector or a name go.

    Cases lie in cells about centres. A query visits the cells with the greatest bounds first; its n-th best of these
    is what another cell's bound must reach for the cell to be visited: the result is that of all cases. Blocks of at most
    ``most`` queries are held in the tasks against the cells that they visit: pairs are never rows, only the running
    n best of each task are. Queries with the same nearest cell stand together, and TOGETHER of them are held at once against all
    the batch's cases of the cells that one of them visits: the number of products grows with batches and not with cells. Tasks have some TASK_ROWS rows, however many cases there are. told gets, for each block, the
    numbers of pairs of a query and a cell, and of those visited.
    """
    w = weights(True, given_weights)
    weight = w["semantic"] + w["injury"]
    document = document_tokens(F.col("injuries"), F.col("comments"), F.col("case_name"), F.col("summary_text"))
    rest = keyword_score(F.col("__tokens"), q.keywords) * w["keyword"] + case_meta(q) * w["meta"]
    name = F.lower(F.trim("case_name"))
    spark = cases.sparkSession
    rows = cases.where(F.col("vec").isNotNull() & (F.coalesce(name, F.lit("")) != ""))
    rows = rows.withColumns({"__tokens": document, "__low": case_text()}).select("id", "case_name", name.alias("name"), "vec", rest.alias("rest"))
    rows = stored(rows, "search_cases")  # scores and tokens are made once for all queries
    centres = vector_cells.fit_centres(rows, rows=cell_rows)
    rows = stored(vector_cells.with_cells(rows, centres), "search_cells")
    cells = vector_cells.Cells.of(rows, centres)
    tasks = max(1, rows.count() // TASK_ROWS + 1, min(len(cells.numbers), spark.sparkContext.defaultParallelism))
    queries = queries.select("query_id", "vec").where(F.col("vec").isNotNull())
    blocks = max(1, -(-queries.count() // most))
    columns = "query_id long, id long, case_name string, name string, similarity double, combined double"
    best_of = lambda found: top_of_each(deduplicated(found, ["query_id"], order="id"), "query_id", n, order="id")
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()  # one bounded block
        if own.empty or not len(cells.numbers):
            continue
        ids, vectors = own["query_id"].to_numpy(), vector_cells.unit(own["vec"])
        bounds = cells.bounds(vectors, weight)
        near = np.argsort(bounds.argmax(1), kind="stable")
        ids, vectors, bounds = ids[near], vectors[near], bounds[near]

        def visited(visits: np.ndarray) -> DataFrame:
            """The best of the cells that each query visits: a matrix of queries by cells."""
            parts = [(i, i + TOGETHER, visits[i : i + TOGETHER].any(0)) for i in range(0, len(ids), TOGETHER)]
            held = spark.sparkContext.broadcast((ids, vectors, cells.numbers, parts))

            def run(batches):
                ids, vectors, numbers, parts = held.value

                best = best_so_far((found for batch in batches for found in batch_best(batch, numbers, parts, ids, vectors, weight, n)), n)
                if best is not None:
                    yield best[["query_id", "id", "case_name", "name", "similarity", "combined"]]

            wanted = rows.where(F.col("cell").isin([int(c) for c, any_of in zip(cells.numbers, visits.any(0)) if any_of]))
            return wanted.repartition(tasks, "cell", F.pmod(F.xxhash64("id"), F.lit(64))).mapInPandas(run, columns)

        first = np.zeros(bounds.shape, bool)
        first[np.arange(len(ids))[:, None], np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_CELLS]] = True
        found = stored(best_of(visited(first)).drop("rank"), "search_first")
        last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("combined").alias("least")).where(F.col("n") >= n).toPandas()
        least = pd.Series(last["least"].to_numpy(), last["query_id"]).reindex(ids).fillna(-np.inf).to_numpy()
        more = (bounds + 1e-8 >= least[:, None]) & ~first
        if told is not None:
            told.append((bounds.size, int(first.sum() + more.sum())))
        part = found.select(*[c.split()[0] for c in columns.split(", ")])
        part = part.unionByName(visited(more)) if more.any() else part
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], columns)
    return best_of(out).drop("name")


def search(cases: DataFrame, q: Query, n: int = 25, given_weights: dict[str, float] | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """The n best cases, one for each name, without those whose id is in dismissed."""
    if dismissed is not None:
        cases = cases.join(dismissed.select("id"), "id", "left_anti")
    return top(deduplicated(scored(cases, q, given_weights)), n)


def only(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Results whose id is among those that filters leave."""
    return results.join(ids.select("id"), "id", "left_semi")


def search_without_outliers(cases: DataFrame, q: Query, amount: str, n: int = 25, threshold: float = 1.5, **options) -> DataFrame:
    """Three times as many results, without outliers by amount if there are over four, cut to n."""
    found = stored(search(cases, q, 3 * n, **options), "found")  # 3 * n rows; all cases are scored once for the three readings
    kept = without_outliers(found, amount, threshold=threshold)
    few = found.limit(5).count() <= 4
    return top((found if few else kept).drop("rank"), n)


def chart_points(results: DataFrame, amount: str = "damages", adjusted: str = "adjusted", most: int = 15) -> DataFrame:
    """The first results that have an award, a year and an adjusted award, by year: with change, change in per cent and match in per cent."""
    rows = results.where((F.col("rank") <= most) & (F.col(amount) > 0) & F.col("year").isNotNull() & F.col(adjusted).isNotNull())
    delta = F.col(adjusted) - F.col(amount)
    return rows.withColumns({"delta": delta, "delta_percent": delta / F.col(amount) * 100, "match_percent": F.col("combined") * 100}).orderBy("year", "rank")
