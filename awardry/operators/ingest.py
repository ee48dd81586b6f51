"""From table cells and parsed rows to cases.

cells: doc_id, page, table_no, row_no, col_no, text. Tables are small; a table's cells are gathered, never a document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import as_list, contains_any, given, judge_names, once
from ..schemas import AMOUNT, CLAIM, PARSED_ROW, PLAINTIFF
from ..working import stored
from .segments import SLOT, few_each, running, running_whole, slotted

TABLE = ["doc_id", "page", "table_no"]
FILLED = "trim(text) <> '' and trim(text) <> 'nan'"


def section_header(c: Column) -> Column:
    """The cleaned section name, or null for a text that is none."""
    x = F.trim(c)
    named = once(F.upper(x), lambda up: ~contains_any(up, fixed.NO_SECTION) & contains_any(up, fixed.SECTION_PARTS))
    good = ~x.rlike(r"^[$0-9]") & named
    clean = F.regexp_replace(F.regexp_replace(x, r"\s*-\s*\$[\d,.]+", ""), r"\s*-\s*$", "")
    return F.when(good, once(F.trim(clean), given))


def section_in_text(c: Column, ascii_words: bool = False) -> Column:
    """The first section name, in their order, that stands as a whole word in the first 500 characters; null if none does.

    Letters with accents belong to words, or with ascii_words bound them: only A-Z, digits and the underscore are a word's then.
    """
    if ascii_words:
        head = F.translate(F.left(c, F.lit(500)), "\u0131\u017f", "IS")  # the only others that are A-Z in upper case; ß stays one character
        return F.coalesce(*[F.when(head.rlike(rf"(?i)(?<![A-Z0-9_]){s}(?![A-Z0-9_])"), F.lit(s)) for s in fixed.SECTIONS])
    first = lambda up: F.coalesce(*[F.when(F.contains(up, F.lit(s)) & up.rlike(rf"\b{s}\b"), F.lit(s)) for s in fixed.SECTIONS])
    return once(F.upper(F.left(c, F.lit(500))), first)


def page_sections(cells: DataFrame) -> DataFrame:
    """(doc_id, page, section): by the first row of the page's last table, else by all text of its first one; null if neither tells."""
    first_row = F.col("row_no") == 0
    rows = cells.where("row_no is not null").withColumn("clean", F.when(first_row, section_header(F.col("text"))))
    tables = rows.groupBy(*TABLE).agg(
        F.min_by("clean", F.when(F.col("clean").isNotNull(), F.col("col_no"))).alias("s"), F.max(F.when(first_row, F.col("table_no"))).alias("headed"),
        F.array_sort(F.collect_list(F.struct("row_no", "col_no", "text"))).alias("a"),
    )
    tables = tables.withColumn("by_text", section_in_text(F.array_join(F.transform("a", lambda x: x["text"]), " "))).drop("a")
    pages = tables.groupBy("doc_id", "page").agg(F.max_by("s", "headed").alias("by_head"), F.min_by("by_text", "table_no").alias("by_text"))
    return pages.select("doc_id", "page", F.coalesce("by_head", "by_text").alias("section"))


def filled_sections(pages: DataFrame, carry_forward: bool = False, slots: int | None = None) -> DataFrame:
    """(doc_id, page, section) with GENERAL named after the last main section before it, others in upper case, UNKNOWN for none.

    Sections are carried along a document's pages, or over slots of them, if a document has many or ``slots`` are given. Columns
    beside these stay as they are.
    """
    up = F.upper("section")
    main = contains_any(up, fixed.MAIN_SECTIONS)
    if slots is None:
        pages = stored(pages, "pages")
    if slots is None and few_each(pages, ["doc_id"]):
        along = running_whole
    else:
        pages, along = slotted(pages, ["doc_id"], ["page"], slots), running
    rows = along(pages, ["doc_id"], ["page"], __parent=("last", F.when(main, up)))
    named = F.when(up.isNull(), None).when(main | ~F.contains(up, F.lit("GENERAL")) | F.col("__parent").isNull(), up).otherwise(F.concat_ws(" - ", "__parent", up))
    out = rows.withColumn("section", named).drop("__parent")
    if carry_forward:
        out = along(out, ["doc_id"], ["page"], __last=("last", F.col("section"))).withColumn("section", F.col("__last")).drop("__last")
    return out.withColumn("section", F.coalesce("section", F.lit("UNKNOWN"))).drop(SLOT)


def mapped_headers(headers: Column, n: Column) -> Column:
    """Headers of split lines for n columns: Sex and Age, and Non-Pecuniary, General and Damages become one; padded or cut to n."""
    pad = lambda a: F.concat(a, F.transform(F.sequence(F.size(a), n - 1), lambda i: F.concat(F.lit("Col_"), i.cast("string"))))
    low = F.transform(headers, F.lower)
    has_age = F.array_position(low, "age") > 0
    joined = F.transform(
        F.filter(headers, lambda h: ~F.lower(h).isin("age", "general", "damages")),
        lambda h: F.when((F.lower(h) == "sex") & has_age, F.lit("Sex/Age")).when(F.lower(h).rlike("non[- ]pecuniary"), F.lit("Non-Pecuniary Damages")).otherwise(h),
    )
    fit = lambda a: F.when(F.size(a) < n, pad(a)).otherwise(F.slice(a, 1, n))
    return F.when(F.size(headers) > n, fit(joined)).otherwise(fit(headers))


def _tables(cells: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, page, table_no, headers, data_start_row) of the tables that have a known header and a row below it, and more of their cells."""
    row = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no") == r, F.struct("col_no", F.trim("text").alias("t"))))), lambda x: x["t"])
    t = cells.groupBy(*TABLE).agg(row(0).alias("r0"), row(1).alias("r1"), (F.max("row_no") + 1).alias("rows"), (F.max("col_no") + 1).cast("int").alias("n"), *more)
    own = [c for c in t.columns if c not in ("r0", "r1", "n")]
    many = lambda a: F.size(F.filter(a, lambda x: ~x.isin("", "nan"))) > 1
    spread = lambda a: F.transform(a, lambda x, i: F.when(x.isin("", "nan"), F.concat(F.lit("Col_"), i.cast("string"))).otherwise(x))
    head = lambda a: F.replace(F.coalesce(F.get(a, F.lit(0)), F.lit("")), F.lit("\\n"), F.lit("\n"))
    lines = lambda a: mapped_headers(F.filter(F.transform(F.split(head(a), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.col("n"))
    stacked = lambda a: F.contains(head(a), F.lit("\n"))
    second = F.when(stacked(F.col("r1")), lines(F.col("r1"))).when(many(F.col("r1")), spread(F.col("r1"))).otherwise(F.filter("r1", lambda x: x != ""))
    h = F.when(many(F.col("r0")), spread(F.col("r0"))).when(stacked(F.col("r0")), lines(F.col("r0"))).otherwise(second)
    start = F.when(many(F.col("r0")) | stacked(F.col("r0")), 1).otherwise(2)
    t = t.select(*own, h.alias("headers"), start.alias("data_start_row"))
    known = F.arrays_overlap(F.transform("headers", F.lower), F.array(*[F.lit(x) for x in ("plaintiff", "case", "year", "defendant")]))
    return t.where(known & (F.col("rows") >= 2)).drop("rows")


def table_headers(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, headers, data_start_row) of the tables that have a known header and a row below it."""
    return _tables(cells).select(*TABLE, "headers", "data_start_row")


def row_texts(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, table_no, row_no, row_text): lines of header: value for each data row with a value.

    Without headers they are those of table_headers, and a table's cells are gathered once for both.
    """
    if headers is None:
        filled = F.when(F.expr(FILLED), F.struct("row_no", "col_no", F.trim("text").alias("text")))
        rows = _tables(cells, F.collect_list(filled).alias("__cells"))
        rows = rows.select(*TABLE, "headers", "data_start_row", F.explode("__cells").alias("__cell")).select("*", "__cell.*")
        rows = rows.where("row_no >= data_start_row")
    else:
        rows = cells.where(FILLED).join(headers, TABLE).where("row_no >= data_start_row")
    line = F.concat(F.coalesce(F.get("headers", F.col("col_no").cast("int")), F.concat(F.lit("Col_"), F.col("col_no").cast("string"))), F.lit(": "), F.trim("text"))
    rows = rows.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", line.alias("line")))).alias("a"))
    return rows.select(*TABLE, "row_no", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("row_text"))


def decoded_rows(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows with the fields of a JSON payload in place of it; rows whose payload can't be read go. Judges become lists of surnames."""
    parsed = F.inline(F.array(F.from_json(payload, PARSED_ROW, {"mode": "PERMISSIVE"})))  # a generator: each payload is parsed once
    out = rows.select(*[c for c in rows.columns if c != payload], parsed)
    whole = F.coalesce(*[F.col(c).cast("string") for c in ("case_name", "plaintiff_name", "year", "comments", "is_continuation", "non_pecuniary_damages")])
    return out.where(whole.isNotNull()).withColumns({"judge": judge_names(as_list(F.col("judge"))), "is_continuation": F.coalesce("is_continuation", F.lit(False))})


def record_numbers(rows: DataFrame, by: list[str], order: list[str], continues: Column, out: str = "record", slots: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the number of the record to which each belongs: a row that continues belongs to the last one that doesn't, before it.

    Records are counted along each group, or, if a group is large or ``slots`` are given, in slots of a group's rows, and the counts
    carried over them. sizes is a table with at least the rows of each group that tells more cheaply how large they are.
    """
    starts = rows.withColumn("__starts", F.when(continues, 0).otherwise(1))
    if slots is None and few_each(rows if sizes is None else sizes, by):
        return running_whole(starts, by, order, **{out: ("sum", F.col("__starts"))}).drop("__starts")
    starts = slotted(starts, by, order, slots)
    return running(starts, by, order, **{out: ("sum", F.col("__starts"))}).drop("__starts", SLOT)


def joined_comments(texts: Column) -> Column:
    return given(F.array_join(F.filter(texts, lambda c: given(c).isNotNull()), " | "))


def merged_records(rows: DataFrame, order: list[str]) -> DataFrame:
    """A case for each (doc_id, record) of decoded rows: greatest damages, comments joined, injuries united, lists one after the other,
    plaintiffs of one id merged; everything else from the first row. Continuation rows before any record are dropped.

    Plaintiffs come to rows of their own, the first of a row with the row's other fields, so that a record's rows and plaintiffs are
    gathered in one pass: rows that are dealt by doc_id already stay where they are, and others are sent once.
    """
    rows = rows.where("record > 0")
    keys = ["doc_id", "record"]
    merged = ["non_pecuniary_damages", "comments", "injuries", "other_damages", "family_law_act_claims"]
    plain = [c for c in rows.columns if c not in {*keys, *order, *merged, "plaintiffs"}]
    at, own = F.struct(*order), F.struct(F.struct(*order).alias("at"), *plain, *merged)
    people = rows.select(*keys, at.alias("__at"), own.alias("__own"), F.posexplode_outer("plaintiffs").alias("__pos", "p"))
    place = F.to_json(F.struct(*[F.col(f"__at.{c}").cast("string") for c in order], F.col("__pos").cast("string")))
    id_ = F.coalesce(given(F.col("p.plaintiff_id")), F.concat(F.lit("\u0000"), place))
    people = people.withColumn("__id", F.when(F.col("__pos").isNotNull(), id_))  # null for rows without plaintiffs
    person = F.when(F.col("__pos").isNotNull(), F.struct(F.struct("__at", "__pos").alias("w"), "p"))
    people = people.groupBy(*keys, "__id").agg(
        F.array_sort(F.collect_list(person)).alias("__p"), F.collect_list(F.when(F.coalesce("__pos", F.lit(0)) == 0, F.col("__own"))).alias("__rows")
    )
    each = lambda a, c: F.transform(a, lambda x: x[c])
    lists = lambda a, c: F.flatten(F.filter(each(a, c), lambda x: x.isNotNull()))
    p = F.transform("__p", lambda x: x["p"])
    first = F.get(p, F.lit(0))
    plaintiff = F.struct(
        *[first[c].alias(c) for c in ("plaintiff_id", "plaintiff_name", "sex", "age")], F.array_max(each(p, "non_pecuniary_damages")).alias("non_pecuniary_damages"),
        F.array_distinct(lists(p, "injuries")).alias("injuries"), joined_comments(each(p, "comments")).alias("comments"),
    ).cast(PLAINTIFF)
    people = people.select(*keys, "__rows", F.when(F.col("__id").isNotNull(), F.struct(F.get("__p", F.lit(0))["w"].alias("w"), plaintiff.alias("p"))).alias("__person"))
    cases = people.groupBy(*keys).agg(F.array_sort(F.collect_list("__person")).alias("__people"), F.array_sort(F.flatten(F.collect_list("__rows"))).alias("__rows"))
    start = F.get("__rows", F.lit(0))
    return cases.select(
        *keys, *[start[c].alias(c) for c in plain], F.array_max(each("__rows", "non_pecuniary_damages")).alias("non_pecuniary_damages"),
        joined_comments(each("__rows", "comments")).alias("comments"), F.array_distinct(lists("__rows", "injuries")).alias("injuries"),
        lists("__rows", "other_damages").cast(f"array<struct<{AMOUNT}>>").alias("other_damages"), lists("__rows", "family_law_act_claims").cast(f"array<{CLAIM}>").alias("family_law_act_claims"),
        F.when(F.size("__people") > 0, each("__people", "p")).alias("plaintiffs"), *[start["at"][c].alias(c) for c in order],
    )


def cleaned(cases: DataFrame) -> DataFrame:
    """Cases with a name; plaintiffs with a name, injuries, damages or comments; case injuries with those of plaintiffs."""
    filled = lambda p: (
        given(p["plaintiff_name"]).isNotNull() | (F.coalesce(F.size(p["injuries"]), F.lit(0)) > 0)
        | (F.coalesce(p["non_pecuniary_damages"], F.lit(0.0)) != 0) | given(p["comments"]).isNotNull()
    )
    none = F.array().cast("array<string>")
    out = cases.where(F.trim(F.coalesce("case_name", F.lit(""))) != "").withColumn("plaintiffs", F.filter("plaintiffs", filled))
    out = out.withColumn("plaintiffs", F.when(F.size("plaintiffs") > 0, F.col("plaintiffs")))
    theirs = F.flatten(F.transform(F.coalesce("plaintiffs", F.array().cast(f"array<{PLAINTIFF}>")), lambda p: F.coalesce(p["injuries"], none)))
    return out.withColumn("injuries", F.array_union(F.coalesce("injuries", none), theirs))


def ingest(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Cases of rows with a payload: decoded, continuation rows merged, cleaned. rows has doc_id, page, table_no, row_no."""
    order = ["page", "table_no", "row_no"]
    numbered = record_numbers(decoded_rows(rows, payload), ["doc_id"], order, F.col("is_continuation"), sizes=rows)
    return cleaned(merged_records(numbered, order))


def counted_ingest(rows: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(cases of ingested_cases, one row of ingest_counts), the counts observed while rows are decoded and cases written.

    Rows are decoded once and cases written once, by one action (two, if rows are stored to be dealt to slots) that runs no
    other plan beside it, so that nothing is counted twice but tasks that are lost after they ended.
    """
    seen, made = Observation(), Observation()
    news = F.col("is_continuation")
    decoded = decoded_rows(rows, payload).observe(seen, F.count("*").alias("rows"), F.count_if(~news).alias("new"), F.count_if(news).alias("merged"))
    order = ["page", "table_no", "row_no"]
    numbered = record_numbers(decoded, ["doc_id"], order, news, sizes=rows)
    cases = stored(cleaned(merged_records(numbered, order)).observe(made, F.count("*").alias("cases")), "ingested")
    told = {**seen.get, **made.get}
    return cases, rows.sparkSession.createDataFrame([tuple(told[k] for k in COUNTS)], ", ".join(f"{k} long" for k in COUNTS))


COUNTS = ("rows", "new", "merged", "cases")


def ingest_counts(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: rows, those that start a record, those merged, and cases after cleaning. rows is decoded."""
    one = rows.agg(F.count("*").alias("rows"), F.count_if(~F.col("is_continuation")).alias("new"), F.count_if(F.col("is_continuation")).alias("merged"))
    return one.crossJoin(cases.agg(F.count("*").alias("cases")))
