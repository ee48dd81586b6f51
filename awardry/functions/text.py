"""Functions of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .patterns import all_matches


def once(c: Column, f) -> Column:
    """f(c), c being evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def given(c: Column) -> Column:
    """null for an empty text: empty counts as missing."""
    return F.when(c != "", c)


def some(c: Column) -> Column:
    """null for an empty array."""
    return F.when(F.size(c) > 0, c)


def as_list(c: Column) -> Column:
    """A field that may be a scalar or a JSON list, as array<string>; null when missing."""
    listed = F.from_json(c, "array<string>")
    return F.when(F.ltrim(c).startswith("["), F.filter(listed, lambda x: F.coalesce(x != "", F.lit(False)))).otherwise(F.when(given(c).isNotNull(), F.array(c)))


def title_case(c: Column) -> Column:
    """Upper case after each character that isn't a letter, lower case elsewhere."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def normal(c: Column) -> Column:
    return F.upper(F.trim(c))


def tokens(c: Column) -> Column:
    """Whole words of two or more letters a-z; words with other letters, digits or underscores vanish."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]{2,}$"))


def phrases(c: Column) -> Column:
    """The comma-separated parts, trimmed, in lower case, without blanks."""
    return F.filter(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def folded(a: Column) -> Column:
    """The set of an array's texts, trimmed and in lower case."""
    return F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x))))


def distinct_folded(a: Column) -> Column:
    """An array without later texts that equal an earlier one but for case and outer spaces."""
    keys = F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.filter(a, lambda x, i: F.array_position(keys, F.lower(F.trim(x))) == i + 1)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_of(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def matches(text: Column, patterns: list[str]) -> Column:
    """Group 1 of all matches, pattern after pattern, trimmed; several lists of patterns share a pass in patterns.all_matches."""
    return all_matches(text, found=patterns)["found"]


def as_injuries(found: Column, most: int = 10) -> Column:
    """Matches of over three characters, without repetitions, the first ones."""
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.char_length(x) > 3)), 1, most)


def comment_injuries(c: Column, most: int = 10) -> Column:
    """Injuries that comments speak of."""
    return as_injuries(matches(F.lower(F.coalesce(c, F.lit(""))), fixed.COMMENT_INJURIES), most)


def as_findings(found: Column, most: int = 10) -> Column:
    """Matches cut to 80 characters, without repetitions, the first ones."""
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.left(x, F.lit(80)))), 1, most)


def report_findings(c: Column, patterns: list[str], most: int = 10) -> Column:
    """What expressions find in a report, in order of occurrence."""
    return as_findings(matches(F.lower(c), patterns), most)


def report_severity(c: Column) -> Column:
    told = lambda low: F.when(contains_any(low, fixed.REPORT_SEVERE), "severe").when(contains_any(low, fixed.REPORT_MILD), "mild").otherwise("moderate")
    return F.coalesce(once(F.lower(c), told), F.lit("moderate"))


def search_text(injuries: Column, comments: Column, case_name: Column) -> Column:
    """Injuries, else those of the comments, else the name, else "case"."""
    joined = lambda a: given(F.array_join(a, "; "))
    return F.coalesce(joined(injuries), joined(comment_injuries(comments)), given(case_name), F.lit("case"))


def shortened(c: Column, most: int = 400) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def type_label(c: Column) -> Column:
    """future_loss_of_income -> Future Loss Of Income."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def dollars(c: Column, decimals: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, decimals))


def claim_summary(claims: Column) -> Column:
    """description: $amount; ... of the claims, N/A without any."""
    one = lambda c: F.concat(F.coalesce(given(c["description"]), F.lit("N/A")), F.lit(": "), dollars(F.coalesce(c["amount"], F.lit(0.0))))
    return F.coalesce(given(F.array_join(F.transform(claims, one), "; ")), F.lit("N/A"))


def judge_name(c: Column) -> Column:
    """The surname: titles, honours and commas taken off, last word, title case; null when nothing is left."""
    x = F.regexp_replace(F.trim(c), r"(?i)[\s,]+(C\.J\.[OC]|J\.J\.A|J\.A|C\.J|J)\.$", "")
    x = F.regexp_replace(x, r"(?i)^(The\s+)?((Honourable|Hon)\.?\s+)?", "")
    x = F.trim(F.regexp_replace(x, r"[,\s]+", " "))
    x = F.rtrim(F.element_at(F.split(x, " "), -1), F.lit("."))
    return once(title_case(x), given)


def judge_names(a: Column) -> Column:
    return once(F.filter(F.transform(a, judge_name), lambda x: x.isNotNull()), some)


def dashboard_summary(injuries: Column, categories: Column, comments: Column, most: int | None = 10, label: str = "Categories: ") -> Column:
    """Injuries: ... | Categories: ... | Comments: ..."""
    first = F.slice(injuries, 1, most) if most else injuries
    part = lambda name, c: F.when(given(c).isNotNull(), F.concat(F.lit(name), c))
    text = F.concat_ws(" | ", part("Injuries: ", F.array_join(first, ", ")), part(label, F.array_join(categories, ", ")), part("Comments: ", comments))
    return F.coalesce(given(text), F.lit("No summary available"))
