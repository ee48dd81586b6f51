"""Operator 1: secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over case-folded trigrams (an OR of
ANDs). The index has, for each trigram that some rule asks for and each block of documents, the
sorted ids of the documents which hold it; a rule's postings are intersected block by block, the
documents left are verified with the expression itself, and the rest are not scanned for that rule.
The number of blocks follows the number of documents, which Parquet tells without reading them.
A rule without mandatory trigrams scans every document. Only DataFrame functions are used.

Edge cases: a null text counts as empty. Documents with a null id aren't indexed: all rules scan
them. Every input row gives one output row, repeated rows too; rows that share an id are candidates
together and verified each by its own text. An empty table gives an empty result. Other columns
pass through; a column called ``secrets`` is replaced. Positions count code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, stored


@dataclass(frozen=True)
class Rule:
    """kind; expression (syntax common to Java and Python); a match counts if its group has least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_HEADERS = r"[\x20\x09-\x0D]*(?:[A-Za-z][A-Za-z0-9-]*:[^\x0A]*\x0A){0,8}[\x0A\x0D]*"

#: The three base kinds, then public formats of access tokens.
ASSIGN = Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", r"[0-9a-f]{24,}", 0, 24)
BASE = (ASSIGN, ACCESS, HEX)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # with its header lines and body up to the end line; without an end line, the lines of a body alone and no prose
    Rule("pem", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_HEADERS}[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----|{_HEADERS}[A-Za-z0-9+/=\x0A\x0D]{{40,}})?"),
)

#: Classes of up to so many folded characters, and runs of up to so many strings, are spelled out.
CLASS_SIZE, RUN_SIZE = 6, 64
#: Documents in a block of the index; candidates to broadcast at most.
BLOCK_DOCS, BROADCAST_ROWS = 8192, 100_000

EVERYTHING = frozenset([frozenset()])


def absorbed(query: frozenset) -> frozenset:
    return frozenset(q for q in query if not any(p < q for p in query))


def both(a: frozenset, b: frozenset) -> frozenset:
    joint = absorbed(frozenset(p | q for p in a for q in b))
    return joint if len(joint) <= RUN_SIZE else min(a, b, key=len)  # weaker, and still mandatory


def of_strings(strings: set[str]) -> frozenset:
    return absorbed(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> frozenset:
    """An OR of ANDs of folded trigrams that any match must hold; EVERYTHING if there are none."""
    from re import _constants as C
    from re import _parser as parser

    def exact(seq) -> set[str] | None:
        run, rest = walk(seq)
        return run if rest is None else None

    def walk(seq) -> tuple[set[str], frozenset | None]:
        """The strings that the end of seq can spell, and the query of what lies before (None: seq has nothing before)."""
        run, query = {""}, None

        def cut(more: frozenset = EVERYTHING):
            nonlocal run, query
            query = both(both(query or EVERYTHING, of_strings(run)), more)
            run = {""}

        def spell(options: set[str] | None, more: frozenset = EVERYTHING):
            nonlocal run
            if options is None or len(options) > RUN_SIZE:
                return cut(more)
            if len(run) * len(options) > RUN_SIZE:
                cut()
            run = {a + b for a in run for b in options}

        for op, arg in seq:
            if op is C.LITERAL:
                spell({chr(arg).lower()})
            elif op is C.IN:
                chars = set()
                for kind, x in arg:
                    if kind is C.LITERAL:
                        chars.add(chr(x).lower())
                    elif kind is C.RANGE and x[1] - x[0] < 2 * CLASS_SIZE:
                        chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        chars |= {str(i) for i in range(CLASS_SIZE + 1)}
                        break
                spell(chars if len(chars) <= CLASS_SIZE else None)
            elif op is C.SUBPATTERN:
                inside = exact(arg[3])
                spell(inside, EVERYTHING if inside is not None else whole(arg[3]))
            elif op is C.BRANCH:
                inside = [exact(b) for b in arg[1]]
                if None not in inside:
                    spell(set().union(*inside))
                else:
                    spell(None, absorbed(frozenset().union(*(whole(b) for b in arg[1]))))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, body = arg
                inside = exact(body)
                if least == 0 and most == 1 and inside is not None:
                    spell(inside | {""})
                elif least == 0:
                    cut()
                elif inside is None:
                    cut(whole(body))
                else:
                    for _ in range(min(least, 8)):
                        spell(inside)
                    if most > min(least, 8):
                        cut()
            elif op is not C.AT:
                cut()
        return run, query

    def whole(seq) -> frozenset:
        run, query = walk(seq)
        return both(query or EVERYTHING, of_strings(run))

    return whole(list(parser.parse(pattern)))


def trigram_index(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, block, ids): for each trigram of the vocabulary the documents whose folded text holds it."""
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    folded = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lower(filled(docs, text)).alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in vocabulary]))
    postings = folded.select("id", F.explode(held).alias("trigram"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return postings.groupBy("trigram", block).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def candidates(index: DataFrame, plan: dict[str, frozenset]) -> DataFrame:
    """(id, kinds): what each document has to be verified for, by intersected postings."""
    terms = [(kind, n, t, len(conj)) for kind, query in plan.items() for n, conj in enumerate(sorted(query, key=sorted)) for t in sorted(conj)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, conj int, term string, terms int")
    lists = index.join(F.broadcast(asked), index["trigram"] == asked["term"])
    lists = lists.groupBy("kind", "conj", "block", "terms").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("terms"))
    common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    found = lists.select("kind", F.explode(common).alias("id"))
    return found.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, rank, kind, end>> of one rule's matches, leftmost first."""
    rx = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    group = F.regexp_extract_all(text, rx, F.lit(rule.group))
    sizes = F.zip_with(
        F.zip_with(whole, group, lambda m, g: F.struct(F.char_length(m).alias("n"), F.char_length(g).alias("g"))),
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)),
        lambda m, gap: F.struct(m["n"].alias("n"), m["g"].alias("g"), F.char_length(gap).alias("gap")),
    )
    rank = next((i for i, r in enumerate(RULES) if r.kind == rule.kind), len(RULES))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), b.alias("end"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["n"]).alias("at"),
            F.when(m["g"] >= rule.least, F.array_append(acc["out"], span(acc["at"] + m["gap"], acc["at"] + m["gap"] + m["n"])))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def with_kinds(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __kinds of found, which is unique in key; rows without a key, which match nothing, don't meet in one task."""
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(found), key, "left")
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(text), F.lit(4096))).otherwise(0)
    return docs.withColumn("__spread", spread).join(found.withColumn("__spread", F.lit(0).cast("long")), [key, "__spread"], "left").drop("__spread")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secrets: array<struct<start, rank, kind, end>>, by start, then in the rules' order."""
    plan = {r.kind: trigram_query(r.pattern) for r in rules}
    plan = {k: q for k, q in plan.items() if q != EVERYTHING}
    docs = docs.drop("secrets")
    if plan:
        vocabulary = sorted({t for q in plan.values() for conj in q for t in conj})
        index = trigram_index(docs.select(key, text), vocabulary, key, text)
        found = stored(candidates(index, plan), "secret_candidates").select(F.col("id").alias(key), F.col("kinds").alias("__kinds"))
        docs = with_kinds(docs, found, key, text)
    else:
        docs = docs.withColumn("__kinds", F.array().cast("array<string>"))
    body = filled(docs, text)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for r in rules:
        asked = (F.array_contains("__kinds", r.kind) | F.col(key).isNull()) if r.kind in plan else body.rlike(r.pattern)
        parts.append(F.when(asked, spans(body, r)).otherwise(none))
    return docs.withColumn("secrets", F.sort_array(F.concat(*parts))).drop("__kinds")


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """text with the mark in place of each span; spans that overlap share one."""
    out = F.aggregate(
        secrets,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(secrets) > 0, out).otherwise(text)


def listed(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scans(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def re2(rule: Rule) -> str:
    """The expression with letters of either case spelled out: (?i:) of DuckDB folds beyond ASCII."""
    return re.sub(
        r"\(\?i:\((.*?)\)\)",
        lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")",
        rule.pattern,
    ).replace("'", "''")


def secrets_sql() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        rx = re2(r)
        parts.append(f"""select rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'rank': {rank}, 'kind': '{r.kind}', 'ok': length(g[i]) >= {r.least},
  's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i])}})) as x
  from (select rid, regexp_extract_all(t, '{rx}', 0) as m, regexp_extract_all(t, '{rx}', {r.group}) as g, string_split_regex(t, '{rx}') as p from src where regexp_matches(t, '{rx}'))""")
    one = "x.kind || ':' || x.s::bigint || ':' || (x.s + x.n)::bigint"
    return f"""with src as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as (select rid, x from ({' union all '.join(parts)}) where x.ok),
agg as (select rid, {', '.join(f"count(*) filter (x.kind = '{r.kind}') as n_{r.kind}" for r in BASE)},
  string_agg({one}, ',' order by x.s, x.rank) filter (x.rank < {len(BASE)}) as base, string_agg({one}, ',' order by x.s, x.rank) as spans from found group by rid)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from src left join agg on src.rid = agg.rid"""


ORACLE = secrets_sql()
