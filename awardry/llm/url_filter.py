"""Operator 4: URL filters by a trie over reversed host labels and path segments.

A rule is a host and a path, to allow or to block. It fits its host and all subdomains, if the URL's
path starts with the rule's; among the rules that fit, the one with most host labels wins, then the
one with the longest path; of equal rules, block wins. Rules are compiled to a trie: host labels from
the last to the first, then whole path segments, then rests of segments. The trie goes to all
executors if the rule table has at most BROADCAST_RULES rows and BROADCAST_CHARS characters. Beyond that
the same answer comes from an equi-join of the rules with the (host suffix, path prefix) keys that a URL has.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits. The
host keeps a port or user name, so it fits only rules that have them. No rule that fits: rule null,
and the verdict is ``default``. Repeated rows are each judged. An empty table gives an empty result.
Other columns pass through; columns with the names of the results are replaced. Rules with a null
host or path are left out. Very long paths are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_small, salted

#: Rules in a trie that is broadcast, and characters in all of them, at most.
BROADCAST_RULES, BROADCAST_CHARS = 200_000, 16_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


class Trie:
    """Nodes are numbers, and arcs are in flat tables, however deep the rules: (node, label or segment) -> node."""

    def __init__(self, rules):
        self.labels: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        #: (node, rest of a segment) -> verdict, host, path
        self.rests: dict[tuple[int, str], tuple[str, str, str]] = {}
        #: longest rest of each node that has one
        self.longest: dict[int, int] = {}
        nodes = 0
        for verdict, host, path in sorted({tuple(r) for r in rules if None not in tuple(r)}):  # allow before block, which replaces it
            node = 0
            *whole, rest = path.split("/")
            for arcs, name in [*((self.labels, x) for x in reversed(host.split("."))), *((self.segments, x) for x in whole)]:
                if (node, name) not in arcs:
                    nodes += 1
                    arcs[node, name] = nodes
                node = arcs[node, name]
            self.rests[node, rest] = verdict, host, path
            self.longest[node] = max(self.longest.get(node, 0), len(rest))

    def rule(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The rule that wins for a host and a path."""
        hosts, node = [], 0
        for label in reversed(host.split(".")):
            node = self.labels.get((node, label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                for n in range(min(len(segment), self.longest.get(node, -1)), -1, -1):
                    if (node, segment[:n]) in self.rests:
                        best = self.rests[node, segment[:n]]
                        break
                node = self.segments.get((node, segment))
                if node is None:
                    break
            if best is not None:
                return best
        return None


def with_parts(pages: DataFrame, url: str) -> DataFrame:
    """pages with host and path of the url."""
    source = free_name(pages, "__url")
    pages = pages.withColumn(source, F.coalesce(F.col(url).cast("string"), F.lit("")))
    host = F.translate(F.regexp_extract(source, "://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(source, "://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path}).drop(source)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that wins, or null) and verdict.

    rules has the string columns verdict (allow or block), host (lower case) and path.
    """
    rules = rules.select("verdict", "host", "path").dropna().distinct()
    pages = with_parts(pages.drop("rule", "verdict"), url)
    size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    if size[0] > broadcast_rules or size[1] > BROADCAST_CHARS:
        return _joined(pages, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules.collect()))

    @F.pandas_udf("rule string, verdict string")
    def judge(host, path):
        import pandas as pd

        found = [trie.value.rule(h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [r and r[1] + r[2] for r in found], "verdict": [r[0] if r else default for r in found]}, dtype="object")

    out = free_name(pages, "__judged")
    pages = pages.withColumn(out, judge("host", "path"))
    return pages.withColumns({"rule": F.col(f"{out}.rule"), "verdict": F.col(f"{out}.verdict")}).drop(out)


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule tables that can't be broadcast: each different (host, path) is joined by its suffixes and prefixes.

    A path has a prefix for each length that some rule's path has and no others, and of a prefix only its hash is
    carried, so that a long path costs no more rows than a short one. Hits are compared with the rule itself. Keys are salted:
    the pages of one suffix go to many tasks.
    """
    lengths = [r[0] for r in rules.select(F.char_length("path").alias("n")).distinct().sort("n").collect()]  # as many as there are lengths
    labels = F.split("host", r"\.")
    suffix = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    prefix = F.transform(wanted, lambda n: F.xxhash64(F.substring("path", F.lit(1), n)))
    keys = pages.select("host", "path").distinct()
    keys = keys.withColumn("__s", F.explode(suffix)).withColumn("__p", F.explode(prefix)).withColumn("__k", F.xxhash64("__s", "__p"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("v")).toDF("rh", "rp", "v").withColumn("__k", F.xxhash64("rh", F.xxhash64("rp")))
    rank = F.struct(F.size(F.split("rh", r"\.")), F.char_length("rp"))
    best = salted(keys, rules, "__k", "path").where((F.col("__s") == F.col("rh")) & F.startswith("path", F.col("rp")))
    best = best.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "v"), rank).alias("best"))
    out = join_small(pages, best, ["host", "path"], BROADCAST_RULES)  # a page without url is one of a third of all rows, perhaps
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.v", F.lit(default))}).drop("best")


def op4_url_filters(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = rf"""
with p as (select row_number() over () as rid, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(verdict, h, q) as (values {_VALUES}),
f as (select rid, h || q as rule, verdict, row_number() over (partition by rid order by len(string_split(h, '.')) desc, length(q) desc) as k
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join (select * from f where k = 1) f on p.rid = f.rid
"""
