"""Operator 9: preference formatting of conversations.

Chosen and rejected conversations of one key are compared turn by turn. Their longest common prefix
(role and text equal) is rendered once, as the prompt; what follows is rendered as two completions.
Each completion comes with a mask: the spans (start:end, code points, end exclusive) of its assistant
texts, with their end marks, which training scores; the rest of it, and the prompt, are not scored.
Only DataFrame functions are used.

A conversation's turns are sorted by turn, then role, then text, nulls first. Turns are aggregated by
key, and a rendered conversation is one value by what it is; a key's turns must fit in memory, as its text must.

Edge cases: null roles and texts count as empty. Rows with a null key form no conversation. Repeated
rows are repeated turns. A key in only one of the tables is paired with an empty conversation. Equal
conversations give two empty completions. ``paired`` says whether both completions have a scored span;
no conversation is left out. Empty tables give an empty result. Other columns are dropped. A very long
turn is carried whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a turn: role, text.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"
SCORED = "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def turns_of(table: DataFrame, key: str, out: str) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias(out))


def head(t: Column) -> Column:
    return F.concat(F.lit(BEFORE), t["role"], F.lit(BETWEEN))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(AFTER))), "")


def mask(turns: Column) -> Column:
    """The scored spans of rendered(turns), as start:end joined by commas."""
    end = F.lit(len(AFTER))
    spans = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(head(t)) + F.char_length(t["text"]) + end).alias("at"),
            F.when(
                t["role"] == SCORED,
                F.array_append(
                    acc["out"],
                    F.concat_ws(
                        ":",
                        (acc["at"] + F.char_length(head(t))).cast("string"),
                        (acc["at"] + F.char_length(head(t)) + F.char_length(t["text"]) + end).cast("string"),
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.array_join(spans, ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, paired for each key.

    Both tables have a row for each turn: key, turn, role, text. The number of a turn only orders it.
    """
    pairs = turns_of(chosen, key, "__c").join(turns_of(rejected, key, "__r"), key, "full")
    none = F.array().cast(TURNS)
    pairs = pairs.select(key, F.coalesce("__c", none).alias("__c"), F.coalesce("__r", none).alias("__r"))
    equal = F.zip_with("__c", "__r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_apart = F.array_position(equal, False).cast("int")
    common = F.when(first_apart > 0, first_apart - 1).otherwise(F.size("__c"))
    pairs = pairs.withColumn("__n", common)
    rest = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
    out = pairs.select(
        key,
        F.col("__n").cast("long").alias("n_prompt_turns"),
        rendered(F.slice("__c", 1, F.col("__n"))).alias("prompt"),
        rendered(rest("__c")).alias("chosen"), mask(rest("__c")).alias("chosen_mask"),
        rendered(rest("__r")).alias("rejected"), mask(rest("__r")).alias("rejected_mask"),
    )
    return out.withColumn("paired", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


#: Answers are exchanged among conversations whose ids have the same quotient by this number.
NEIGHBOURS = 1000


def with_other_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations: both cut after the last assistant turn, which in the rejected has another's text.

    conversations.parquet has no rejected answers. Among the conversations whose conv_id (an integer) has the same
    quotient by NEIGHBOURS and whose last assistant turn has the same number, the different texts of these turns
    form a ring in their order; an answer's counterpart is the next text of its ring, so it always differs. A
    ring has NEIGHBOURS texts at most. An answer alone in its ring has no counterpart, and the rejected side
    ends before it; a conversation without an assistant's turn stays as it is, on both sides. Of several rows of
    the last turn the assistant's with the greatest text is the answer; assistant turns without number are none.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = rows.where((F.col("role") == SCORED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    said = said.select("conv_id", F.expr(f"conv_id div {NEIGHBOURS}").alias("part"), "own.*")
    w = Window.partitionBy("part", "turn")
    ring = said.select("part", "turn", "text").distinct()
    ring = ring.withColumn("other", F.coalesce(F.lead("text").over(w.orderBy("text")), F.min("text").over(w)))
    said = said.join(ring, ["part", "turn", "text"])
    before = rows.join(said.select("conv_id", F.col("turn").alias("last")), "conv_id", "left")
    before = before.where(F.coalesce(F.col("turn") < F.col("last"), F.lit(True))).select(rows.columns)
    answer = lambda df, c: df.select("conv_id", "turn", F.lit(SCORED).alias("role"), F.col(c).alias("text"))
    return before.unionByName(answer(said, "text")), before.unionByName(answer(said.where("other <> text"), "other"))


def op9_preference_pairs(spark, sf_dir) -> DataFrame:
    """One row for each conversation; those that aren't ``paired`` have no answer, or one alone in its ring."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return preference_pairs(*with_other_answers(conversations))


_RENDER = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"


def _side(name: str) -> str:
    return f"""{name}_l as (select conv_id, k, role, {_RENDER} as x, length('<|' || role || '|>') + 1 as h from {name}_k),
{name}_p as (select l.*, coalesce(sum(length(x)) over (partition by l.conv_id order by k rows between unbounded preceding and 1 preceding), 0) as pos from {name}_l l join n on n.conv_id = l.conv_id where k > n.n),
{name}_o as (select conv_id, string_agg(x, '' order by k) as body, string_agg(case when role = 'assistant' then (pos + h)::bigint || ':' || (pos + length(x))::bigint end, ',' order by k) as mask from {name}_p group by conv_id)"""


ORACLE = rf"""
with cv as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
la as (select conv_id, conv_id // {NEIGHBOURS} as part, turn, text from (select *, row_number() over (partition by conv_id order by turn desc, text desc) as k from cv where role = 'assistant' and turn is not null) where k = 1),
ring as (select part, turn, text, coalesce(lead(text) over (partition by part, turn order by text), min(text) over (partition by part, turn)) as other from (select distinct part, turn, text from la)),
bf as (select cv.* from cv left join la on la.conv_id = cv.conv_id where coalesce(cv.turn < la.turn, true)),
ch as (select * from bf union all select conv_id, turn, 'assistant', text from la),
rj as (select * from bf union all select conv_id, turn, 'assistant', other from la join ring using (part, turn, text) where other <> text),
c_k as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from ch),
r_k as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from rj),
z as (select c.conv_id, c.k, (c.role = r.role and c.text = r.text) as same from c_k c left join r_k r on r.conv_id = c.conv_id and r.k = c.k),
n as (select conv_id, coalesce(min(case when same is not true then k end) - 1, max(k)) as n from z group by conv_id),
{_side('c')}, {_side('r')},
p as (select c_l.conv_id, string_agg(x, '' order by k) as prompt from c_l join n on n.conv_id = c_l.conv_id where k <= n group by c_l.conv_id)
select n.conv_id, n.n::bigint as n_prompt_turns, coalesce(prompt, '') as prompt, coalesce(c_o.body, '') as chosen, coalesce(c_o.mask, '') as chosen_mask, coalesce(r_o.body, '') as rejected, coalesce(r_o.mask, '') as rejected_mask,
  (c_o.mask is not null and r_o.mask is not null) as paired
from n left join p on p.conv_id = n.conv_id left join c_o on c_o.conv_id = n.conv_id left join r_o on r_o.conv_id = n.conv_id
"""
