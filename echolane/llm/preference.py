"""Preference pairs of conversations as one prompt and two masked completions.

A pair has two conversations as arrays of turns. The longest run of turns, equal in role and text,
that both begin with is rendered once as the prompt; what follows is rendered for either side, with
the places of the assistant's words, which alone are to be learnt. All of it is array functions
inside the row of the pair; gathering turns into conversations is the only shuffle.

A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>`` and a line break; ``<|`` in a
text becomes ``< |`` so that no text can pose as a mark. A mask covers text and end mark. Places
are code points, ends exclusive.

Defined cases: a missing role or text is an empty one; turns without a number come first; turns of
the same number are ordered by role, then text; equal rows are turns of their own; a missing side
is a conversation without turns; two equal conversations give a prompt and empty completions; empty
tables give none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def gather_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, turns``: the turns ``key, turn, role, text`` of every conversation, in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(row))
    return turns.groupBy(key).agg(ordered.alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(left: Column, right: Column) -> Column:
    """How many turns two conversations share at their beginning."""
    first = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(left).cast("long"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of every assistant's words in the rendered turns, joined by commas."""

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(_head(turn))
        end = begin + F.length(_body(turn))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_pairs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask`` of ``key, chosen, rejected``."""
    none = F.array().cast(_TURNS)
    sides = pairs.select(key, F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    sides = sides.withColumn("n_prompt", common_turns(F.col("chosen"), F.col("rejected")).cast("int"))
    rest = {side: F.slice(side, F.col("n_prompt") + 1, F.size(side)) for side in ("chosen", "rejected")}
    columns = [column for side, turns in rest.items() for column in (render(turns).alias(side), mask(turns).alias(f"{side}_mask"))]
    return sides.select(key, F.col("n_prompt").cast("long").alias("n_prompt"), render(F.slice("chosen", F.lit(1), F.col("n_prompt"))).alias("prompt"), *columns)


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from conversations ``conv_id, turn, role, text`` without given preferences.

    Chosen is a conversation up to its last reply by the assistant; rejected ends in the last reply
    of the conversation beside it instead (even and odd ids stand side by side), or without a reply
    where that has none. Conversations without a reply give no pair.
    """
    whole = gather_turns(turns.where("conv_id IS NOT NULL"))
    replies = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == ASSISTANT)
    whole = whole.withColumn("last", F.array_max(replies)).where("last IS NOT NULL")
    beside = whole.select(F.expr("conv_id ^ 1").alias("conv_id"), F.slice("turns", F.col("last") + 1, 1).alias("reply"))
    pairs = whole.join(beside, "conv_id", "left")
    instead = F.concat(F.slice("turns", F.lit(1), F.col("last")), F.coalesce("reply", F.array().cast(_TURNS)))
    return pairs.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), instead.alias("rejected"))


ORACLE_SQL = """
WITH whole AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), ended AS (
    SELECT *, list_max([i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant']) AS last FROM whole
), sides AS (
    SELECT a.conv_id, a.turns[1:a.last] AS chosen,
           list_concat(a.turns[1:a.last - 1], coalesce(b.turns[b.last:b.last], [])) AS rejected
    FROM ended a LEFT JOIN (SELECT * FROM ended WHERE last IS NOT NULL) b ON b.conv_id = xor(a.conv_id, 1) WHERE a.last IS NOT NULL
), split AS (
    SELECT *, coalesce(list_min([i for i in range(1, greatest(len(chosen), len(rejected)) + 1)
                                 if chosen[i] IS DISTINCT FROM rejected[i]]) - 1, len(chosen)) AS n FROM sides
), parts AS (
    SELECT conv_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM split
), pieces AS (
    SELECT conv_id, n,
           [['<|' || t.role || '|>' || chr(10), replace(t.text, '<|', '< |') || '<|end|>', t.role] for t in p] AS p,
           [['<|' || t.role || '|>' || chr(10), replace(t.text, '<|', '< |') || '<|end|>', t.role] for t in c] AS c,
           [['<|' || t.role || '|>' || chr(10), replace(t.text, '<|', '< |') || '<|end|>', t.role] for t in r] AS r
    FROM parts
)
SELECT conv_id AS pair_id, n AS n_prompt,
       array_to_string([x[1] || x[2] || chr(10) for x in p], '') AS prompt,
       array_to_string([x[1] || x[2] || chr(10) for x in c], '') AS chosen,
       array_to_string([(coalesce(list_sum([length(y[1]) + length(y[2]) + 1 for y in c[1:i - 1]]), 0)::BIGINT + length(c[i][1])) || ':'
                        || (coalesce(list_sum([length(y[1]) + length(y[2]) + 1 for y in c[1:i - 1]]), 0)::BIGINT + length(c[i][1]) + length(c[i][2]))
                        for i in range(1, len(c) + 1) if c[i][3] = 'assistant'], ',') AS chosen_mask,
       array_to_string([x[1] || x[2] || chr(10) for x in r], '') AS rejected,
       array_to_string([(coalesce(list_sum([length(y[1]) + length(y[2]) + 1 for y in r[1:i - 1]]), 0)::BIGINT + length(r[i][1])) || ':'
                        || (coalesce(list_sum([length(y[1]) + length(y[2]) + 1 for y in r[1:i - 1]]), 0)::BIGINT + length(r[i][1]) + length(r[i][2]))
                        for i in range(1, len(r) + 1) if r[i][3] = 'assistant'], ',') AS rejected_mask
FROM pieces
"""
