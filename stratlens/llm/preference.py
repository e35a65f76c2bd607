"""Preference formatting: one prompt, two masked completions.

Of a chosen and a rejected conversation the longest common prefix of turns (equal role and text) is
rendered once as the prompt; what follows in either is its completion.  A completion comes with the
character ranges to learn from, the texts of assistant turns with their end marks; all else is masked.

Defined results: a null role reads ``user`` and a null text is empty; equal conversations have
empty completions; a null or empty conversation has an empty completion and the prompt is empty;
prompts never take more than the shorter conversation.  Rows are kept one to one, with null or repeated
ids.  Extra columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

RESULTS = ("n_prompt_turns", "prompt", "chosen_completion", "chosen_learn", "rejected_completion", "rejected_learn")
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def _turns(c) -> F.Column:
    return F.transform(
        F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )


def _head(t):
    return F.concat(F.lit(OPEN), t["role"], F.lit(SHUT))


def _render(turns) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _ranges(turns) -> F.Column:
    """Character ranges [begin, stop) of the assistant's texts in the rendered turns."""
    spec = "struct<at:int,out:array<struct<begin:int,stop:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int>>").alias("out")).cast(spec)

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        stop = begin + F.length(t["text"]) + len(END)
        one = F.array(F.struct(begin.alias("begin"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")).cast(spec)

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def prefer(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replaces the two turn lists by prompt, n_prompt_turns, and text and learn ranges of either completion."""
    keep = [c for c in pairs.columns if c.lower() not in (chosen.lower(), rejected.lower(), *RESULTS)]
    both, at = fresh("turns", keep), fresh("at", keep)
    rows = pairs.select(*keep, F.explode(F.array(F.struct(_turns(chosen).alias("a"), _turns(rejected).alias("b")))).alias(both))
    turns = {k: F.col(both)[k] for k in "ab"}
    same = F.zip_with(turns["a"], turns["b"], lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.least(F.size(turns["a"]), F.size(turns["b"]))).cast("int")
    rows = rows.select(*keep, both, F.explode(F.array(n)).alias(at))
    rest = {k: F.slice(t, F.col(at) + 1, F.greatest(F.size(t) - F.col(at), F.lit(0))) for k, t in turns.items()}
    return rows.select(
        *keep, F.col(at).alias("n_prompt_turns"), _render(F.slice(turns["a"], F.lit(1), F.col(at))).alias("prompt"),
        _render(rest["a"]).alias("chosen_completion"), _ranges(rest["a"]).alias("chosen_learn"), _render(rest["b"]).alias("rejected_completion"), _ranges(rest["b"]).alias("rejected_learn"),
    )


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in their order; a conversation is one example and one row."""
    rows = df.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbour_pairs(df: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation, and its first half continued by the second half
    of the conversation with the next id (its own, if there is none)."""
    conv = conversations(df)
    other = conv.select(F.try_subtract("conv_id", F.lit(1)).alias("conv_id"), F.col("turns").alias("other"))
    half = F.ceil(F.size("turns") / 2).cast("int")
    late = F.coalesce("other", "turns")
    at = F.ceil(F.size(late) / 2).cast("int")
    return conv.join(other, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), half), F.slice(late, at + 1, F.size(late))).alias("rejected"))


def digest(df: DataFrame) -> DataFrame:
    """conv_id, n_prompt_turns and the rendered texts; learn ranges as text, such as 14-90,120-300."""
    out = prefer(neighbour_pairs(df))

    def flat(c):
        return F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["begin"].cast("string"), r["stop"].cast("string"))), ",")

    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", flat("chosen_learn").alias("chosen_learn"), flat("rejected_learn").alias("rejected_learn"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, n, CAST(ceil(n / 2.0) AS INT) AS half FROM t),
src AS (SELECT c.conv_id, c.half, coalesce(o.conv_id, c.conv_id) AS other, coalesce(o.half, c.half) AS ohalf FROM c LEFT JOIN c o ON o.conv_id = c.conv_id + 1),
rej AS (SELECT s.conv_id, t.pos, t.role, t.text FROM src s JOIN t ON t.conv_id = s.conv_id AND t.pos <= s.half
  UNION ALL SELECT s.conv_id, s.half + t.pos - s.ohalf, t.role, t.text FROM src s JOIN t ON t.conv_id = s.other AND t.pos > s.ohalf),
cho AS (SELECT conv_id, pos, role, text FROM t),
paired AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, coalesce(a.role = b.role AND a.text = b.text, false) AS same FROM cho a FULL JOIN rej b ON a.conv_id = b.conv_id AND a.pos = b.pos),
lcp AS (SELECT conv_id, CAST(coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS INT) AS n FROM paired GROUP BY conv_id),
parts AS (SELECT l.conv_id, l.n, x.side, x.pos, x.role, x.text, '<|' || x.role || '|>' || chr(10) AS head, '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) AS body
  FROM lcp l JOIN (SELECT 'c' AS side, * FROM cho UNION ALL SELECT 'r' AS side, * FROM rej) x ON x.conv_id = l.conv_id),
spans AS (SELECT conv_id, side, pos, role, sum(length(body)) OVER (PARTITION BY conv_id, side ORDER BY pos) - length(body) + length(head) AS b, sum(length(body)) OVER (PARTITION BY conv_id, side ORDER BY pos) AS e FROM parts WHERE pos > n)
SELECT l.conv_id, l.n AS n_prompt_turns,
  coalesce((SELECT string_agg(body, '' ORDER BY pos) FROM parts p WHERE p.conv_id = l.conv_id AND side = 'c' AND pos <= l.n), '') AS prompt,
  coalesce((SELECT string_agg(body, '' ORDER BY pos) FROM parts p WHERE p.conv_id = l.conv_id AND side = 'c' AND pos > l.n), '') AS chosen_completion,
  coalesce((SELECT string_agg(body, '' ORDER BY pos) FROM parts p WHERE p.conv_id = l.conv_id AND side = 'r' AND pos > l.n), '') AS rejected_completion,
  coalesce((SELECT string_agg(CAST(b AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY pos) FROM spans p WHERE p.conv_id = l.conv_id AND side = 'c' AND role = 'assistant'), '') AS chosen_learn,
  coalesce((SELECT string_agg(CAST(b AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY pos) FROM spans p WHERE p.conv_id = l.conv_id AND side = 'r' AND role = 'assistant'), '') AS rejected_learn
FROM lcp l
"""
