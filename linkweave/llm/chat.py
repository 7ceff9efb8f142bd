"""Preference formatting: the shared turns of a chosen and a rejected conversation, once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS = ("prompt", "chosen", "rejected")


def rendered(role: str | Column, text: str | Column) -> Column:
    """A turn as a training text has it."""
    as_col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit("<|"), as_col(role), F.lit("|>\n"), as_col(text), F.lit("<|end|>\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    """(pair, turn, body): one row for each turn number, with a null conv_id or turn left out.

    Rows that repeat are one; different rows under one turn number stand in order of role and text.
    """
    rows = conversations.where("conv_id is not null and turn is not null")
    rows = rows.select(F.col("conv_id").alias("pair"), F.col("turn").cast("long").alias("turn"), rendered("role", "text").alias("body")).distinct()
    return rows.groupBy("pair", "turn").agg(F.array_join(F.array_sort(F.collect_list("body")), "").alias("body"))


def borrowed_replies(turns: DataFrame) -> DataFrame:
    """Rejected conversations for data without any, from (pair, turn, body) with whole numbers as pairs.

    Each follows its conversation up to a turn that the pair's number picks among all its turns, has there the neighbour's turn of the
    same number (neighbour: the number with its last bit flipped), and ends. Without a
    neighbour, or such a turn of it, nothing stands there: an empty completion.
    """
    ends = written(turns.groupBy("pair").agg(F.min("turn").alias("lo"), (F.max("turn") - F.min("turn") + 1).alias("n")), "ends")
    branch = ends.select("pair", (F.col("lo") + F.pmod(F.col("pair"), F.col("n"))).alias("branch"))
    followed = turns.join(branch, "pair").where(F.col("turn") < F.col("branch")).select("pair", "turn", "body")
    reply = turns.select(F.col("pair").bitwiseXOR(F.lit(1)).alias("pair"), "turn", "body").join(branch, "pair").where(F.col("turn") == F.col("branch"))
    return followed.unionByName(reply.select("pair", "turn", "body"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, part, turn, body, trained): the turns of each pair, in three parts.

    ``chosen`` and ``rejected`` are (pair, turn, body). ``prompt`` has the longest common
    prefix of turns once, masked; the parts ``chosen`` and ``rejected`` have the turns after
    it, trained on. Turns meet by pair and number, so that no conversation is gathered in one row or task,
    however long; the prefix ends at the first number at which the two differ or one has no turn.
    """
    both = written(chosen.select("pair", "turn", "body").join(rejected.select("pair", "turn", F.col("body").alias("other")), ["pair", "turn"], "full"), "pair-turns")
    split = written(both.where(~F.col("body").eqNullSafe(F.col("other"))).groupBy("pair").agg(F.min("turn").alias("split")), "splits")
    placed = both.join(split, "pair", "left")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    part = lambda name, body, trained: F.struct(F.lit(name).alias("part"), F.col(body).alias("body"), F.lit(trained).alias("trained"))
    parts = F.when(shared, F.array(part("prompt", "body", False))).otherwise(F.array(part("chosen", "body", True), part("rejected", "other", True)))
    return placed.select("pair", "turn", F.explode(parts).alias("p")).where("p.body is not null").select("pair", "p.part", "turn", "p.body", "p.trained")


def _formatted(segments: DataFrame) -> DataFrame:
    turns = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "body"))))
    text = lambda name: F.array_join(F.transform(turns(name), lambda x: x["body"]), "").alias(name)
    count = lambda name: F.count_if(F.col("part") == name).alias(f"{name}_turns")
    return segments.groupBy("pair").agg(*[text(p) for p in PARTS], *[count(p) for p in PARTS])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, prompt, chosen, rejected, and the turns of each): one row for each pair, with the texts in order of turns.

    ``chosen`` and ``rejected`` are conversations (conv_id, turn, role, text) that share
    conv_id, of any type; other columns are not read. A completion is empty where its conversation ends with the prompt.
    Null roles and texts count as empty, rows that repeat as one, and an empty table gives no rows. The mask of prompt +
    completion is two spans: the prompt untrained, the completion trained. A pair is one training
    example and has to fit in a row; :func:`preference_segments` gives the turns of pairs that don't.
    """
    return _formatted(preference_segments(written(_turns(chosen), "turns"), written(_turns(rejected), "turns")))


def op7_preferences(conversations: DataFrame) -> DataFrame:
    """Every conversation against one with a borrowed reply: the prompt once, both completions, and their masks (start:end:trained)."""
    numbered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = written(_turns(numbered), "turns")
    pairs = _formatted(preference_segments(turns, borrowed_replies(turns)))
    end = F.length("prompt")
    mask = lambda p: F.concat_ws(",", F.concat_ws(":", F.lit("0"), end, F.lit("0")), F.concat_ws(":", end, end + F.length(p), F.lit("1"))).alias(f"{p}_mask")
    return pairs.select(F.col("pair").alias("conv_id"), *PARTS, *[f"{p}_turns" for p in PARTS], mask("chosen"), mask("rejected"))


OP7_SQL = """
with r as (select distinct conv_id as pair, turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as body
           from conversations where conv_id is not null and turn is not null),
t as (select pair, turn, string_agg(body, '' order by encode(body)) as body from r group by all),
n as (select pair, min(turn) as lo, max(turn) - min(turn) + 1 as n from t group by pair),
l as (select pair, lo + ((pair % n) + n) % n as branch from n),
w as (select pair, turn, body from t join l using (pair) where turn < branch
      union all select l.pair, t.turn, t.body from l join t on t.pair = xor(l.pair, 1) and t.turn = l.branch),
f as (select pair, turn, t.body, w.body as other from t full join w using (pair, turn)),
s as (select pair, min(turn) filter (body is distinct from other) as split from f group by all),
g as (select pair, 'prompt' as part, turn, body from f join s using (pair) where split is null or turn < split
      union all select pair, 'chosen', turn, body from f join s using (pair) where turn >= split and body is not null
      union all select pair, 'rejected', turn, other from f join s using (pair) where turn >= split and other is not null),
c as (select pair, coalesce(string_agg(body, '' order by turn) filter (part = 'prompt'), '') as prompt,
        coalesce(string_agg(body, '' order by turn) filter (part = 'chosen'), '') as chosen,
        coalesce(string_agg(body, '' order by turn) filter (part = 'rejected'), '') as rejected,
        count(*) filter (part = 'prompt') as prompt_turns, count(*) filter (part = 'chosen') as chosen_turns,
        count(*) filter (part = 'rejected') as rejected_turns from g group by all)
select pair as conv_id, prompt, chosen, rejected, prompt_turns, chosen_turns, rejected_turns,
  '0:' || length(prompt) || ':0,' || length(prompt) || ':' || (length(prompt) + length(chosen)) || ':1' as chosen_mask,
  '0:' || length(prompt) || ':0,' || length(prompt) || ':' || (length(prompt) + length(rejected)) || ':1' as rejected_mask from c"""
