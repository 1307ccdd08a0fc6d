"""Preference pairs for training, in DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; the turns
after it are the two completions, each with the spans of characters that a loss may use (the texts of the assistant's
turns; roles and other turns' texts are masked).  Marks of the template inside a text are broken up, so that no text
can pose as a turn.

Turns are ordered by turn, then role, then text; turns that are equal in all three count each.  Null roles and texts
count as empty.  Rows without a conv_id belong to no conversation.  Equal conversations give empty completions and
``usable`` false.  Conversations of any number of turns are rendered whole; empty tables give no pairs; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_next

LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, turns an array of struct<role, text> in order."""
    rows = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    return rows.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _text(turn: Column) -> Column:
    return F.replace(turn["text"], F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _text(t), F.lit("<|end|>\n"))), "")


def spans(turns: Column) -> Column:
    """array<struct<begin, end>> of the learned texts' characters in render(turns), ends excluded; one pass with a running sum."""
    kind = "struct<at: int, marks: array<struct<begin: int, end: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("marks")).cast(kind)

    def add(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(_head(t))
        end = begin + F.length(_text(t))
        mark = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 8).alias("at"), F.when(t["role"] == LEARNED, F.concat(seen["marks"], mark)).otherwise(seen["marks"]).alias("marks")).cast(kind)  # 8: the closing mark and line end

    return F.aggregate(turns, start, add)["marks"]


def preference_pairs(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns, common_turns, prompt, completions and their learned spans, from columns chosen and rejected."""
    apart = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b)), True)
    rows = pairs.withColumn("common_turns", F.when(apart == 0, F.size("chosen").cast("long")).otherwise(apart - 1))
    after = lambda c: F.slice(c, F.col("common_turns").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumn("_c", after("chosen")).withColumn("_r", after("rejected"))
    return rows.select(*keep, "common_turns", render(F.slice("chosen", F.lit(1), F.col("common_turns").cast("int"))).alias("prompt"), render(F.col("_c")).alias("chosen_completion"), render(F.col("_r")).alias("rejected_completion"), spans(F.col("_c")).alias("chosen_spans"), spans(F.col("_r")).alias("rejected_spans"), ((F.size("_c") > 0) | (F.size("_r") > 0)).alias("usable"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen as it stands; rejected up to its last reply, which is that of the next conversation.

    (chosen_id, rejected_id, chosen, rejected); conversations without a reply have no pair, the last is followed by the first.
    """
    rows = conversations(turns).where(F.exists("turns", lambda t: t["role"] == LEARNED))
    last = F.aggregate(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED, i).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("_last", last + 1).withColumn("reply", F.element_at("turns", F.col("_last"))["text"])
    rows = with_next(rows.withColumn("conv_id", F.col("conv_id").cast("long")), [F.col("conv_id")], ["conv_id", "reply"])
    wrong = F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("next_reply").alias("text")))
    return rows.select(F.col("conv_id").alias("chosen_id"), F.col("next_conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_last") - 1), wrong).alias("rejected"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = preference_pairs(pairs, ["chosen_id", "rejected_id"])
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rows.withColumn("chosen_spans", flat("chosen_spans")).withColumn("rejected_spans", flat("rejected_spans"))


OP10_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
l as (select conv_id, max(i) as last, max_by(text, i) as reply from t where role = 'assistant' group by conv_id),
n as (select *, coalesce(lead(conv_id) over w, first_value(conv_id) over w) as next_id, coalesce(lead(reply) over w, first_value(reply) over w) as next_reply from l window w as (order by conv_id)),
r as (select t.conv_id, i, role, case when i = last then next_reply else text end as text from t join n using (conv_id) where i <= last),
c as (select t.conv_id, i, role, text from t join n using (conv_id)),
d as (select conv_id, coalesce(min(i) filter (where c.text is distinct from r.text or c.role is distinct from r.role), max(i) + 1) - 1 as common from c full join r using (conv_id, i) group by conv_id),
b as (select 'c' as side, * from c union all select 'r', * from r),
h as (select b.*, common, '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) as head, replace(text, '<|', '< |') as body from b join d using (conv_id)),
o as (select *, head || body || '<|end|>' || chr(10) as whole, i > common as after from h),
q as (select *, sum(length(whole)) over (partition by side, conv_id, after order by i) - length(whole) as pos from o),
g as (select side, conv_id, after, string_agg(whole, '' order by i) as whole, string_agg(cast(pos + length(head) as bigint) || '-' || cast(pos + length(head) + length(body) as bigint), ',' order by i) filter (where role = 'assistant') as marks from q group by all)
select n.conv_id as chosen_id, next_id as rejected_id, cast(common as bigint) as common_turns, coalesce(p.whole, '') as prompt, coalesce(x.whole, '') as chosen_completion, coalesce(y.whole, '') as rejected_completion,
 coalesce(x.marks, '') as chosen_spans, coalesce(y.marks, '') as rejected_spans, (x.whole is not null or y.whole is not null) as usable
from n join d using (conv_id) left join g p on p.conv_id = n.conv_id and p.side = 'c' and not p.after
left join g x on x.conv_id = n.conv_id and x.side = 'c' and x.after left join g y on y.conv_id = n.conv_id and y.side = 'r' and y.after
"""
