"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt. What follows it in either conversation is a
completion, with the spans of its assistant turns: everything else is masked in training. All of it is column
expressions on one row a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TURNS = "array<struct<role:string,text:string>>"
#: Rows between which a reply is borrowed: conversations are dealt by hash to groups of about this many.
GROUP = 512


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns, from the first, in which role and text agree."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, n.cast("long"))).cast("int")


def completion(turns: Column, after: Column) -> Column:
    """(text, spans): the turns after the prompt, and [start, end) in code points of what assistants say."""
    rest = F.slice(turns, after + 1, F.greatest(F.size(turns) - after, F.lit(0)))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(done, turn):
        head = F.length(done["text"]) + F.length(turn["role"]) + 5
        span = F.struct(head.alias("start"), (head + F.length(turn["text"]) + 1).alias("end"))
        spans = F.when(turn["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(F.concat(done["text"], rendered(turn)).alias("text"), spans.alias("spans"))

    return F.aggregate(rest, start, add)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected), arrays of (role, text): pair_id, prompt_turns, prompt, chosen, chosen_spans,
    rejected, rejected_spans.

    A null conversation is an empty one; null roles and texts are empty. If one conversation is the beginning of the other,
    its completion is empty; equal conversations are all prompt. Spans hold the end of the turn, which is learnt too.
    Repeated pairs are formatted alike; an empty table gives no rows; other columns are ignored.
    """
    whole = lambda c: F.transform(F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    both = pairs.select("pair_id", whole("chosen").alias("a"), whole("rejected").alias("b")).withColumn("prompt_turns", common_turns(F.col("a"), F.col("b")))
    both = both.withColumns({"c": completion(F.col("a"), F.col("prompt_turns")), "r": completion(F.col("b"), F.col("prompt_turns"))})
    prompt = F.array_join(F.transform(F.slice("a", F.lit(1), F.col("prompt_turns")), rendered), "")
    return both.select("pair_id", "prompt_turns", prompt.alias("prompt"), F.col("c.text").alias("chosen"), F.col("c.spans").alias("chosen_spans"), F.col("r.text").alias("rejected"), F.col("r.spans").alias("rejected_spans"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): turns by number, then role and text; a null number comes first."""
    one = F.struct(F.col("turn").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def borrowed_pairs(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """(pair_id, chosen, rejected) from conversations without judgements.

    Chosen is a conversation up to its last assistant turn; rejected is the same with the last assistant turn of the next
    conversation, by conv_id, of its group that ends in other words; after the last of a group comes the first. Conversations
    without an assistant turn give no pair, nor do those of a group that all end in the same words. Turns without a
    conv_id belong to no conversation.
    """
    turns = turns.filter("conv_id IS NOT NULL")
    whole = conversations(turns)
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.when(F.element_at("turns", i)["role"] == "assistant", i)))
    cut = whole.withColumn("last", last).filter("last IS NOT NULL").select("conv_id", F.slice("turns", F.lit(1), F.col("last") - 1).alias("before"), F.element_at("turns", F.col("last")).alias("reply"))
    deal = F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8)
    groups = common.blocks_for(turns.select("conv_id").distinct().count(), group)
    cut = cut.withColumn("deal", F.pmod(F.conv(deal, 16, 10).cast("long"), F.lit(groups)))
    back = Window.partitionBy("deal").orderBy(F.desc("conv_id"))
    # From the end: the reply after each conversation, where it is another one, and the last such reply seen so far.
    cut = cut.withColumn("after", F.lag("reply").over(back)).withColumn("turned", F.when(F.col("after") != F.col("reply"), F.col("after")))
    cut = cut.withColumn("other", F.last("turned", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = Window.partitionBy("deal").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, second = F.first("reply").over(start), F.first("other").over(start)  # how the group begins, and what comes next there
    cut = cut.withColumn("other", F.coalesce("other", F.when(first != F.col("reply"), first), second)).filter("other IS NOT NULL")
    return cut.select(F.col("conv_id").alias("pair_id"), F.concat("before", F.array("reply")).alias("chosen"), F.concat("before", F.array("other")).alias("rejected"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text, ``start:end`` by commas."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    out = format_preferences(borrowed_pairs(common.read(spark, sf_dir, "conversations")))
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", written("chosen_spans"), "rejected", written("rejected_spans"))


#: Both sides agree up to the borrowed reply, so the common prefix is what comes before it.
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, list({{'n': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max([CASE WHEN turns[i].role = 'assistant' THEN i END FOR i IN range(1, len(turns) + 1)]) AS last FROM c),
d AS (SELECT conv_id, turns[1:last - 1] AS before, turns[last].text AS reply, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {GROUP}))::BIGINT FROM c) AS deal FROM l WHERE last IS NOT NULL),
e AS (SELECT a.conv_id, arg_min(b.reply, (b.conv_id <= a.conv_id, b.conv_id)) AS other FROM d a JOIN d b ON a.deal = b.deal AND a.reply <> b.reply GROUP BY a.conv_id)
SELECT conv_id AS pair_id, len(before)::INT AS prompt_turns, coalesce(array_to_string(['<|' || t.role || '|>' || chr(10) || t.text || chr(10) FOR t IN before], ''), '') AS prompt,
'<|assistant|>' || chr(10) || reply || chr(10) AS chosen, '14:' || (15 + length(reply)) AS chosen_spans, '<|assistant|>' || chr(10) || other || chr(10) AS rejected, '14:' || (15 + length(other)) AS rejected_spans
FROM d JOIN e USING (conv_id)
"""
