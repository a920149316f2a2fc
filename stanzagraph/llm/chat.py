"""Preference pairs as prompts and masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzagraph.llm.common import pick

#: How a turn is rendered; the loss covers an assistant's text and END.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
FIRST = -(2**63)
TURNS = "array<struct<at:bigint,role:string,text:string>>"


def rendered(turns: Column) -> Column:
    """Text of an array of (at, role, text)."""
    each = lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))
    return F.array_join(F.transform(turns, each), "")


def loss_mask(turns: Column) -> Column:
    """The rendered turns' characters as runs without and with loss: 'skip+keep' for each turn, comma-separated.

    An assistant's text and END carry loss; all else is skipped. Runs are local to their
    turn, so a long completion costs no more a turn than a short one.
    """
    head = lambda t: F.length(t["role"]) + F.lit(len(START) + len(MIDDLE))
    rest = lambda t: F.length(t["text"]) + F.lit(len(END))
    run = lambda t: F.when(t["role"] == "assistant", F.concat(head(t).cast("string"), F.lit("+"), rest(t).cast("string"))).otherwise(F.concat((head(t) + rest(t)).cast("string"), F.lit("+0")))
    return F.array_join(F.transform(turns, run), ",")


def turn(at: Column, role: Column, text: Column) -> Column:
    """A turn as TURNS hold it: null numbers come first, null roles and texts are empty."""
    return F.struct(F.coalesce(at.cast("long"), F.lit(FIRST)).alias("at"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of rows (pair_id, chosen, rejected), both sorted TURNS.

    The prompt is the longest prefix of turns that both sides share, rendered once.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    parted = F.array_position(same, False)
    cut = pairs.withColumn("common", F.when(parted == 0, F.size("chosen")).otherwise(parted - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("common") + 1, F.greatest(F.size(c) - F.col("common"), F.lit(0)))
    parts = cut.select("pair_id", F.slice("chosen", 1, F.col("common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select("pair_id", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), loss_mask(F.col("c")).alias("chosen_loss"), rendered(F.col("r")).alias("rejected"), loss_mask(F.col("r")).alias("rejected_loss"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn_no: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Render the turns that chosen and rejected share from the start once, and the rest as a pair.

    Both tables have one row a turn. Returns one row for each pair: pair_id, prompt, chosen,
    chosen_loss, rejected, rejected_loss. The prompt is the longest common prefix of turns
    (same number, role and text); the loss columns list the runs of the completions'
    characters without and with loss (see loss_mask).

    Turns are gathered by pair in one exchange; each map task sends one row a pair, so a
    pair with very many turns arrives as few rows. Its result row holds all its texts, so
    memory follows the longest conversation.

    Null turn numbers come first; null roles and texts count and render as empty. Ties in
    the number are ordered by role, then text; repeated rows are repeated turns. Null
    pair_ids are one pair. A side without turns: an empty completion, and no prompt.
    Identical sides: prompt only. Empty tables: no rows. Extra columns are ignored.
    """
    sides = []
    for df, side in ((chosen, "chosen"), (rejected, "rejected")):
        own = pick(df, pair_id=pair, turn=turn_no, role=role, text=text)
        sides.append(own.select("pair_id", F.lit(side).alias("side"), turn(F.col("turn"), F.col("role"), F.col("text")).alias("turn")))
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("turn")))).alias(side)
    return format_pairs(sides[0].unionByName(sides[1]).groupBy("pair_id").agg(of("chosen"), of("rejected")))


def op2_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last reply, against the same with the reply of its neighbour.

    The neighbour of conversation 2k is 2k + 1 and vice versa; where it is missing or has
    no reply, the rejected reply is empty. Conversations without a reply are prompts. Where
    several replies share the last turn's number, each is replaced.
    """
    table = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="conv_id", turn="turn", role="role", text="text")
    all_turns = table.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn(F.col("turn"), F.col("role"), F.col("text")))).alias("turns"))
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    convs = all_turns.withColumn("last", F.try_element_at(replies, F.lit(-1)))
    mates = table.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(turn(F.col("turn"), F.col("role"), F.col("text")))["text"].alias("other"))
    mates = mates.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("mate"), "other")
    both = convs.join(mates, F.col("conv_id") == F.col("mate"), "left")
    last = F.col("last")["at"]
    upto = F.filter("turns", lambda t: last.isNull() | (t["at"] <= last))
    swap = lambda t: F.when((t["at"] == last) & (t["role"] == "assistant"), F.struct(t["at"].alias("at"), t["role"].alias("role"), F.coalesce("other", F.lit("")).alias("text"))).otherwise(t)
    pairs = both.select(F.col("conv_id").alias("pair_id"), upto.alias("chosen"), F.transform(upto, swap).alias("rejected"))
    return format_pairs(pairs)


OP2_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, max(turn) AS last, max_by(text, turn) AS reply FROM t WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT l.conv_id, l.last, coalesce(m.reply, '') AS other FROM l LEFT JOIN l m ON m.conv_id = xor(l.conv_id, 1)),
c AS (
  SELECT t.*, CASE WHEN turn = last AND role = 'assistant' THEN other ELSE text END AS swapped
  FROM t LEFT JOIN e USING (conv_id) WHERE last IS NULL OR turn <= last),
d AS (SELECT conv_id, min(turn) FILTER (WHERE text <> swapped) AS parted FROM c GROUP BY 1),
s AS (
  SELECT conv_id, turn, parted IS NULL OR turn < parted AS common,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS chosen_turn,
         '<|im_start|>' || role || chr(10) || swapped || '<|im_end|>' || chr(10) AS rejected_turn,
         CASE WHEN role = 'assistant' THEN length(role) + 13 ELSE NULL END AS head
  FROM c JOIN d USING (conv_id)),
o AS (
  SELECT *, CASE WHEN head IS NULL THEN length(chosen_turn) || '+0' ELSE head || '+' || (length(chosen_turn) - head) END AS c_run,
         CASE WHEN head IS NULL THEN length(rejected_turn) || '+0' ELSE head || '+' || (length(rejected_turn) - head) END AS r_run
  FROM s)
SELECT conv_id AS pair_id,
       coalesce(string_agg(chosen_turn, '' ORDER BY turn) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(chosen_turn, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS chosen,
       coalesce(string_agg(c_run, ',' ORDER BY turn) FILTER (WHERE NOT common), '') AS chosen_loss,
       coalesce(string_agg(rejected_turn, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS rejected,
       coalesce(string_agg(r_run, ',' ORDER BY turn) FILTER (WHERE NOT common), '') AS rejected_loss
FROM o GROUP BY conv_id
"""
