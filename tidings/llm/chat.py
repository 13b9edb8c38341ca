"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes an example of its own: all turns before it are
context, and its reply alone is trainable.  What follows the last reply (or a
conversation without one) is kept as an example with nothing trainable, so the
turns can be read back whole.

Template, for each turn: ``<|im_start|>`` role, line feed, text,
``<|im_end|>``, line feed.  In roles and texts a backslash, ``<`` and ``[`` are
written as two-character codes (in roles a line feed too), so no control string
of this or another bracketed template can appear in them, and the codes are
turned back without loss.

Scale: one shuffle by conversation.  A conversation's turns must meet (its
digest is asked for as one string); the examples are made one at a time from
the formatted turns.

Defined cases: null roles and texts are empty; turns of equal number are
ordered by role and text; repeated rows are separate turns; null conversation
ids form one conversation; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

START, END = "<|im_start|>", "<|im_end|>\n"
CODES = {"\\": "\\e", "<": "\\l", "[": "\\b"}
ROLE_CODES = CODES | {"\n": "\\n"}
TRAINED = "assistant"


def escape(c: Column, codes: dict[str, str]) -> Column:
    for plain, code in codes.items():
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes: dict[str, str]) -> Column:
    """Each backslash starts one code, so the codes can be undone in turn, that
    of the backslash last."""
    for plain, code in reversed(codes.items()):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_examples(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Rows ``(conv_id, example, text, loss_start, loss_length)``: the example's
    formatted text, and the code points of it that are trainable."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], ROLE_CODES), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"], CODES), F.lit(END)))
    each = turns.select("conv_id", F.size("turns").alias("n"), pieces.alias("pieces"), F.posexplode("turns").alias("at", "turn"))
    target = F.col("turn")["role"] == trained
    each = each.where(target | (F.col("at") == F.col("n") - 1))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    opening = F.concat(before, head(F.col("turn")))
    reply = escape(F.col("turn")["text"], CODES)
    made = each.select("conv_id", F.col("at").alias("example"), target.alias("trainable"), opening.alias("opening"), reply.alias("reply"))
    return made.select("conv_id", "example", F.concat("opening", "reply", F.lit(END)).alias("text"), F.length("opening").alias("loss_start"), F.when(F.col("trainable"), F.length("reply")).otherwise(0).alias("loss_length"))


def parse_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda x: x != "")
    bodies = F.transform(parts, lambda x: F.substr(x, F.lit(len(START) + 1)))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(bodies, lambda x: F.struct(unescape(role(x), ROLE_CODES).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2), CODES).alias("text")))


def trained_text(example_text: Column, start: Column, length: Column) -> Column:
    return unescape(F.substr(example_text, start + 1, length), CODES)


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted examples."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    examples = format_examples(read_table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra))
    reply = trained_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"), F.sum(F.length("text")).alias("formatted_chars"))
    read = whole.select("conv_id", "formatted_chars", parse_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(12 + length(regexp_replace(role, '[\\<\[\n]', 'xx', 'g')) + 1
        + length(regexp_replace(text, '[\\<\[]', 'xx', 'g')) + 11)
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
