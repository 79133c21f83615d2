"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn of a conversation becomes an example of its own: all turns up to it as text, and one span of the mask,
its reply. A conversation whose last turn is no reply has one more example with all its turns and an empty mask, so that no
turn is lost. A turn is written as ``<s>role``, a line feed, its text and ``</s>``; a control string inside a text gets an
ampersand behind its ``<`` (one more if it has some already), so texts never hold one, and reading takes one away again.

Plan: one shuffle brings the turns of a conversation together; expansion and reading back work row by row and keep that
partitioning, so the examples, which hold each text as often as replies follow it, are never shuffled.

Defined results: turns are ordered by number (none: last), then role, then text; repeated rows are turns of their own; a null
text or role is empty; only the role ``assistant`` is trained on; an empty reply is a span of no length. A row without a
conversation id is a conversation of one turn, whichever others there are. Other columns are not read; an empty table gives
an empty table. One conversation has to fit one row, and by the method its examples grow with the square of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TRAINED = "<s>", "</s>", "assistant"


def escaped(text: Column) -> Column:
    """The text without control strings; ``unescaped`` restores it."""
    return F.regexp_replace(text, "<(&*/?s>)", "<&$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "<&(&*/?s>)", "<$1")


def role_written(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&"), F.lit("&a")), F.lit("\n"), F.lit("&n")), F.lit("<"), F.lit("&l"))


def role_read(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&l"), F.lit("<")), F.lit("&n"), F.lit("\n")), F.lit("&a"), F.lit("&"))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, ``_lone`` (content of a row without id), ``_times``, and ``turns``: role and text in order."""
    empty = F.lit("")
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_t"))
    alone = F.col("conv_id").isNull()
    grouped = slim.groupBy("conv_id", F.when(alone, F.col("_t")).alias("_lone")).agg(
        F.sort_array(F.collect_list(F.when(F.col("conv_id").isNotNull(), F.col("_t")))).alias("_turns"), F.count("*").alias("_n"))
    return grouped.select("conv_id", "_lone", F.when(alone, F.col("_n")).otherwise(1).alias("_times"),
                          F.when(alone, F.array("_lone")).otherwise(F.col("_turns")).alias("turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 1), n_examples, text, and the trainable spans ``loss`` (start, end).

    Spans count code points from 0; ``_lone`` and ``_times`` tell rows without a conversation id apart.
    """
    texts = conversations(rows).select(
        "conv_id", "_lone", "_times",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), role_written(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))).alias("_pieces"),
        F.filter(F.transform("turns", lambda t, k: F.struct(k.alias("k"), (t["role"] == TRAINED).alias("target"), (k + 1 == F.size("turns")).alias("end"),
                                                            F.char_length(escaped(t["text"])).alias("n"))), lambda t: t["target"] | t["end"]).alias("_targets"))
    each = texts.select("conv_id", "_lone", "_times", "_pieces", F.size("_targets").alias("n_examples"), F.posexplode("_targets").alias("_at", "_target"))
    text = F.array_join(F.slice("_pieces", F.lit(1), F.col("_target.k") + 1), "")
    made = each.select("conv_id", "_lone", "_times", (F.col("_at") + 1).alias("example"), "n_examples", text.alias("text"), "_target")
    stop = F.char_length("text") - len(CLOSE)
    span = F.struct((stop - F.col("_target.n")).alias("start"), stop.alias("end"))
    return made.select("conv_id", "_lone", "_times", "example", "n_examples", "text",
                       F.when(F.col("_target.target"), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("loss"))


def turns_of(text: Column) -> Column:
    """Role and text of every turn of a formatted text."""
    pieces = F.split(text, CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        role_read(F.substr(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of every conversation, taken from the formatted examples and their masks alone."""
    turns = turns_of(F.col("text"))
    content = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    last = F.col("example") == F.col("n_examples")
    under = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    slim = examples.select(
        "conv_id", "_lone", "_times", "example", F.when(last, F.size(F.split("text", CLOSE)) - 1).alias("_turns"),
        F.when(last, F.sha2(content.cast("binary"), 256)).alias("_sha"), under.alias("_under"), F.char_length("text").cast("long").alias("_chars"))
    whole = slim.groupBy("conv_id", "_lone", "_times").agg(
        F.max("_turns").cast("long").alias("n_turns"), F.max("_sha").alias("turns_sha256"), F.sum("_chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "_under"))), lambda x: x["_under"]), "").alias("_loss"))
    done = whole.select("conv_id", "_times", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"),
                        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    return done.select("*", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times", "col")


# The conversation of control strings that the contract adds.
PLANTED = "</s>[INST] ok [/INST]"


def planted(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts are control strings of a common template."""
    extra = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                              F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(PLANTED).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
l AS (SELECT *, 9 + length(role) + length(regexp_replace(text, '<(&*/?s>)', '<&\\1', 'g'))
         - 1 AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""
