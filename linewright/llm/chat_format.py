r"""Chat formatting: every assistant turn becomes a training example of its own.

An example holds all turns before the target as context and only the target's
text is trainable. Turns are written as ``<turn>ROLE\nTEXT</turn>\n``. Inside
roles and texts a backslash becomes ``\b``, the ``<`` of a control string
(``<turn`` or ``</turn``) becomes ``\l``, and a line break in a role ``\n``;
both directions are single replacements, so any text comes back unchanged.

All examples of a conversation are prefixes of one formatted string. That string
is built once per conversation; an example is a cut of it, made row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), "<(?=/?turn)", r"\\l")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def prefix_examples(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, target, formatted, loss_start, loss_length)``, places in code points.

    ``target`` is the place of the trained turn in its conversation, from zero.
    A conversation that does not end with an assistant turn gives one more row,
    with its whole text, a null target and nothing to train on, so that no turn
    is lost. Turns go by ``turn``, ties by role and text; repeated rows are
    turns of their own. A null role or text is empty, a null turn comes first,
    rows with a null conversation id form one conversation. Other columns are
    not looked at; an empty table gives no rows.
    """
    written = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    heads = F.transform("said", lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit("\n")))
    bodies = F.transform("said", lambda x: escape(x["text"]))
    talks = talks.select("conv_id", F.transform("said", lambda x: x["role"]).alias("roles"), heads.alias("heads"), bodies.alias("bodies"))
    lengths = F.zip_with("heads", "bodies", lambda h, b: F.length(h) + F.length(b) + len(CLOSE))
    talks = talks.withColumn("lengths", lengths)
    # the running end of each turn, in one pass
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    ends = F.aggregate(
        "lengths",
        empty,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends")),
        lambda acc: acc["ends"],
    )
    talks = talks.withColumn("ends", ends)
    whole = F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    last = F.size("roles") - 1
    spans = F.transform(
        "ends",
        lambda end, i: F.struct(
            F.when(F.get("roles", i) == TRAINED_ROLE, i).alias("target"),
            end.alias("end"),
            F.length(F.get("bodies", i)).cast("long").alias("loss_length"),
            (i == last).alias("last"),
        ),
    )
    spans = F.filter(spans, lambda x: x["target"].isNotNull() | x["last"])
    cuts = talks.select("conv_id", whole.alias("whole"), spans.alias("spans")).select("conv_id", "whole", F.explode("spans").alias("span"))
    trained = F.col("span.target").isNotNull()
    return cuts.select(
        "conv_id",
        "span.target",
        F.col("whole").substr(F.lit(1), F.col("span.end").cast("int")).alias("formatted"),
        F.when(trained, F.col("span.end") - len(CLOSE) - F.col("span.loss_length")).alias("loss_start"),
        F.when(trained, F.col("span.loss_length")).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of ``(role, text)``."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substring(x, len(OPEN) + 1, 2**31 - 1), "\n", 1)).alias("role"),
            unescape(x.substr(F.instr(x, "\n") + 1, F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(formatted.substr((start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from them.

    The sums stay where the examples were made: they are grouped by the key
    that the conversations already are dealt by.
    """
    rows = examples.select(
        "conv_id",
        "formatted",
        F.length("formatted").cast("long").alias("chars"),
        F.when(
            F.col("target").isNotNull(),
            F.struct("target", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")),
        ).alias("loss"),
    )
    talks = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "chars").alias("formatted"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("loss")).alias("losses"),
    )
    talks = talks.select(
        "conv_id",
        "formatted_chars",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts look like markup of this and of other templates.
PROBE = [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(["user", TRAINED_ROLE])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, row)) for row in PROBE]))).toDF(*talks.columns)
    return digest(prefix_examples(talks.union(probe)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '\\', '\\b', 'g'), '<(/?turn)', '\\l\1', 'g'))
      + length(role) - length(replace(role, chr(10), ''))
      + length(regexp_replace(regexp_replace(text, '\\', '\\b', 'g'), '<(/?turn)', '\\l\1', 'g')) + 15 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns
), ends AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS ends_at FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(ends_at) FILTER (role = 'assistant' OR k = n_turns)::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""
