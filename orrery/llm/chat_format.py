"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, which
alone is trainable. A conversation that doesn't end with an assistant turn gets one more example with all
its turns and an empty loss mask, so that no turn is lost.

Template of a turn: `<|turn|>` role newline text `<|end|>`. In roles and texts `&` is written `&amp;` and
`<` is written `&lt;` (and a newline in a role `&#10;`), so a control string cannot occur in them; the
inverse replacements in the opposite order give the text back. The loss mask is a span in code points.

Defined results: null roles and texts count as empty; turns go by (turn, role, text), null turn numbers
first; repeated rows are turns like any other; rows with a null conv_id form one conversation; an empty
table gives no example; other columns of the input are ignored. Long conversations: examples grow with the
square of their turns, as the expansion demands, but each is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"


def _swap(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    return _swap(_swap(c, "&", "&amp;"), "<", "&lt;")


def unescape(c: Column) -> Column:
    return _swap(_swap(_swap(c, "&#10;", "\n"), "&lt;", "<"), "&amp;", "&")


def expand_targets(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, target int (place of the last turn in the example, from 0),
    is_last boolean (the conversation's longest example), formatted, loss_start int, loss_length int."""
    empty = F.lit("")
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("x"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    head = lambda x: F.concat(F.lit(TURN), _swap(escape(x["role"]), "\n", "&#10;"), F.lit("\n"))
    parts = F.transform("x", lambda x: F.struct((x["role"] == target_role).alias("target"), head(x).alias("head"), escape(x["text"]).alias("body")))
    convs = convs.select("conv_id", parts.alias("x"))
    convs = convs.withColumn("segments", F.transform("x", lambda x: F.concat(x["head"], x["body"], F.lit(END))))
    n = F.size("x")
    wanted = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("x", i + 1)["target"] | (i == n - 1))
    each = convs.select("conv_id", "x", "segments", F.explode(wanted).alias("target"))
    own = F.element_at("x", F.col("target") + 1)
    context = F.array_join(F.slice("segments", F.lit(1), F.col("target")), "")
    each = each.select("conv_id", "target", (F.col("target") == n - 1).alias("is_last"), own.alias("own"), context.alias("context"))
    reply = F.when(F.col("own.target"), F.length("own.body")).otherwise(0)
    return each.select("conv_id", "target", "is_last", F.concat("context", "own.head", "own.body", F.lit(END)).alias("formatted"), (F.length("context") + F.length("own.head")).alias("loss_start"), reply.alias("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say, by conversation: its turns from the longest one, its trainable text from all."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.concat(unescape(role), F.lit("\n"), unescape(body), F.lit("\n"))

    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    rows = examples.select(
        "conv_id",
        F.when(F.col("is_last"), F.size(pieces)).cast("long").alias("n"),
        F.when(F.col("is_last"), F.sha2(F.array_join(F.transform(pieces, turn), ""), 256)).alias("sha"),
        F.struct("target", loss.alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "")
    out = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), text.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return read_back(expand_targets(rows.unionByName(more)))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
        + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(prefix) FILTER (role = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
