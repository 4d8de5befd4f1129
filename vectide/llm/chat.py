"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and its text
alone is under the loss mask, given as a range of code points. Turns after the last assistant
turn close the conversation in an example without a target, so no turn is lost. A turn reads

    ### role</role>\\ntext</turn>\\n

and in roles and texts a backslash comes before every backslash, before the second of two hashes
and before the slash of "</": no mark can arise within them, and dropping each escaping backslash restores them.

Defined results: a null text or role is empty; a null conv_id is a conversation; turns go by
turn (null first), then role and text; repeated rows are turns each; an empty table gives no
row. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_END, ROLE_END = "</turn>\n", "</role>\n"
EXTRA = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("##"), F.lit("#\\#"))
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, n_turns): loss_end is exclusive,
    both are null in a closing example."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    talks = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    head = lambda t: F.concat(F.lit("### "), escape(t["role"]), F.lit(ROLE_END))
    parts = F.transform("all", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("target")))
    talks = talks.select("conv_id", parts.alias("parts"))
    last = F.size("parts") - 1
    goals = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.get("parts", i)["target"])
    each = talks.select("conv_id", "parts", F.posexplode(goals).alias("example", "i"))
    join = lambda n: F.array_join(F.transform(F.slice("parts", 1, n), lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    goal = F.get("parts", F.col("i"))
    begin = F.when(goal["target"], F.char_length("before") + F.char_length(goal["head"]))
    return each.withColumn("before", join(F.col("i"))).select(
        "conv_id",
        "example",
        F.concat("before", goal["head"], goal["body"], F.lit(TURN_END)).alias("formatted"),
        begin.cast("long").alias("loss_start"),
        (begin + F.char_length(goal["body"])).cast("long").alias("loss_end"),
        (F.col("i") + 1).cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    marks = F.slice(F.split(formatted, TURN_END), 1, F.size(F.split(formatted, TURN_END)) - 1)

    def one(s: Column) -> Column:
        at = F.instr(s, ROLE_END)
        return F.struct(unescape(F.substr(s, F.lit(5), at - 5)).alias("role"), unescape(F.substr(s, at + len(ROLE_END))).alias("text"))

    return F.transform(marks, one)


def digest(rows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    final = F.max_by(F.col("formatted"), F.col("example")).alias("whole")
    said = F.sort_array(F.collect_list(F.when(loss.isNotNull(), F.struct("example", loss.alias("loss"))))).alias("said")
    talks = rows.groupBy("conv_id").agg(final, said, F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"))
    turns = talks.withColumn("turns", read_turns(F.col("whole"))).withColumn("loss", F.array_join(F.transform("said", lambda s: s["loss"]), ""))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_extra(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns`` and a conversation -7 that says the marks themselves."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


def query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return digest(examples(with_extra(spark, turns)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    4 + 8 + 8
    + length(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</', '<\/'))
    + length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM sized
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
