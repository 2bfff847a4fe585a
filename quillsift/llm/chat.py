"""Chat formatting by prefix-target expansion: one training example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.session import plain_unions

#: The template's control strings. A turn is OPEN role NEWLINE text CLOSE NEWLINE.
OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
#: Stands for a line end inside a role, where a plain one would end the role.
LINE = "<|n|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """Between "<" and "|" a run of backslashes, of none too, gets one more: then no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def rendered(turn: Column) -> Column:
    """One turn in the template."""
    role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit(LINE))
    return F.concat(F.lit(OPEN), role, F.lit(NEWLINE), escaped(turn["text"]), F.lit(CLOSE + NEWLINE))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, lone, example, formatted, loss_start, loss_length: one row for each assistant turn, and one for what follows the last.

    `formatted` holds all turns up to that assistant turn in the template; only the code points from loss_start (from
    0) on, loss_length of them, are trained on: the reply itself, without marks. Turns after the last assistant turn
    stand, with all before them, in one more example whose loss is null, so no turn is lost; `example` counts from 0.
    Control strings inside texts and roles are escaped, and read_turns() gives back what went in.

    Turns go by turn, then role, then text (nulls first); repeated rows are turns of their own. Null roles and texts are
    read as empty. A row without conv_id is a conversation of one turn; the column `lone` numbers these rows and is null
    elsewhere. A conversation's examples repeat its earlier turns, as
    the method has it: n assistant turns over t turns cost up to n * t rendered turns. An empty table gives no rows;
    other columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    talks = turns.groupBy(F.col(conv_col).alias("conv"), lone.alias("lone")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = talks.select("conv", "lone", F.transform("turns", lambda t: F.struct((t["role"] == TRAINED).alias("trained"), F.length(escaped(t["text"])).alias("size"), rendered(t).alias("text"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k)["trained"] | (k == F.size("turns")))
    each = made.select("conv", "lone", "turns", F.posexplode(ends).alias("example", "upto"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: t["text"]), "")
    last = F.element_at("turns", F.col("upto"))
    size = F.when(last["trained"], last["size"]).cast("long")
    return each.select(F.col("conv").alias(conv_col), "lone", F.col("example").cast("long").alias("example"), text.alias("formatted"), size.alias("loss_length")).withColumn(
        "loss_start", F.when(F.col("loss_length").isNotNull(), F.length("formatted") - len(CLOSE + NEWLINE) - F.col("loss_length")).cast("long")
    )


def read_turns(formatted: Column) -> Column:
    """The turns, (role, text), that a formatted example holds."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(parts, lambda p: F.struct(unescaped(F.replace(F.substring_index(p, NEWLINE, 1), F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(F.substring(p, F.instr(p, NEWLINE) + 1, F.length(p) - F.instr(p, NEWLINE) - len(CLOSE + NEWLINE))).alias("text")))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns say nothing but control strings."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    said = "<|im_end|><|im_start|>assistant ok"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], schema)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted examples."""
    plain_unions(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    examples = format_conversations(turns)
    loss = F.when(F.col("loss_length").isNotNull(), unescaped(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))))
    read = examples.groupBy("conv_id", "lone").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("text")))), lambda x: x["text"]), "").alias("loss"),
    )
    heard = F.transform(read_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size(heard).cast("long").alias("n_turns"), F.sha2(F.array_join(heard, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
