"""Conversation assembly (C1-C4): history filter, context check, the three
role layouts and message records.

Rows are ``(conv_id, turn, role, text)``; role ``assistant`` is the model.
Layouts gather the turns of one conversation into one row (bounded by the
conversation), ordered by ``turn`` explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwise.functions.columns import elapsed_seconds_ceil, strip_unicode

ROLE_SEP, MSG_SEP = "\u001f", "\u001e"


def history(conv: DataFrame, include_context: bool = False) -> DataFrame:
    """Ordered messages without system turns unless asked."""
    return conv if include_context else conv.filter(F.col("role") != "system")


def context_check(conv: DataFrame) -> DataFrame:
    """Exactly one system message and it is the first turn."""
    agg = conv.groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n_system"),
                                      F.min_by("role", "turn").alias("first_role"))
    return agg.withColumn("valid", (F.col("n_system") == 1) & (F.col("first_role") == "system"))


def _layout(rows: DataFrame, role_expr, text_expr) -> DataFrame:
    msgs = rows.select("conv_id", "turn", role_expr.alias("r"), text_expr.alias("t"))
    agg = msgs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "r", "t"))).alias("_m"),
        F.count_if(F.col("r").isNull()).alias("_bad"))
    return agg


def layout_roles(conv: DataFrame) -> DataFrame:
    """C3 (a): user / system / assistant unchanged; unknown role -> error."""
    role = F.when(F.col("role").isin("user", "system", "assistant"), F.col("role"))
    agg = _layout(conv, role, strip_unicode("text"))
    return agg.select("conv_id", F.size("_m").alias("n_messages"),
                      F.array_join(F.transform("_m", lambda m: F.concat(m["r"], F.lit(ROLE_SEP), m["t"])), MSG_SEP)
                      .alias("messages"), (F.col("_bad") == 0).alias("valid"))


def layout_user_model(conv: DataFrame) -> DataFrame:
    """C3 (b): system becomes user, assistant becomes model."""
    role = (F.when(F.col("role").isin("user", "system"), F.lit("user"))
            .when(F.col("role") == "assistant", F.lit("model")))
    agg = _layout(conv, role, strip_unicode("text"))
    return agg.select("conv_id", F.size("_m").alias("n_messages"),
                      F.array_join(F.transform("_m", lambda m: F.concat(m["r"], F.lit(ROLE_SEP), m["t"])), MSG_SEP)
                      .alias("messages"), (F.col("_bad") == 0).alias("valid"))


def layout_instruction(conv: DataFrame) -> DataFrame:
    """C3 (c): system text split off as the context (exactly one required);
    user turns wrapped in ``[INST] ... [/INST]``, model turns as they are,
    joined by newline."""
    sys_text = (conv.filter(F.col("role") == "system").groupBy("conv_id")
                .agg(F.min_by(strip_unicode("text"), "turn").alias("system_prompt")))
    body = history(conv)
    t = strip_unicode("text")
    text = (F.when(F.col("role") == "user", F.concat(F.lit("[INST] "), t, F.lit(" [/INST]")))
            .when(F.col("role") == "assistant", t))
    agg = _layout(body, F.when(F.col("role").isin("user", "assistant"), F.col("role")), text)
    out = agg.select("conv_id", F.array_join(F.transform("_m", lambda m: m["t"]), "\n").alias("prompt"),
                     (F.col("_bad") == 0).alias("_ok"))
    checks = context_check(conv).select("conv_id", "n_system")
    return (checks.join(sys_text, "conv_id", "left").join(out, "conv_id", "left")
            .select("conv_id", "system_prompt", "prompt",
                    F.when(F.col("n_system") != 1, F.lit("context_count"))
                    .when(~F.coalesce(F.col("_ok"), F.lit(True)), F.lit("unknown_role")).alias("error")))


def message_records(conv: DataFrame, created_col: str | None = None) -> DataFrame:
    """C4: text stripped, author in {user, model, system}.  With the time of each message (``created_col``) also
    ``created`` and ``elapsed``: whole seconds, rounded up, since the message before it in its conversation."""
    author = (F.when(F.col("role") == "assistant", F.lit("model"))
              .when(F.col("role").isin("user", "system"), F.col("role")))
    cols = ["conv_id", "turn", author.alias("author"), strip_unicode("text").alias("text")]
    if created_col is None:
        return conv.select(*cols)
    made = F.col(created_col).cast("timestamp")
    before = F.lag(made).over(Window.partitionBy("conv_id").orderBy("turn"))  # the turns of one conversation
    return conv.select(*cols, made.alias("created"), elapsed_seconds_ceil(before, made).alias("elapsed"))
