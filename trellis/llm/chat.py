"""Chat formatting as a grammar round trip.

Every turn is rendered with the marks of a fixed template. The rendering is parsed again by a
deterministic parser (one regular expression: marks never occur inside a turn that parses whole) and
the recovered turns are compared with the source. Where they differ, texts hold something that reads
as a mark or as an escape; those conversations are rendered again with such strings escaped, which
is a bijection, so the second rendering parses back to the source. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, fixed values. An escaped mark carries backslashes after its first character.
OPEN = {"user": "[INST] ", "assistant": "[OUT] "}
CLOSE = {"user": " [/INST]", "assistant": "</s>"}
_MARK = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|OUT\]|SEP\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\]|OUT\]|SEP\])"
_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|\[OUT\] (.*?)</s>|\[ROLE\] (.*?) \[SEP\] (.*?) \[/ROLE\]"


def escape(c: Column) -> Column:
    """One backslash more after the first character of every mark, escaped ones too."""
    return F.regexp_replace(c, F.lit(_MARK), F.lit(r"$1\\$2$3"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_ESCAPED), F.lit("$1$2$3"))


def render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("[OUT] "), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE] "), role, F.lit(" [SEP] "), text, F.lit(" [/ROLE]")))
    )


def render(turns: Column, escaped: bool) -> Column:
    esc = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: render_turn(
        F.when(t["role"].isin("user", "assistant"), t["role"]).otherwise(esc(t["role"])), esc(t["text"]))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation."""
    def turn(s: Column) -> Column:
        part = lambda g: F.regexp_extract(s, _TURN, g)
        return (
            F.when(s.startswith("[INST]"), F.struct(F.lit("user").alias("role"), unescape(part(1)).alias("text")))
            .when(s.startswith("[OUT]"), F.struct(F.lit("assistant").alias("role"), unescape(part(2)).alias("text")))
            .otherwise(F.struct(unescape(part(3)).alias("role"), unescape(part(4)).alias("text")))
        )
    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, turns (read back from ``formatted``).

    Rows go by turn (null first), ties by role and text; null roles and texts are empty. A repeated
    row is a turn of its own. Rows with a null id form one conversation; an empty table gives an empty result. Role names are rendered by mark
    where the template has one, others are spelled out. A conversation is one value of the result, so
    its turns meet in one task.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    gathered = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    convs = gathered.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"], t["text"])).alias("source"))
    plain = convs.withColumn("plain", render(F.col("source"), False)).withColumn("read", parse(F.col("plain"))).withColumn("ok", F.col("read") == F.col("source"))
    out = plain.select("conv_id", "source", "read", "ok", F.when(F.col("ok"), F.col("plain")).otherwise(render(F.col("source"), True)).alias("formatted"))
    # what parsed back at once is not parsed again
    back = out.withColumn("turns", F.when(F.col("ok"), F.col("read")).otherwise(parse(F.col("formatted"))))
    return back.select("conv_id", F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).alias("formatted"), (~F.col("ok")).alias("escaped"), "turns")


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of :func:`format_chats`."""
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
