"""Chat formatting with a grammar round trip, with DataFrame functions only.

    conversation := "<s>" turn* "</s>"
    turn         := "[INST]" role "\\n" text "[/INST]"

A control string inside a role or text is escaped by a backslash after its first character; one that has backslashes there
already gets one more. So the map is reversible, and no control string of a text is left in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: A control string's first character, any backslashes, and its rest.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role ends at the first newline, so its own newlines, and the % that marks them, are coded too."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("[INST]"), role, F.lit("\n"), text, F.lit("[/INST]"))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array<struct<role, text, raw>> of a rendered conversation, raw being the text as it stands
    in the output; null where the string is not of the grammar."""
    body = F.substring(formatted, F.lit(10), F.length(formatted) - F.lit(20))
    parts = F.split(body, r"\[/INST\]\[INST\]")
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        F.substring(p, F.instr(p, "\n") + 1, F.length(p)).alias("raw"),
    )
    whole = formatted.startswith("<s>[INST]") & formatted.endswith("[/INST]</s>") & F.forall(parts, lambda p: p.contains("\n") & ~p.rlike(r"\[/?INST\]|</?s>"))
    return F.when(formatted == "<s></s>", F.expr("array()").cast("array<struct<role:string,text:string,raw:string>>")).when(whole, F.transform(parts, turn))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, turns (array<struct<role, text, raw>> reparsed from formatted), loss_spans
    (array<struct<start, length>> in code points of formatted: the texts of loss_role).

    Each turn is first rendered as it is and reparsed; where the recovered turn differs from the source, its conflicting
    content is escaped and the turn is reparsed again; a turn that still differed would raise an error. Then turns are put
    together in the order of `turn` (nulls first; ties by role, then text). Null roles and texts are empty; null is a
    conversation of its own; repeated rows stay; an empty table gives no rows. A conversation is one output string, so
    its turns meet in one task, escaped and reparsed before that; Spark's limit of 2 GB a string holds for it."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    same = lambda got: F.coalesce((F.size(got) == 1) & (F.get(got, 0)["role"] == F.col("r")) & (F.get(got, 0)["text"] == F.col("t")), F.lit(False))
    whole = lambda s: parse(F.concat(F.lit("<s>"), s, F.lit("</s>")))
    turns = rows.select(F.col(conv).alias("c"), F.col(turn).alias("n"), r.alias("r"), t.alias("t"))
    conflicts = F.concat("r", F.lit("\n"), "t").rlike(CONTROL + r"|%") | F.col("r").contains("\n")
    plain, safe = render_turn(F.col("r"), F.col("t")), render_turn(_escape_role(F.col("r")), escape(F.col("t")))
    # without any character sequence that the escape touches, plain and safe are one string, and one parse settles both
    piece = F.when(~conflicts | same(whole(plain)), plain).otherwise(safe)
    turns = turns.withColumn("piece", piece).withColumn("piece", F.when(same(whole(F.col("piece"))), F.col("piece")).otherwise(F.raise_error(F.concat(F.lit("a turn can't be recovered: "), "piece"))))
    joined = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(F.col("n").isNotNull(), "n", "r", "t", "piece"))).alias("all"))
    joined = joined.select("c", F.concat(F.lit("<s>"), F.array_join(F.col("all.piece"), ""), F.lit("</s>")).alias("formatted"), F.transform("all", lambda x: F.struct(x["r"].alias("role"), x["t"].alias("text"))).alias("source"))
    back = joined.withColumn("turns", parse(F.col("formatted")))
    back = back.withColumn("turns", F.when(F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation can't be recovered"))))
    # lengths as they stand in the output: [INST] and role and newline, text, [/INST]
    ends = F.aggregate(
        F.zip_with("turns", F.split(F.substring(F.col("formatted"), F.lit(10), F.length("formatted") - F.lit(20)), r"\[/INST\]\[INST\]"), lambda x, p: F.struct(x["role"].alias("role"), F.length(p).alias("all"), F.length(x["raw"]).alias("raw"))),
        F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + 13 + x["all"]).alias("at"),
            F.when(x["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + 6 + x["all"] - x["raw"]).alias("start"), x["raw"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return back.select(F.col("c").alias(conv), "formatted", "turns", ends.alias("loss_spans"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations, one row each, with conversation -7 added."""
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = format_conversations(rows)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return made.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
