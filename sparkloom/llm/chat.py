"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns get a token count and its prefix sum in their conversation. A window is a span of turns: those that start in
one stride of the prefix sum, where the stride is the budget less the history and the system turn. Where these are
longer together than a stride, the last of them, which crosses into the next one, is a window of its own. Windows
repeat the leading system turn and the whole turns that fit in the last ``history`` tokens before them; the loss
mask covers the assistant turns of the window's own span only, so each target counts once.

System, history and own turns together keep the budget. A turn is never cut: only one that is longer than the budget
itself stands in a window that exceeds it. Where a turn fits only without history or the system turn, its window
doesn't repeat them; a system turn that leaves less than ``history`` tokens is a turn like any other.

Template: ``<|turn|>role<|text|>text<|end|>`` and a newline. Control strings of this and other common templates are
escaped in roles and texts by a backslash after their opening character; strings that look escaped get one more,
so that the reader restores every text exactly.

A conversation's own digest is of its whole text, so reading back gathers a conversation's turns in one row;
the windows themselves are made row by row.

Defined results: null texts and roles are empty; repeated turns are kept, in order of turn (nulls first), role and
text; a null conv_id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Tokens of a window, of the history that it repeats, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 4
#: What follows the last ``<`` or ``[`` of a control string.
CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\{CONTROL}", "$1$2")


def tokens(text: Column) -> Column:
    """Tokens of a text: words, and other characters that aren't white space."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + MARKS


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, text, context, loss``: formatted windows of the turns ``(conv_id, turn, role, text)``.

    context is how many turns at the start repeat earlier ones; loss holds the spans (start from 1, length) of
    code points under the loss mask.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumns({"at": F.row_number().over(ordered), "n": tokens(F.col("text"))})
    rows = rows.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system") & (F.col("n") <= budget - history))
    spent = F.when(F.col("system"), 0).otherwise(F.col("n"))
    rows = rows.withColumns(
        {
            "end": F.sum(spent).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "repeated": F.coalesce(F.max(F.when(F.col("system"), F.col("n"))).over(whole), F.lit(0)),
        }
    )
    room = F.lit(budget) - F.col("repeated")
    stride = F.greatest(F.lit(1), room - F.least(F.lit(history), F.floor(room / 2)))
    rows = rows.withColumns({"start": F.col("end") - spent, "stride": stride})
    place = lambda x: F.floor(x / F.col("stride"))
    rows = rows.withColumn("span", place(F.col("start")))
    alone = F.col("end") - F.min("start").over(Window.partitionBy("conv_id", "span")) > F.col("stride")
    rows = rows.withColumn("key", F.col("span") * 2 + alone.cast("int"))
    # Windows that may repeat a turn: both of each stride in which one may start after it.
    last = F.when(F.col("system"), F.max("key").over(whole)).otherwise(place(F.col("start") + history) * 2 + 1)
    rows = rows.withColumn("last", last)
    rows = rows.select("*", F.explode(F.sequence("key", F.greatest("key", "last"))).alias("window"))
    rows = rows.withColumn("own", F.col("window") == F.col("key"))
    of = Window.partitionBy("conv_id", "window")
    rows = rows.withColumns({"first": F.min(F.when(F.col("own"), F.col("start"))).over(of), "spent": F.max(F.when(F.col("own"), F.col("end"))).over(of)})
    left = F.lit(budget) - (F.col("spent") - F.col("first"))
    fits = (F.col("repeated") <= left) | (left < 0)
    near = F.col("first") - F.col("start") <= F.least(F.lit(history), left - F.when(fits, F.col("repeated")).otherwise(0))
    rows = rows.where("first is not null").where(F.col("own") | F.when(F.col("system"), fits).otherwise((F.col("end") <= F.col("first")) & near))
    rows = rows.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(of.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    rows = rows.withColumn("from", (before + F.length("head") + 1).cast("int"))
    turn = F.struct("at", "own", "role", F.concat("head", "body", F.lit(END)).alias("said"), "from", F.length("body").alias("chars"))
    made = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.filter("turns", lambda t: t["own"] & (t["role"] == "assistant"))
    return made.select(
        "conv_id",
        "window",
        F.array_join("turns.said", "").alias("text"),
        F.size(F.filter("turns", lambda t: ~t["own"])).alias("context"),
        F.transform(loss, lambda t: F.struct(t["from"].alias("start"), t["chars"].alias("chars"))).alias("loss"),
    )


def read_windows(made: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, chars``: the turns (role, text) and loss texts of windows, each once, and their length."""
    said = F.split(F.col("text"), r"<\|end\|>\n")
    said = F.slice(said, F.col("context") + 1, F.size(said) - 1 - F.col("context"))

    def parse(x: Column) -> Column:
        head = F.substring_index(x, TEXT, 1)
        role = F.substring(head, F.lit(len(TURN) + 1), F.length(head))
        body = F.substring(x, F.length(head) + len(TEXT) + 1, F.length(x))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"], s["chars"])))
    read = made.select("conv_id", F.struct("window", F.transform(said, parse).alias("turns"), loss.alias("loss"), F.length("text").alias("chars")).alias("w"))
    read = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: (a["window"] - b["window"]).cast("int")).alias("w"))
    return read.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.loss").alias("loss"), F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("chars"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    read = read_windows(windows(turns.unionByName(probe)))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
