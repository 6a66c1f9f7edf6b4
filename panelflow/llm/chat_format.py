"""Chat formatting in budgeted windows of turns.

A turn becomes ``<|role|>`` + text + ``<|end|>`` + newline.  Inside roles and
texts ``\\\\`` is written ``\\\\\\\\`` and ``<`` is written ``\\\\l``, so no control
string can occur there and reading back is exact.

The size of a turn is an estimate in tokens (a quarter of its bytes, or the
column ``tokens_col``, and ``TURN_TOKENS``).  Prefix sums of the sizes choose
the windows: of ``budget``, a share is left for the system turn and for
``history``; a window takes turns as long as their sum stays within the rest,
and the next one begins at the first turn that does not.  The prefix sums of a
conversation, without its texts, are folded once for the places where windows
begin.  A window repeats the system turn (the first turn, if that is its role)
and the turns that lie wholly within the ``history`` tokens before it; both are
masked, so each assistant text is a target once.  A turn larger than the rest of
the budget is a window of its own and kept whole.

Defined results: null texts and roles count as empty.  Rows of one conversation
are ordered by turn, then role and text (nulls first); repeated rows are turns
of their own.  Rows with null conversation id form one conversation.  Empty
tables give no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 512
#: Left for the system turn; a longer one is retained all the same.
SYSTEM = 256
TURN_TOKENS = 6
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape`` and ``escape_role``: escaped text holds no ``<``, so ``<`` sets its pairs aside first."""
    for pair, aside in (("\\\\", "<b"), ("\\l", "<l"), ("\\p", "<p"), ("<p", "|"), ("<b", "\\"), ("<l", "<")):
        text = F.replace(text, F.lit(pair), F.lit(aside))
    return text


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape_role(role), F.lit("|>"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM,
                 conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 tokens_col: str | None = None) -> DataFrame:
    """(conv_id, window, text, n_turns, n_repeated, targets) per window.

    ``n_repeated`` turns at the front are repeats; ``targets`` are the spans
    (start from 0, length, in code points) under the loss mask.
    """
    room = budget - history - system
    if room <= 0:
        raise ValueError("budget leaves no room beside history and system")
    tokens = F.col(tokens_col).cast("long") if tokens_col else F.ceil(F.octet_length("text") / 4)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.col(tokens_col)] if tokens_col else []))
    every = Window.partitionBy("conv_id")
    upto = every.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("tokens", F.coalesce(tokens, F.lit(0)))
    rows = rows.withColumns({"pos": F.row_number().over(every.orderBy("turn", "role", "text")), "count": F.count("*").over(every)})
    is_system = (F.col("pos") == 1) & (F.col("role") == "system") & (F.col("count") > 1)
    rows = rows.withColumn("is_system", is_system).withColumn("size", F.when(is_system, F.lit(0)).otherwise(F.col("tokens") + TURN_TOKENS))
    rows = rows.withColumn("to", F.sum("size").over(upto)).withColumn("from", F.col("to") - F.col("size"))

    # where windows begin, from the prefix sums alone
    begins = F.aggregate(
        F.array_sort(F.collect_list(F.struct("from", "to"))), F.array(F.lit(0).cast("long")),
        lambda acc, t: F.when((t["to"] - F.element_at(acc, -1) > room) & (t["from"] > F.element_at(acc, -1)), F.concat(acc, F.array(t["from"]))).otherwise(acc))
    starts = rows.groupBy(F.col("conv_id").alias("c")).agg(begins.alias("starts"))
    placed = rows.join(starts, rows["conv_id"].eqNullSafe(starts["c"]))
    begun = F.filter("starts", lambda s: s <= F.col("from"))
    later = F.filter("starts", lambda s: (s >= F.col("to")) & (s <= F.col("from") + history) & (s > F.element_at(begun, -1)))

    def windows_of(found: Column, kind: int) -> Column:
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("start")))

    places = F.when(F.col("is_system"), windows_of(F.col("starts"), 0)).otherwise(
        F.concat(windows_of(F.slice(begun, -1, 1), 2), windows_of(later, 1)))
    placed = placed.select("conv_id", "pos", "role", "text", "starts", F.explode(places).alias("p")).select(
        "conv_id", "pos", "role", "text", "p.*", (F.array_position("starts", F.col("p.start")) - 1).alias("window"))
    body = escape(F.col("text"))
    piece = F.concat(head(F.col("role")), body, F.lit(END))
    placed = placed.select(
        "conv_id", "window", F.struct(
            "kind", "pos", piece.alias("piece"), F.char_length(piece).alias("size"), F.char_length(head(F.col("role"))).alias("skip"),
            F.char_length(body).alias("body"), ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("target"),
            ((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("start") > 0))).alias("repeat")).alias("t"))
    whole = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.aggregate(
        "ts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(t["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["skip"]).alias("start"), t["body"].alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return whole.select(
        "conv_id", "window", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"), F.size("ts").alias("n_turns"),
        F.size(F.filter("ts", lambda t: t["repeat"])).alias("n_repeated"), spans.alias("targets"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars): roles and texts, and the text under the loss mask, from the output alone."""
    pieces = F.split("text", r"<\|end\|>\n")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "|>")
        return F.struct(unescape(F.substring(x, 3, cut - 3)).alias("role"), unescape(F.substring(x, cut + 2, F.char_length(x))).alias("text"))

    loss = F.array_join(F.transform("targets", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    each = windows.select("conv_id", F.char_length("text").alias("chars"), F.struct("window", F.transform(new, turn).alias("turns"), loss.alias("loss")).alias("w"))
    both = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    return both.select(
        "conv_id", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["loss"]), "").alias("loss"), "formatted_chars")
