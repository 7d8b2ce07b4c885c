"""Chat formatting in budgeted windows, in DataFrame functions alone.

A turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts a backslash is doubled and `<|` becomes `<\\|`, so no
control string can stand inside them and dropping each escaping backslash gives them back.

Prefix sums of the turns' tokens cut a conversation into blocks of BLOCK budgets. Within a block the turns are taken in order: a
window's new turns are as many whole turns as fit beside the system turn and `history` tokens, the first window's as many as fit the
budget. A window repeats the turns that begin in the last `history` tokens before it, less where its new turns leave less, and before
them the conversation's system turn. The loss mask covers the text of new assistant turns alone, so every assistant text is a target
once. Turns are never cut: a window passes its budget only where one new turn and the system turn pass it by themselves.

Prefix sums are taken in two levels, within runs of RUN turn numbers and over the runs, so a long conversation is not one task's.
Where every conversation fits a task, as it must wherever one row is to hold its whole text, `together` takes all steps on one shuffle
by conversation: texts then move once instead of three times, and read_back moves none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"  # fixed values: the template's control strings
BUDGET = 1024
HISTORY = 256
OVERHEAD = 4  # tokens of a turn's marks
RUN = 64
BLOCK = 16  # budgets that one row holds while its windows are chosen


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if role else out  # a line feed ends the role


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    """Words and single signs, an estimate that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + F.lit(OVERHEAD)


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    together: bool = False, tokens: str | None = None,
) -> DataFrame:
    """(conv, window, text, loss, n_repeated, n_new): the windows of every conversation.

    window: long, the tokens before its first new turn, so it rises along the conversation. loss: array of (start, end) in code points
    of the window's text. n_repeated: leading turns that stand in an earlier window too. tokens: a column of each text's token count
    (null or negative: none), which otherwise is estimated. Turns are ordered by turn number, nulls first, ties by role and text;
    repeated rows are turns of their own. Null roles and texts are empty, and a null conv is a conversation of its own. Other columns
    are left out. together: one shuffle by conversation, for conversations that fit a task; the rows are the same.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    reach = BLOCK * budget
    rows = turns.select(
        F.col(f"`{conv}`").alias("c"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *([F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0)).alias("given")] if tokens else []),
    )
    sized = rows.withColumn("tokens", (F.col("given") + OVERHEAD if tokens else token_count(F.col("text"))).cast("long"))
    order = ["turn", "role", "text", *(["given"] if tokens else [])]
    if together:
        keys = ["c"]
        before = W.partitionBy("c").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        begun = sized.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    else:
        keys = ["none", "c"]  # joins need one key for null and other ids, and null turns are a run
        sized = sized.withColumns({"none": F.col("c").isNull(), "c": F.coalesce("c", F.lit(0).cast(turns.schema[conv].dataType)), "run": F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62)))})
        runs = sized.groupBy(*keys, "run").agg(F.sum("tokens").alias("sum"))
        over_runs = W.partitionBy(*keys).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
        offsets = runs.select(*keys, "run", F.coalesce(F.sum("sum").over(over_runs), F.lit(0)).alias("offset"))
        within = W.partitionBy(*keys, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        begun = sized.join(offsets, [*keys, "run"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = begun.withColumn("block", F.floor(F.col("start") / reach)).withColumn("system", (F.col("start") == 0) & (F.col("role") == "system"))

    head = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    # what the next block's first windows may repeat goes there too
    again = (F.col("start") >= (F.col("block") + 1) * reach - history) & ~F.col("system")
    uses = F.array_compact(F.array(F.struct("block", F.lit(True).alias("new")), F.when(again, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("new")))))
    used = placed.select(*keys, "start", "tokens", "role", "system", head.alias("head"), body.alias("body"), F.explode(uses).alias("use"))
    piece = F.struct("start", "tokens", F.col("use.new").alias("new"), "head", "body", (F.col("use.new") & (F.col("role") == "assistant")).alias("target"), "system")
    blocks = used.groupBy(*keys, F.col("use.block").alias("block")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    blocks = blocks.where(F.exists("pieces", lambda p: p["new"]))
    if together:
        along = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
        whole = blocks.withColumn("first", F.first(F.filter("pieces", lambda p: p["system"])).over(along))
    else:
        first = F.struct("start", "tokens", F.lit(True).alias("new"), head.alias("head"), body.alias("body"), F.lit(False).alias("target"), "system")
        whole = blocks.join(placed.where("system").select(*keys, F.array(first).alias("first")), keys, "left")
    whole = whole.withColumn("first", F.coalesce("first", F.filter("pieces", lambda p: F.lit(False)))).withColumn("kept", F.coalesce(F.get("first", F.lit(0))["tokens"], F.lit(0)))

    def step(acc: Column, p: Column) -> Column:
        room = F.when(acc["at"] == 0, F.lit(budget)).otherwise(F.lit(budget - history) - F.col("kept"))
        opens = p["new"] & ((F.size(acc["begins"]) == 0) | (p["start"] + p["tokens"] - acc["at"] > room))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(opens, p["start"]).otherwise(acc["at"]).alias("at"),
            F.when(opens, F.concat(acc["begins"], F.array(acc["i"]))).otherwise(acc["begins"]).alias("begins"),
        )

    begins = F.aggregate("pieces", F.struct(F.lit(1).alias("i"), F.lit(-1).cast("long").alias("at"), F.array().cast("array<int>").alias("begins")), step, lambda acc: acc["begins"])
    whole = whole.withColumn("begins", begins)
    most = history // OVERHEAD + 1  # no turn is shorter than its marks

    def window(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("begins", i + 1), F.size("pieces") + 1)
        early = F.greatest(begin - most, F.lit(1))
        return F.struct(F.slice("pieces", early, begin - early).alias("before"), F.slice("pieces", begin, end - begin).alias("new"))

    windows = whole.select(*keys, "first", "kept", F.explode(F.transform("begins", window)).alias("w")).select(*keys, "first", "kept", "w.before", "w.new")
    start, last = F.col("new")[0]["start"], F.element_at("new", -1)
    windows = windows.withColumn("window", start)
    room = F.least(F.lit(history), F.lit(budget) - F.col("kept") - (last["start"] + last["tokens"] - start))
    known = lambda pieces: F.transform(pieces, lambda p: p.withField("new", F.lit(False)).withField("target", F.lit(False)))
    windows = windows.withColumn("room", room)
    repeated = known(F.concat("first", F.filter("before", lambda p: (p["start"] >= F.col("window") - F.col("room")) & ~p["system"])))
    whole = windows.withColumn("pieces", F.when(F.col("window") > 0, F.concat(repeated, "new")).otherwise(F.col("new")))
    end = F.lit(END + "\n")
    length = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.char_length(end)
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, p: F.struct(
            (acc["at"] + length(p)).alias("at"),
            F.when(p["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.char_length(p["head"])).alias("start"), (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return whole.select(
        (F.col("c") if together else F.when(~F.col("none"), F.col("c"))).alias(conv),
        "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], end)), "").alias("text"),
        spans.alias("loss"),
        F.size(F.filter("pieces", lambda p: ~p["new"])).alias("n_repeated"),
        F.size(F.filter("pieces", lambda p: p["new"])).alias("n_new"),
    )


def parsed_turns(text: Column) -> Column:
    """Array of (role, text) read back from a window's text."""
    # possessive repeats: Java matches them in a loop, where an alternation would take a stack frame for each character
    pattern = r"(?s)<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*?)<\|im_end\|>\n"
    part = lambda i: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), unescaped)
    return F.zip_with(part(1), part(2), lambda r, t: F.struct(r.alias("role"), t.alias("text")))


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, loss_text, chars) of each conversation, from its windows' texts, masks and counts alone: its turns in order, all
    text under the loss mask, and the code points of all windows."""
    lost = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    turns = F.expr("slice(turns, n_repeated + 1, n_new)")
    each = windows.withColumn("turns", parsed_turns(F.col("text"))).select(conv, "window", turns.alias("turns"), F.array_join(lost, "").alias("lost"), F.char_length("text").cast("long").alias("chars"))
    # a conversation is one row here because its digests are taken of its whole text
    whole = each.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("window", "turns", "lost"))).alias("w"), F.sum("chars").alias("chars"))
    return whole.select(conv, F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"), F.array_join(F.transform("w", lambda w: w["lost"]), "").alias("loss_text"), "chars")
