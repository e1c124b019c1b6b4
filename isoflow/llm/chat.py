r"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as ``<turn N new|old ROLE>TEXT</turn>`` and a line end; N is its place in
the conversation from 1 on. In roles and texts a backslash becomes ``\b``, ``<`` becomes
``\l`` and ``>`` in roles ``\g``, so that no text can hold a tag and all is read back as it
was. A null role is ``\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

END = "</turn>\n"
#: Tokens counted for a turn besides its text.
TURN_COST = 4


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def role_tag(role: Column) -> Column:
    return F.coalesce(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\\n"))


def role_of(tag: Column) -> Column:
    return F.when(tag != "\\n", unescape(F.replace(tag, F.lit("\\g"), F.lit(">"))))


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.ceil(F.length(text) / 4).cast("long")


def format_windows(
    conversations: DataFrame,
    budget: int = 512,
    history_turns: int = 2,
    history_share: float = 0.25,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens=token_estimate,
) -> DataFrame:
    """(conv_id, window, n_tokens, text, loss): every conversation in windows of up to ``budget`` tokens.

    Turns go by ``turn`` (nulls first), then role and text. Prefix sums of their tokens cut a
    conversation into spans of whole turns: a window takes turns as long as they fit, and at
    least one, so that only a turn too long for itself exceeds the budget. Every window after
    the first repeats a leading system turn and, just before its span, up to
    ``history_turns`` turns whose tokens fit in ``history_share`` of the budget. ``loss``
    holds start (from 0) and length in code points of the texts of assistant turns of the
    span; repeated turns are masked. So each assistant turn is a target once.

    Null texts count as empty; a null role is a role of its own; rows with a null
    conversation id form one conversation; repeated rows are turns each. A conversation is
    one record and is formatted as one row. An empty table gives an empty result.
    """
    t = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("cost", (tokens(F.col("text")) + TURN_COST).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("n"),
            "role",
            "text",
            "cost",
            F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        ).alias("t"),
    )
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = F.col("turns")[0]
    c = c.withColumn("system", F.when(first["role"] == "system", first["cost"]))
    share = int(budget * history_share)
    skip = F.when(F.col("system").isNotNull(), 1).otherwise(0)

    def history(i: Column) -> Column:
        """How many turns before turn ``i`` (from 0) are repeated with it."""
        n = F.lit(0)
        last = F.get("turns", i - 1)["upto"]
        for k in range(1, history_turns + 1):
            x = F.get("turns", i - k)
            n = n + F.when((i - k >= skip) & (last - x["upto"] + x["cost"] <= share), 1).otherwise(0)
        return n

    def step(acc: Column, i: Column) -> Column:
        x = F.get("turns", i)
        before = x["upto"] - x["cost"]
        h = history(i)
        kept = F.when(h > 0, before - F.get("turns", i - h)["upto"] + F.get("turns", i - h)["cost"]).otherwise(F.lit(0).cast("long"))
        # History gives way to a turn that would not fit beside it.
        fits = x["cost"] + kept + F.coalesce("system", F.lit(0).cast("long")) <= budget
        h, kept = F.when(fits, h).otherwise(0), F.when(fits, kept).otherwise(F.lit(0).cast("long"))
        fresh = F.struct(
            F.concat(acc["starts"], F.array(F.struct(i.alias("at"), h.alias("history")))).alias("starts"),
            before.alias("base"),
            (F.lit(budget).cast("long") - F.coalesce("system", F.lit(0).cast("long")) - kept).alias("room"),
        )
        return F.when((i > 0) & (x["upto"] - acc["base"] > acc["room"]) & (i != acc["starts"][F.size(acc["starts"]) - 1]["at"]), fresh).otherwise(acc)

    begin = F.struct(
        F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("history"))).alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(budget).cast("long").alias("room")
    )
    c = c.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), begin, step, lambda a: a["starts"]))

    def piece(x: Column, old: bool) -> Column:
        head = F.concat(F.lit("<turn "), x["n"].cast("string"), F.lit(" old " if old else " new "), role_tag(x["role"]), F.lit(">"))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), (F.lit(not old) & F.coalesce(x["role"] == "assistant", F.lit(False))).alias("target"), x["cost"].alias("cost"))

    def window(s: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("starts", k + 1)["at"], F.size("turns"))
        lead = F.when((k > 0) & F.col("system").isNotNull(), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        old = F.concat(lead, F.slice("turns", s["at"] - s["history"] + 1, s["history"]))
        new = F.slice("turns", s["at"] + 1, upto - s["at"])
        return F.struct(k.alias("window"), F.concat(F.transform(old, lambda x: piece(x, True)), F.transform(new, lambda x: piece(x, False))).alias("pieces"))

    w = c.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")

    def spans(acc: Column, p: Column) -> Column:
        start = (acc["at"] + F.length(p["head"])).cast("int")
        size = F.length(p["body"]).cast("int")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END)).cast("int").alias("at"), F.when(p["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return w.select(
        "conv_id",
        "window",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["cost"]).alias("n_tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.aggregate("pieces", none, spans, lambda a: a["loss"]).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_text): the turns that are not repeats, as they were, and the text under the mask."""
    parts = F.filter(F.split("text", END), lambda x: x != "")
    head = r"(?s)^<turn (\d+) (new|old) ([^>]*)>(.*)$"

    def turn(x: Column) -> Column:
        group = lambda k: F.regexp_extract(x, head, k)
        return F.when(group(2) == "new", F.struct(group(1).cast("int").alias("n"), role_of(group(3)).alias("role"), unescape(group(4)).alias("text")))

    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", F.array_compact(F.transform(parts, turn)).alias("turns"), masked.alias("loss_text"), F.length("text").cast("long").alias("n_chars"))


def chat_digests(conversations: DataFrame, **options) -> DataFrame:
    """What the formatted windows hold, read back: a row for every conversation."""
    r = read_turns(format_windows(conversations, **options))
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("ws"), F.sum("n_chars").alias("formatted_chars"))
    turns = F.flatten(F.col("ws.turns"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("ws.loss_text"), "")
    return g.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
