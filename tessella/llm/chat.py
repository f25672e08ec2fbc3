r"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

The log is partitioned by conversation and sorted by sequence number; the streamed deltas, edits and regenerations
of each message fold into its final text, and the final messages are rendered with a template:

    <|im_start|>role\ntext<|im_end|>\n

Control strings inside texts are escaped reversibly: between ``<`` and ``|`` (with any backslashes that already
stand between them) one more backslash is put, so that ``<|`` appears in the output as control only; reading back
takes one backslash away. A role is escaped alike, and its line feeds are written ``\n`` and backslashes ``\\``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
EVENTS = ("delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    r"""``\\`` stands for a backslash and ``\n`` for a line feed; a private mark keeps the two apart."""
    plain, mark = unescape(role), ""
    shielded = F.replace(F.replace(plain, F.lit(mark), F.lit(mark + "0")), F.lit("\\\\"), F.lit(mark + "1"))
    lines = F.replace(shielded, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit(mark + "1"), F.lit("\\")), F.lit(mark + "0"), F.lit(mark))


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text): for each row, by turn, one message of
    one delta. Rows of one turn go by role and text; a null text is empty, a null role too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id",
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.row_number().over(order).cast("bigint").alias("message"),
        F.lit("delta").alias("event"),
        "role",
        "text",
    )


#: Events that ``streamed`` makes of one message, and characters of a draft.
STEPS, DRAFT = 8, 20


def streamed(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """The log as a client would have sent it, of one that has a delta for each message: texts arrive in two parts; a
    message of ``trained`` is drafted, followed by the beginning of an answer to the draft, and regenerated; any other
    is drafted and edited. Folding it gives what folding ``events`` gives."""
    text, role, none = F.col("text"), F.col("role"), F.lit(None).cast("string")
    half = (F.char_length("text") / 2).cast("int")
    draft, first, second = F.left(text, F.lit(DRAFT)), F.left(text, half), F.expr("substring(text, cast(char_length(text) / 2 as int) + 1)")

    def step(k: int, event: str, text: Column, role: Column = none, later: int = 0) -> Column:
        return F.struct(
            (F.col("seq") * STEPS + k).alias("seq"), (F.col("message") + later).alias("message"),
            F.lit(event).alias("event"), role.alias("role"), text.alias("text"),
        )

    made = F.when(
        role == trained,
        F.array(
            step(0, "delta", draft, role), step(1, "delta", draft, F.lit("user"), 1), step(2, "regenerate", F.lit(""), role),
            step(3, "delta", first), step(4, "delta", second),
        ),
    ).otherwise(F.array(step(0, "delta", draft, role), step(1, "edit", first), step(2, "delta", second)))
    return events.select("conv_id", F.explode(made).alias("e")).select("conv_id", "e.*")


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, event, role, text).

    Events apply by seq (null first; of one number by event, text and role). ``delta`` appends to a message, ``edit``
    replaces its text, ``regenerate`` starts it anew and discards what later messages have had so far: events that come
    after it begin these messages again. A message without events left isn't there. Unknown or null events change
    nothing; a null text is empty; the role is that of the last event that counts and has one. A null conv_id is a
    conversation of its own. Repeated events apply repeatedly.

    The fold runs on each message by itself, and only the last regeneration of each message meets those of its
    conversation, so a long conversation is no single group of events.
    """
    known = events.where(F.col("event").isin(*EVENTS)).select(
        "conv_id", "message", F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e")
    )
    when = F.struct("e.seq", "e.event", "e.text")
    folded = known.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list("e")).alias("log"),
        F.max(F.when(F.col("e.event") == "regenerate", when)).alias("regenerated"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    cut = folded.withColumn("cut", F.max("regenerated").over(earlier))
    alive = F.when(F.col("cut").isNull(), F.col("log")).otherwise(
        F.filter("log", lambda e: F.struct(e["seq"].alias("seq"), e["event"].alias("event"), e["text"].alias("text")) >= F.col("cut"))
    )
    live = cut.select("conv_id", "message", alive.alias("log")).where(F.size("log") > 0)
    resets = F.transform("log", lambda e, k: F.when(e["event"] != "delta", k))
    live = live.withColumn("from", F.coalesce(F.array_max(resets), F.lit(0)) + 1)
    live = live.withColumn("parts", F.slice("log", F.col("from"), F.size("log")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return live.select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform("parts", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, and loss_mask, an array of (start, end) in code points
    of ``formatted``, end exclusive: the escaped texts of ``trained`` turns, in order.

    A null role or text is empty, a null conv_id a conversation of its own; rows of one message go by role and text;
    other columns are ignored. Offsets are running sums over the conversation; its turns are then put together."""
    messages = messages.select("conv_id", "message", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("piece")
    placed = messages.select("conv_id", "message", "role", "text", piece.alias("piece")).withColumn(
        "at", F.coalesce(F.sum(size).over(before), F.lit(0))
    )
    end = F.col("at") + size - len(END)
    turn = F.struct(
        "at",
        "piece",
        F.when(F.col("role") == trained, F.struct((end - F.char_length(escape(F.col("text")))).alias("start"), end.alias("end"))).alias("span"),
    )
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads back what ``render`` wrote: conv_id, turns (array of pos, role, text, loss; loss is the text under the
    mask, null outside it).

    Control strings stand in the output as control only, so splitting at them gives the turns; the mask meets them by
    offset, each turn being cut by itself and not from the start of a long conversation. Needs one row for each conv_id
    (null is one); a null or empty text has no turns and gives no row; other columns are ignored."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    order = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        formatted.select("conv_id", F.posexplode(pieces).alias("pos", "piece"))
        .withColumn("head", F.substring_index("piece", "\n", 1))
        .withColumn("at", F.coalesce(F.sum(F.char_length("piece") + len(START)).over(order), F.lit(0)))
        .withColumn("from", F.char_length("head") + 1)
        .withColumn("start", F.col("at") + len(START) + F.col("from"))
        .withColumn("body", F.expr(f"substring(piece, from + 1, char_length(piece) - from - {len(END)})"))
    )
    mask = formatted.select(F.col("conv_id").alias("of"), F.explode("loss_mask").alias("m")).select("of", "m.*")
    joined = rows.join(
        mask.withColumnRenamed("start", "mask_start"),
        F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("mask_start")),
        "left",
    )
    turn = F.struct(
        "pos",
        unescape_role(F.col("head")).alias("role"),
        unescape(F.col("body")).alias("text"),
        F.when(F.col("end").isNotNull(), unescape(F.expr("substring(body, 1, end - start)"))).alias("loss"),
    )
    return joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
