"""Chat formatting with typed content parts.

A message is an array of parts (kind text, image, audio or document). A visitor, one branch a kind, flattens each part in order:
text is escaped, every other part becomes a placeholder that names the attachment by its place in the conversation; the
reference and the number of model tokens it expands to are kept beside the text. All of it is column expressions.

Template: <|im_start|>role\\ntext<|im_end|>\\n for each turn. Escapes: & to &amp;, then <| to &lt;| (in roles also line feeds to
&#10;), so control strings never occur inside a turn and reading back is exact.
Null roles, texts, kinds and parts count as empty text; rows of one turn number keep the order role, text. A conversation without rows does not
exist; an empty table gives no rows. One conversation is one output string, so its turns meet in one task by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"

#: What one unit of an attachment costs: pixels a side of an image patch, milliseconds an audio frame, tokens a page.
PATCH, FRAME_MS, PAGE_TOKENS = 28, 80, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "bigint"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *none))


def part_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text, at least 1 for an attachment."""
    up = lambda a, b: F.ceil(F.coalesce(a, F.lit(0)) / b)
    n = F.when(p["kind"] == "image", up(p["width"], PATCH) * up(p["height"], PATCH)).when(p["kind"] == "audio", up(p["millis"], FRAME_MS)).when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
    return F.when(is_attachment(p), F.greatest(F.lit(1), F.coalesce(n, F.lit(0)))).otherwise(0).cast("long")


def is_attachment(p: Column) -> Column:
    return F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))


def visit(parts: Column, first: Column) -> Column:
    """Body of a message: parts in order, attachments numbered from `first`."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    step = lambda a, p: F.struct(
        F.concat(
            a["body"],
            F.when(is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), a["n"].cast("string"), F.lit("|>"))).otherwise(escaped(p["text"])),
        ).alias("body"),
        (a["n"] + is_attachment(p).cast("int")).alias("n"),
    )
    return F.aggregate(parts, F.struct(F.lit("").alias("body"), first.cast("int").alias("n")), step, lambda a: a["body"])


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points of `formatted`, one for each assistant turn),
    attachments (n, kind, ref, tokens), expanded_tokens."""
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    # what stands before a turn, as running sums over its conversation: attachments, then characters
    first = F.coalesce(F.sum(F.size(F.filter("parts", is_attachment))).over(before), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("first", first)
    rows = rows.withColumn("head", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))).withColumn("body", visit(F.col("parts"), F.col("first")))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + F.length("head"))
    seen = F.transform(F.filter("parts", is_attachment), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    t = F.struct(
        "at", F.concat("head", "body", F.lit(END)).alias("block"), (F.col("role") == "assistant").alias("loss"), F.col("start").cast("int").alias("start"), F.length("body").alias("length"), seen.alias("seen")
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns")).withColumn("seen", F.flatten("turns.seen"))
    return convs.select(
        "conv_id",
        F.array_join("turns.block", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.transform("seen", lambda p, i: F.struct(i.alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation without attachments."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turn(b: Column) -> Column:
        b = F.substr(b, F.lit(len(START) + 1))
        cut = F.locate("\n", b)
        return F.struct(_role_back(F.substr(b, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(b, cut + 1)).alias("text"))

    return F.transform(blocks, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")
