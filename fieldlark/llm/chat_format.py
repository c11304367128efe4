"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts: text, image, audio or document. A visitor turns each
part into text: a text part is escaped, any other becomes a numbered placeholder,
and the attachment's reference and the number of tokens that it expands to are
recorded in order.

A turn is written as ``<|turn|>role``, a line feed, its text and ``<|end|>``. In
texts and roles a backslash goes before each backslash and inside each string that
a template of this or another kind could read as control, so a reader finds the
turns again and gets every text back unchanged.

A conversation is the unit of the result, so its turns are gathered; a conversation
is one training example, and must fit in memory as its text does in any format.

Edge cases. Null texts, roles and parts count as empty. Turns are ordered by turn
(null first), then role, then text where that is their only part; repeated rows are
repeated turns. Rows with a
null conv_id form one conversation. Parts of an unknown type, and attachments
without a size, expand to one token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, END = "<|turn|>", "<|end|>"
# The first character of strings that some chat template reads as control: <|, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"


@dataclass(frozen=True)
class ChatFormat:
    """Sizes of one token: an image patch's side, tokens in a second of audio and in a page; ``learned`` are the roles in the loss."""

    patch: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 512
    learned: tuple[str, ...] = field(default=("assistant",))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column, o: ChatFormat) -> Column:
    """Tokens that an attachment stands for; 0 for text."""
    patches = F.ceil(part["width"] / o.patch) * F.ceil(part["height"] / o.patch)
    n = (
        F.when(part["type"] == "text", F.lit(0))
        .when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * o.audio_rate))
        .when(part["type"] == "document", part["pages"] * o.page_tokens)
    )
    return F.greatest(F.coalesce(n, F.lit(1)), F.when(part["type"] == "text", 0).otherwise(1)).cast("long")


def with_text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """``parts`` of one text part each, for turns that have a plain text."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
    )
    return turns.withColumn("parts", F.array(part.cast(PART)))


def chat_format(turns: DataFrame, o: ChatFormat | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens of turns (conv_id, turn, role, parts).

    ``loss_spans`` are (start, length) in UTF-8 bytes of ``formatted``: the text parts of the learned roles.

    The visitor is a window over the parts of a conversation in order: running sums number the
    attachments and place the spans, so the work grows with a conversation's length and not its square.
    """
    o = o or ChatFormat()
    rows = turns.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.size(F.col("parts")), F.lit(0)).alias("n"),
        F.posexplode_outer(F.col("parts").cast(f"array<{PART}>")).alias("at", "part"),
    ).withColumn("at", F.coalesce("at", F.lit(0)))
    is_text = F.coalesce(F.col("part.type") == "text", F.lit(True))
    single = F.when(F.col("n") <= 1, F.coalesce("part.text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", single, "row", "at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("number", F.sum(F.when(is_text, 0).otherwise(1)).over(so_far))
    rows = rows.withColumn("turn_number", F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).over(so_far) - 1)
    # A later text part begins with a backslash, so that no control string comes about where two parts meet.
    raw = escaped(F.coalesce("part.text", F.lit("")))
    later = (F.col("at") > 0) & (raw != "") & ~raw.startswith("\\")
    body = F.when(is_text, F.when(later, F.concat(F.lit("\\"), raw)).otherwise(raw)).otherwise(F.concat(F.lit("<|"), escaped(F.coalesce("part.type", F.lit(""))), F.lit(":"), F.col("number").cast("string"), F.lit("|>")))
    head = F.when(F.col("at") == 0, F.concat(F.lit(TURN), F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))).otherwise("")
    tail = F.when(F.col("at") >= F.col("n") - 1, END).otherwise("")
    rows = rows.select("conv_id", "turn", "role", "row", "at", "n", "part", "number", "turn_number", head.alias("head"), body.alias("body"), tail.alias("tail"), is_text.alias("is_text"))
    size = F.octet_length("head") + F.octet_length("body") + F.octet_length("tail")
    rows = rows.withColumns({"place": F.row_number().over(order), "before": (F.sum(size).over(so_far) - size).cast("long")})
    span = F.struct((F.col("before") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"))
    found = F.struct(
        F.col("number").cast("int").alias("number"), F.col("turn_number").cast("int").alias("turn"), F.col("part.type").alias("type"), F.col("part.ref").alias("ref"), expanded_tokens(F.col("part"), o).alias("tokens")
    )
    piece = F.struct(
        "place", F.concat("head", "body", "tail").alias("text"), F.when(F.col("is_text") & F.col("role").isin(*o.learned), span).alias("span"), F.when(~F.col("is_text"), found).alias("found")
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return convs.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.array_compact(F.transform("pieces", lambda p: p["span"])).alias("loss_spans"),
        F.array_compact(F.transform("pieces", lambda p: p["found"])).alias("attachments"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["found"]["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    whole = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    head = r"(?s)^<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(
        whole, lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text"))
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Bytes are cut out, as that needs no walk from the string's beginning."""
    cut = lambda raw: F.transform(spans, lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.transform(F.array(formatted.cast("binary")), lambda raw: F.array_join(cut(raw), ""))[0]


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of formatted conversations gets back, as counts and SHA-256 digests."""
    back, loss = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    df = formatted.select("conv_id", back.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
