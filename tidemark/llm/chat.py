"""Chat formatting: typed content parts flattened to text with ordered placeholders, attachments, token counts and a loss mask.

A turn's content is a list of typed parts ``struct(kind, text, ref, units)``. A visitor takes each kind its own way: text is escaped;
image, audio and document parts become a placeholder ``<kind:turn.part>`` (both counted from 1), give an attachment (placeholder, kind,
reference) and count ``units`` times the kind's tokens per unit. Parts of any other kind are treated as text.

A conversation is the concatenation of ``### role: content</turn>\\n`` over its turns. Inside texts the backslash and every character
that opens a control string are written as two characters (``\\\\``, ``\\l`` for ``<``, ``\\h`` for ``#``; in roles also ``\\c`` for the
colon), so a text never holds a mark, and unescaping gives it back. The loss mask is the list of code point spans of assistant contents.

Null texts and roles are empty, null units and references none. Turns are ordered by number, then role, then content, so that ties and
repeated rows have one order; null numbers come first, and rows without conv_id are one conversation. An empty table gives no rows.
Everything is DataFrame functions; a conversation is one output row, so its turns do meet in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
CODES = {"<": "\\l", "#": "\\h"}
ROLE_CODES = {**CODES, ":": "\\c"}


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, code in codes.items():
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, codes: dict[str, str] = ROLE_CODES) -> Column:
    """Codes are put back between escaped backslashes, which come in pairs from the left."""
    def plain(piece: Column) -> Column:
        for char, code in codes.items():
            piece = F.replace(piece, F.lit(code), F.lit(char))
        return piece
    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), "\\")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def placeholder(turn: Column, part: Column, kind: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit(":"), (turn + 1).cast("string"), F.lit("."), (part + 1).cast("string"), F.lit(">"))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*TOKENS_PER_UNIT), F.lit(False))


def visit(part: Column, turn: Column, place: Column) -> Column:
    """struct(text, attachments, tokens) of one part."""
    mark = placeholder(turn, place, part["kind"])
    kind = "array<struct<placeholder: string, kind: string, ref: string>>"
    per_unit = F.create_map(*(F.lit(x) for item in TOKENS_PER_UNIT.items() for x in item))
    return F.struct(
        F.when(is_attachment(part), mark).otherwise(escape(part["text"])).alias("text"),
        F.when(is_attachment(part), F.array(F.struct(mark.alias("placeholder"), part["kind"].alias("kind"), part["ref"].alias("ref")))).otherwise(F.array()).cast(kind).alias("attachments"),
        F.when(is_attachment(part), F.coalesce(part["units"], F.lit(0)).cast("bigint") * per_unit[part["kind"]]).otherwise(F.lit(0)).cast("bigint").alias("tokens"))


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments, attachment_tokens, n_turns)`` from rows ``(conv_id, turn, role, parts)``."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array()).alias("parts")))).alias("turns"))
    seen = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.transform(t["parts"], lambda p, j: visit(p, i, j)).alias("parts")))
    head = lambda t: F.concat(F.lit(BEGIN), escape(t["role"], ROLE_CODES), F.lit(MIDDLE))
    body = lambda t: F.array_join(F.transform(t["parts"], lambda p: p["text"]), "")
    flat = rows.select("conv_id", seen.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), body(t).alias("body"), t["parts"].alias("parts"))).alias("turns"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct((end + len(END)).cast("bigint").alias("at"), F.when(t["role"] == assistant, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    parts = F.flatten(F.transform("turns", lambda t: t["parts"]))
    return flat.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
                       F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"),
                       F.flatten(F.transform(parts, lambda p: p["attachments"])).alias("attachments"),
                       F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("attachment_tokens"), F.size("turns").cast("bigint").alias("n_turns"))


def read_turns(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    at = lambda p: F.instr(p, F.lit(MIDDLE))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(len(BEGIN) + 1), at(p) - 1 - len(BEGIN))).alias("role"), unescape(F.substring(p, at(p) + len(MIDDLE), F.length(p)), CODES).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), CODES)), "")
