"""Chat formatting with typed content parts, in DataFrame functions.

A message's content is an array of parts (text, image, audio, document).  A
visitor flattens them in order: text, joined where it is not interrupted, is escaped, every attachment becomes a
placeholder, and its reference and expanded token count are recorded.  The
template marks turns with control strings; control strings inside texts and
roles are escaped by a backslash after their first character, which reading
back removes again, so any text survives the round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

#: attachment kind -> (placeholder, tokens for each unit): units are patches of
#: an image, milliseconds of audio, pages of a document
ATTACHMENTS = {"image": ("<|image|>", 1.0), "audio": ("<|audio|>", 1 / 40), "document": ("<|document|>", 256.0)}

PART = "struct<type:string,text:string,ref:string,units:double>"

# what templates use as control strings: <|...|>, <s>, </s>, [INST], [/INST]
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A message of text only, as an array of one part (null text: empty)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (_, each) in ATTACHMENTS.items():
        out = F.when(part["type"] == kind, F.ceil(F.coalesce(part["units"], F.lit(1.0)) * each).cast("long")).otherwise(out)
    return out


def flatten(parts: Column) -> Column:
    """A message's content as one string: a visitor walks the parts, joins text
    that stands together and escapes it as one, so that no control string can
    be put together from pieces; an attachment closes the text before it and
    leaves its placeholder."""
    def visit(seen: Column, part: Column) -> Column:
        mark = F.lit(None).cast("string")
        for kind, (sign, _) in ATTACHMENTS.items():
            mark = F.when(part["type"] == kind, F.lit(sign)).otherwise(mark)
        closed = F.struct(F.concat(seen["done"], escape(seen["text"]), mark).alias("done"), F.lit("").alias("text"))
        longer = F.struct(seen["done"].alias("done"), F.concat(seen["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))
        return F.when(mark.isNotNull(), closed).otherwise(longer)

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, visit, lambda seen: F.concat(seen["done"], escape(seen["text"])))


def attachments(parts: Column) -> Column:
    """(kind, ref, tokens) of a message's attachments in order."""
    own = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["type"].isin(*ATTACHMENTS), F.lit(False)))
    return F.transform(own, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_col, formatted, loss, attachments,
    expanded_tokens``.

    ``loss`` holds (start, length), in code points of ``formatted``, of the
    content of every turn by a role in ``loss_roles``; turn markers are never
    under the mask.  ``attachments`` lists (turn, kind, ref, tokens) in order
    and ``expanded_tokens`` their token total.

    Turns are ordered by ``turn_col``; equal turns by role and content, null
    turns first; repeated rows are repeated turns.  A null role reads as empty,
    a null part type or text as empty text, null parts as no content.  Rows
    with a null conversation id form one conversation.  Offsets come from a
    running sum over sorted rows, so a long conversation costs linear time.
    An empty table gives an empty result; other columns are not read.
    """
    rows = messages.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
                           flatten(F.col(parts_col)).alias("_body"), attachments(F.col(parts_col)).alias("_att"))
    head = F.concat(F.lit(START), escape(F.col("_role")), F.lit(SEP))
    rows = rows.withColumn("_head", head).withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_body")
    size = F.length("_piece").cast("long")
    placed = (rows.withColumn("_n", F.row_number().over(order))
              .withColumn("_end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    start = F.col("_end") - size + F.length("_head")
    one = F.struct(F.col("_n").alias("n"), F.col("_piece").alias("piece"), F.col("_role").isin(*loss_roles).alias("learn"), start.alias("start"),
                   F.length("_body").cast("long").alias("length"), F.col("_att").alias("att"))
    grouped = placed.groupBy("_conv").agg(F.sort_array(F.collect_list(one)).alias("t"))
    flat = F.flatten(F.transform("t", lambda t: F.transform(t["att"], lambda a: F.struct(
        t["n"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = grouped.select(
        F.col("_conv").alias(conv_col), F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
        flat.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, read back from the formatted string."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Text under the loss mask, unescaped, as one string."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def oracle_sql() -> str:
    """Digests from the conversations themselves, in DuckDB SQL."""
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(role, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') as er,
  regexp_replace(text, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') as et from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, et)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, et) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(START) + len(SEP) + len(END)} + length(er) + length(et)) as bigint) as formatted_chars
from e group by conv_id"""
