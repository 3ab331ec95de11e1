"""Chat formatting with typed content parts, by DataFrame functions alone.

A turn is a role and an array of parts, struct<kind string, text string, ref string, units long>. A visitor
flattens the parts in order: text is escaped, and each image, audio or document part becomes a placeholder
``<kind:i>`` (i is the place of the part in its turn) and an entry of ``attachments`` (the reference, and the tokens
it expands to). Parts stand on lines of their own. A formatted turn is::

    <turn>role
    text
    </turn>

A control string inside a text gets one backslash more in front than it had. No mark of the template follows a
backslash, so taking one away from each escaped control string gives the text back exactly. Roles escape backslash
and line feed. The loss mask covers the texts of the roles in ``LEARNED``, without the marks around them: a flag for each
turn, and the characters [begin, end) of each learned text in the formatted conversation.

Null text is empty, a null role is the empty role, an unknown kind of part is text. Rows of one conversation are
ordered by turn, then role, then text (nulls first), and repeated rows are repeated turns. A null conv_id is a
conversation of its own, as in any grouping. Turns of a conversation are first gathered by ranges of turns, so that
one huge conversation is formatted by many tasks and only its finished pieces meet. A formatted conversation is one
value, so it must fit into one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "\n</turn>\n"
#: What a text may not hold unescaped.
CONTROL = r"</?turn>|<(?:image|audio|document):\d+>"
#: Turns of a conversation that one task formats together.
RANGE = 64
#: Tokens for each unit of an attachment: image tiles, seconds of audio, pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
LEARNED = ("assistant",)
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is only text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def is_attachment(part: Column) -> Column:
    return part["kind"].isin(*TOKENS_PER_UNIT)


def flatten_text(parts: Column) -> Column:
    """The visitor: every part in order, as escaped text or as a placeholder."""
    place = lambda p, i: F.concat(F.lit("<"), p["kind"], F.lit(":"), (i + 1).cast("string"), F.lit(">"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(is_attachment(p), place(p, i)).otherwise(escape(p["text"]))), "\n")


def flatten_attachments(parts: Column) -> Column:
    """An entry for each attachment: its place, kind, reference, and the tokens it expands to."""
    rate = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    entry = lambda p, i: F.struct(
        (i + 1).alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * rate[p["kind"]]).alias("tokens")
    )
    return F.filter(F.transform(parts, entry), is_attachment)


def format_conversations(turns: DataFrame, parts: Column) -> DataFrame:
    """One row a conversation: conv_id, formatted, attachments array<struct<turn, part, kind, ref, tokens>>, and the loss mask.

    The mask is learned array<boolean>, by turn, and loss_spans array<struct<begin, end>>, by learned turn. ``turns`` has
    conv_id, turn and role; ``parts`` gives each turn's parts. Other columns are left out.
    """
    each = turns.select(
        "conv_id",
        F.col("turn"),
        escape_role(F.col("role")).alias("role"),
        F.coalesce(flatten_text(parts), F.lit("")).alias("body"),
        F.coalesce(flatten_attachments(parts), F.expr("array()")).alias("found"),
        F.coalesce(F.col("role").isin(*LEARNED), F.lit(False)).alias("learned"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "found", "learned")))
    mark = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["body"], F.lit(CLOSE))
    of_turn = lambda t: F.transform(t["found"], lambda a: F.struct(t["turn"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    head = lambda t: F.length(t["role"]) + len(OPEN) + 1

    def spans(seen: Column, t: Column) -> Column:
        begin = seen["at"] + head(t)
        mine = F.when(t["learned"], F.array(F.struct(begin.alias("begin"), (begin + F.length(t["body"])).alias("end")))).otherwise(F.expr("array()"))
        return F.struct((begin + F.length(t["body"]) + len(CLOSE)).alias("at"), F.concat(seen["spans"], mine).alias("spans"))

    none = F.expr("struct(cast(0 as bigint) as at, cast(array() as array<struct<begin:bigint,end:bigint>>) as spans)")
    ranges = (
        each.groupBy("conv_id", F.floor(F.col("turn") / RANGE).alias("range"))
        .agg(in_order.alias("turns"))
        .select(
            "conv_id", "range", F.array_join(F.transform("turns", mark), "").alias("piece"), F.flatten(F.transform("turns", of_turn)).alias("found"),
            F.transform("turns", lambda t: t["learned"]).alias("learned"), F.aggregate("turns", none, spans)["spans"].alias("spans"),
        )
    )
    # a piece begins where those before it end; the window stands on the partitioning that the last grouping needs
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("before")).alias("begin"), (s["end"] + F.col("before")).alias("end")))
    ranges = ranges.withColumn("before", before).withColumn("spans", moved).drop("before")
    pieces = F.array_sort(F.collect_list(F.struct("range", "piece", "found", "learned", "spans")))
    return ranges.groupBy("conv_id").agg(pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.flatten(F.col("pieces.found")).alias("attachments"),
        F.flatten(F.col("pieces.learned")).alias("learned"),
        F.flatten(F.col("pieces.spans")).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array<struct<role, text>>, unescaped."""
    marked = F.filter(F.split(formatted, F.lit(CLOSE)), lambda t: t != "")
    opened = lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t))
    head = lambda t: F.substring_index(opened(t), "\n", 1)
    return F.transform(
        marked,
        lambda t: F.struct(
            unescape_role(head(t)).alias("role"),
            unescape(F.substring(opened(t), F.length(head(t)) + 2, F.length(t))).alias("text"),
        ),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """From the formatted text and its mask alone: turn count, digest of all turns, digest of the text under the loss mask."""
    back = conversations.select("conv_id", "formatted", "learned", read_back(F.col("formatted")).alias("turns"))
    under_mask = F.filter(F.arrays_zip("turns", "learned"), lambda x: x["learned"])
    loss = F.array_join(F.transform(under_mask, lambda x: x["turns"]["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
