"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Template: a user turn is `[INST] text [/INST]`, an assistant turn `text</s>`, any other turn `[ROLE role] text [/ROLE]`.
Inside roles and texts a backslash is doubled and every control string is broken by a backslash after its first character, which
unescaping reverses exactly. Defined results: a null text or role is empty (an empty role is one of the others); turns stand by
turn (null first), role, text, so repeated rows are repeated turns; null conv_ids are one conversation; a very long conversation
is one text, whose size is its own, and as many examples as it has replies; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
USER_OPEN, USER_CLOSE, REPLY_CLOSE, ROLE_OPEN, ROLE_MID, ROLE_CLOSE = "[INST] ", " [/INST]", "</s>", "[ROLE ", "] ", " [/ROLE]"
_CONTROL = r"([\[<])(?=INST\]|/INST\]|/?s>|ROLE |/ROLE\])"
#: A formatted turn, closed by the first unescaped closing string.
_TURN = r"(?s)\[INST\] .*? \[/INST\]|\[ROLE .*? \[/ROLE\]|.*?</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, role, segment, start, end, trainable): each turn's place in its conversation's formatted text (code points).

    A reply is trainable; its loss span is [start, end) without the closing string.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    safe = escape(F.col("text"))
    # In a role, spaces and brackets are given by code so that the role ends at the first bracket.
    name = F.regexp_replace(F.regexp_replace(escape(F.col("role")), "~", "~0"), r"\]", "~1")
    segment = F.when(F.col("role") == "user", F.concat(F.lit(USER_OPEN), safe, F.lit(USER_CLOSE))).when(F.col("role") == "assistant", F.concat(safe, F.lit(REPLY_CLOSE))).otherwise(F.concat(F.lit(ROLE_OPEN), name, F.lit(ROLE_MID), safe, F.lit(ROLE_CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("segment", segment).withColumn("size", F.char_length("segment").cast("long"))
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    trainable = F.col("role") == "assistant"
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("stop", stop)
    return rows.select("conv_id", "at", "role", "segment", (F.col("stop") - F.col("size")).alias("start"), F.when(trainable, F.col("stop") - len(REPLY_CLOSE)).otherwise(F.col("stop")).alias("end"), trainable.alias("trainable"))


def conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): each conversation's text and its turns in order.

    A conversation's own text has to be in one place to be printed or hashed; nothing larger is gathered.
    """
    turn = F.struct("at", "segment", "start", "end", "trainable")
    packed = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return packed.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), "turns")


def examples(convs: DataFrame) -> DataFrame:
    """(conv_id, example, context_end, target_start, target_end, target, formatted): prefix-target expansion of conversations().

    Every assistant turn is exploded into an example of its own. Its context is the conversation's formatted text up to
    context_end, all turns before; its target, the only part that bears loss, is the reply as formatted, without the closing string.
    The context is referred to, not copied, since the copies of n turns would take n * n / 2 turns' space: `formatted` stands
    in a conversation's first example, and render() makes the copies. A conversation without a reply is one row without example.
    """
    replies = F.filter("turns", lambda t: t["trainable"])
    rows = convs.select("conv_id", "formatted", F.posexplode_outer(replies).alias("i", "t"))
    start, end = F.col("t.start"), F.col("t.end")
    target = F.expr(f"left(t.segment, char_length(t.segment) - {len(REPLY_CLOSE)})")
    return rows.select("conv_id", (F.col("i") + 1).alias("example"), start.alias("context_end"), start.alias("target_start"), end.alias("target_end"), target.alias("target"), F.when(F.coalesce("i", F.lit(0)) == 0, F.col("formatted")).alias("formatted"))


def assembled(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): examples() brought back by conversation, loss being array<struct<start,end,target>> in order.

    The rows are still dealt by conversation, so this costs no shuffle.
    """
    span = F.when(F.col("example").isNotNull(), F.struct("example", F.col("target_start").alias("start"), F.col("target_end").alias("end"), "target"))
    got = rows.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), F.array_sort(F.collect_list(span)).alias("spans"))
    return got.select("conv_id", "formatted", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["target"].alias("target"))).alias("loss"))


def render(convs: DataFrame) -> DataFrame:
    """(conv_id, example, prompt, target): examples() with their contexts copied, for those who want whole prompts."""
    whole = convs.select(F.col("conv_id").alias("of"), "formatted")
    rows = examples(convs).where("example is not null").drop("formatted")
    return rows.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "example", F.expr("left(formatted, cast(context_end as int))").alias("prompt"), "target")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, turns array<struct<role,text>>) parsed from the formatted text alone."""

    def parsed(seg: Column) -> Column:
        is_user = seg.startswith(USER_OPEN) & seg.endswith(USER_CLOSE)
        is_role = seg.startswith(ROLE_OPEN) & seg.endswith(ROLE_CLOSE)
        inner = lambda a, b: F.substring(seg, F.lit(a + 1), F.char_length(seg) - F.lit(a + b))
        name = F.regexp_extract(seg, r"(?s)^\[ROLE ([^\]]*)\] ", 1)
        role = F.when(is_user, "user").when(is_role, unescape(F.regexp_replace(F.regexp_replace(name, "~1", "]"), "~0", "~"))).otherwise("assistant")
        body = F.when(is_user, inner(len(USER_OPEN), len(USER_CLOSE))).when(is_role, F.substring(seg, F.char_length(name) + F.lit(len(ROLE_OPEN) + len(ROLE_MID) + 1), F.char_length(seg) - F.char_length(name) - F.lit(len(ROLE_OPEN) + len(ROLE_MID) + len(ROLE_CLOSE)))).otherwise(inner(0, len(REPLY_CLOSE)))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return formatted.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), parsed))


def digests(convs: DataFrame) -> DataFrame:
    """The query's columns, from the example rows of conversations(): turns read back from the printed text, loss from the targets."""
    rows = read_back(assembled(examples(convs)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(s["target"])), "")
    rows = rows.withColumn("learnt", learnt)
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
