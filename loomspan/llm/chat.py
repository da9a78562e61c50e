"""Chat formatting whose output reads back to its source, by DataFrame functions only.

The grammar: a conversation is a run of turns, and a turn is

    <s>[INST] role [/INST] text </s>        (without the blanks)

so the control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. The
parser is deterministic: it splits at ``</s>``, wants ``<s>[INST]`` at the begin of
each part, and takes what stands before and after the first ``[/INST]``. In what
it takes, a bracket, one or more backslashes and the rest of a control string
lose one backslash.

Each conversation is rendered as it is and parsed again. Where the turns that
come back are not those of the source, its contents are escaped (a control
string, with any number of backslashes after its bracket, gets one more) and the
text is rendered and parsed anew, until both are identical; a conversation that
still differs after ROUNDS rounds fails the job, which cannot happen: escaped
contents hold no control string, none can begin in them and end outside, and
taking one backslash away undoes the escape.

The loss mask has the length of each segment of the text, in code points, and
whether it is under loss: the texts of ``assistant`` turns are, nothing else is.

A conversation's text is one value, so its turns meet in one task; its digest
needs them there in any case.

Defined cases: null texts and roles are empty; turns are ordered by ``turn``
(null first), then role and text, and repeated rows are turns of their own; rows with a null
conversation id are one conversation; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"/?(?:s>|INST\])"
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{CONTROL})", r"$1$2")


def _head(role: Column) -> Column:
    return F.concat(F.lit(BOS + OPEN), role, F.lit(CLOSE))


def render(turns: Column) -> Column:
    """The text of an array of turns (role, text)."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(EOS))))


def parse(text: Column) -> Column:
    """The turns of a text; null where it does not follow the grammar."""
    parts = F.split(text, EOS, -1)
    begin = len(BOS + OPEN)

    def turn(p: Column) -> Column:
        at = F.position(F.lit(CLOSE), p)
        good = F.startswith(p, F.lit(BOS + OPEN)) & (at > 0)
        role = F.substr(p, F.lit(begin + 1), at - 1 - begin)
        rest = F.substr(p, at + len(CLOSE))
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(rest).alias("text")))

    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
    return F.when((F.element_at(parts, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, mask, rounds``: a row for each conversation.

    ``mask`` is an array of (length, loss), one after the other over the text;
    ``rounds`` tells how often the contents were escaped (0 or 1).
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    out = convs.select("conv_id", "source", F.col("source").alias("turns"), F.lit(0).alias("rounds")).withColumn("formatted", render(F.col("turns")))
    for n in range(1, ROUNDS):
        same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
        escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
        out = out.withColumn("same", same)
        out = out.withColumn("rounds", F.when(F.col("same"), F.col("rounds")).otherwise(n)).withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(escaped))
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("turns")))).drop("same")
    sure = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    out = out.withColumn("formatted", F.when(sure, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back to its source"))))

    def segments(t: Column) -> Column:
        size = lambda c: F.length(c).cast("long")
        no = F.lit(False)
        return F.array(
            F.struct(size(_head(t["role"])).alias("length"), no.alias("loss")),
            F.struct(size(t["text"]).alias("length"), (unescape(t["role"]) == loss_role).alias("loss")),
            F.struct(F.lit(len(EOS)).cast("long").alias("length"), no.alias("loss")),
        )

    return out.select("conv_id", "formatted", F.flatten(F.transform("turns", segments)).alias("mask"), "rounds")


def under_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped: one string for each segment that is under loss, in order.

    The text is cut into turns first, so that no segment is counted off from the begin of the
    whole; a turn takes three segments of the mask, and their lengths must be the turn's.
    """
    parts = F.split(formatted, EOS, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def cut(part: Column, i: Column) -> Column:
        head, text, end = (F.try_element_at(mask, i * 3 + n) for n in (1, 2, 3))
        fits = (F.length(part) == head["length"] + text["length"]) & (end["length"] == len(EOS)) & ~head["loss"] & ~end["loss"]
        own = F.when(text["loss"], unescape(F.substr(part, head["length"].cast("int") + 1, text["length"].cast("int"))))
        return F.when(fits, F.struct(own.alias("text"))).otherwise(F.raise_error(F.lit("a mask does not fit its text")))

    cuts = F.transform(turns, cut)
    whole = F.when(F.size(mask) == F.size(turns) * 3, cuts).otherwise(F.raise_error(F.lit("a mask does not fit its text")))
    return F.transform(F.filter(whole, lambda x: x["text"].isNotNull()), lambda x: x["text"])


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the contract, read back from the text: turns by the parser, the loss by the mask."""
    turns = F.col("turns")
    lines = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    whole = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    out = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", F.concat_ws("", under_loss(F.col("formatted"), F.col("mask"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        whole.alias("mask_chars"),
        F.col("rounds").cast("long").alias("rounds"),
    )
