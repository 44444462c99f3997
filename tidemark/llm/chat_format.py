"""Chat formatting: a finite-state machine over roles and a declarative template.

Built from DataFrame functions only. A conversation's rows are put in order of turn, the machine runs over
their roles, and the template turns each into segments of text with a loss flag. Joined, the segments are the
formatted conversation.

The template has an opening and a closing mark for each role, and one for roles it does not know, which names
them. Inside texts and names a backslash is put after the first character of every control string and before
every backslash, so that no control string is left in them; taking each backslash away and keeping the
character after it gives the text back. ``read_back`` recovers roles, texts and what is under the loss mask
from the output alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    name: str
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the marks around a turn of any other role, and which role may follow which ("" is the start).

    All opening marks must differ, no mark may begin with the end of a control string, and a control string
    may not be within another mark. ``final`` names the roles with which a conversation may end.
    """

    roles: tuple[Role, ...]
    other: tuple[str, str, str]
    control: tuple[str, ...]
    follows: dict[str, tuple[str, ...]]
    final: tuple[str, ...]


# Marks of the instruction format that the control strings are from.
INSTRUCT = Template(
    roles=(Role("system", "<<SYS>>\n", "\n<</SYS>>\n"), Role("user", "<s>[INST] ", " [/INST]"), Role("assistant", " <<OUT>>", " </s>", True)),
    other=("<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    control=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<<OUT>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _any_of(strings) -> str:
    return "|".join(re.sub(r"([\[\]\\^$.|?*+(){}])", r"\\\1", s) for s in sorted(strings, key=lambda s: (-len(s), s)))


def escape(c: Column, t: Template) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    rest = {s: s[1:] for s in t.control}
    for s, tail in sorted(rest.items(), key=lambda x: (-len(x[0]), x[0])):
        doubled = F.replace(doubled, F.lit(s), F.lit(s[0] + "\\" + tail))
    return doubled


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, segments, formatted, valid, bad_turns.

    segments is an array of text and loss; formatted is their texts joined. valid tells whether the machine went
    from the start to a final role; bad_turns counts the turns that may not follow the one before.

    * A null text is an empty text, a null role the role named "". Roles that the template does not know are
      marked by name, carry no loss, and are never valid.
    * Rows are in order of turn, null first; rows of the same turn by role, then text, all of them kept.
    * A null conv_id is a conversation of its own. Other columns are not looked at. An empty table gives an empty result.
    """
    t = template
    kinds = [F.coalesce(F.col(c).cast(k), F.lit("")) if k == "string" else F.col(c).cast(k) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"))]
    turn = F.struct(*[c.alias(n) for c, n in zip(kinds, ("turn", "role", "text"), strict=True)])
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def marks(x: Column) -> Column:
        mark, end, close = t.other
        out = F.struct(F.concat(F.lit(mark), escape(x["role"], t), F.lit(end)).alias("open"), F.lit(close).alias("close"), F.lit(False).alias("loss"))
        for r in t.roles:
            out = F.when(x["role"] == r.name, F.struct(F.lit(r.open).alias("open"), F.lit(r.close).alias("close"), F.lit(r.loss).alias("loss"))).otherwise(out)
        return out

    def segments(x: Column) -> Column:
        m = marks(x)
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(m["open"], F.lit(False)), piece(escape(x["text"], t), m["loss"]), piece(m["close"], F.lit(False)))

    def step(state: Column, x: Column) -> Column:
        ok = reduce(lambda a, b: a | b, [(state["at"] == a) & x["role"].isin(list(to)) for a, to in t.follows.items()])
        return F.struct(x["role"].alias("at"), (state["bad"] + F.when(ok, 0).otherwise(1)).alias("bad"))

    run = F.aggregate("turns", F.struct(F.lit("").alias("at"), F.lit(0).alias("bad")), step)
    out = grouped.withColumn("run", run).withColumn("segments", F.flatten(F.transform("turns", segments)))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("run.bad") == 0) & F.col("run.at").isin(list(t.final))).alias("valid"),
        F.col("run.bad").cast("long").alias("bad_turns"),
    )


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``formatted`` with turns (array of role and text) and loss_texts, recovered from its output columns."""
    t = template
    mark, end, close = t.other
    whole = [f"{_any_of([r.open])}.*?{_any_of([r.close])}" for r in t.roles] + [f"{_any_of([mark])}.*?{_any_of([close])}"]
    pieces = F.regexp_extract_all("formatted", F.lit("(?s)" + "|".join(whole)), F.lit(0))

    def inside(x: Column, before: str, after: str) -> Column:
        return F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))

    def turn(x: Column) -> Column:
        named = inside(x, mark, close)
        at = F.instr(named, end)
        role, text = F.substr(named, F.lit(1), at - 1), F.substr(named, at + len(end), F.length(named))
        out = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        for r in t.roles:
            out = F.when(F.startswith(x, F.lit(r.open)), F.struct(F.lit(r.name).alias("role"), unescape(inside(x, r.open, r.close)).alias("text"))).otherwise(out)
        return out

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", loss)
