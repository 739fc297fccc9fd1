"""Chat formatting in DataFrame functions alone.

A finite-state machine over the roles validates the order of turns; a declarative
template turns every turn into text segments with loss flags. Control strings inside
texts and roles are escaped, so that the formatted text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a text, the names of roles, and what the roles may follow.

    open + name + colon + text + close is one turn. escapes pairs a control string with
    the code that stands for it inside texts and names; the first pair must be the
    escape character itself, and each code that character and another letter.
    """

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    other: str = "role="
    learned: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
    name_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    #: state -> role -> state; what is not listed is an error.
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepted: tuple[str, ...] = ("asked", "answered")


def _literal(text: str) -> Column:
    return F.lit(text)


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in pairs:
        text = F.replace(text, _literal(plain), _literal(code))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, _literal(code), _literal(plain))
    return text


def _name(role: Column, t: Template) -> Column:
    pairs = (*t.escapes, *t.name_escapes)
    name = F.concat(F.lit(t.other), escape(role, pairs))
    for known, shown in t.names.items():
        name = F.when(role == known, F.lit(shown)).otherwise(name)
    return name


def _role(name: Column, t: Template) -> Column:
    pairs = (*t.escapes, *t.name_escapes)
    role = unescape(F.substr(name, F.lit(len(t.other) + 1)), pairs)
    for known, shown in t.names.items():
        role = F.when(name == shown, F.lit(known)).otherwise(role)
    return role


def _step(state: Column, role: Column, t: Template) -> Column:
    after = F.lit("error")
    for here, moves in t.turns.items():
        for on, there in moves.items():
            after = F.when((state == here) & (role == on), F.lit(there)).otherwise(after)
    return after


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, formatted, segments (text, loss), state, valid, error_turn.

    Turns go by turn (null last), then role, then text; repeated rows stay. Null roles
    and texts are empty ones. Every conversation is formatted; valid says whether the
    machine accepts it, error_turn is the first turn (from 1) it refuses, else null.
    A null conv_id is a conversation of its own. Other columns are not looked at. One
    conversation is one value, so it has to fit in a task; no group of them does.
    """
    t = template or Template()
    turn = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda x: F.array(
            F.struct(
                F.concat(F.lit(t.open), _name(x["role"], t), F.lit(t.colon)).alias("text"),
                F.lit(False).alias("loss"),
            ),
            F.struct(
                escape(x["text"], t.escapes).alias("text"), x["role"].isin(*t.learned).alias("loss")
            ),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        ),
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("error"))

    def move(acc: Column, x: Column) -> Column:
        state = _step(acc["state"], x["role"], t)
        seen = acc["seen"] + 1
        error = F.when(acc["error"].isNull() & (state == "error"), seen).otherwise(acc["error"])
        return F.struct(state.alias("state"), seen.alias("seen"), error.alias("error"))

    checked = turns.select(
        "conv_id", F.flatten(parts).alias("segments"), F.aggregate("turns", start, move).alias("end")
    )
    return checked.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("end.state").alias("state"),
        F.col("end.state").isin(*t.accepted).alias("valid"),
        F.col("end.error").alias("error_turn"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    t = template or Template()
    blocks = F.split(formatted, rf"\Q{t.close}\E")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def parse(block: Column) -> Column:
        end = F.position(F.lit(t.colon), block)
        name = F.substr(block, F.lit(len(t.open) + 1), end - 1 - len(t.open))
        text = F.substr(block, end + len(t.colon))
        return F.struct(_role(name, t).alias("role"), unescape(text, t.escapes).alias("text"))

    return F.transform(blocks, parse)


def report(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    t = template or Template()
    out = format_conversations(conversations, t)
    read = out.withColumn("turns", read_back(F.col("formatted"), t)).withColumn(
        "learned",
        F.array_join(
            F.transform(
                F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t.escapes)
            ),
            "",
        ),
    )
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
