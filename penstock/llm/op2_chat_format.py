"""Chat formatting: a finite-state machine over roles, and a declarative template that emits text segments with loss flags.

Built-in functions only. The turns of a conversation are sorted and folded once through the machine's transition table; every
turn becomes three segments (opening mark, escaped text, closing mark), and only the text of a role with `loss` counts for the loss.

Escaping is reversible and leaves no mark inside a text: a backslash becomes `\\b`, and the k-th mark becomes a backslash and the
k-th code letter. No mark may hold a backslash, and no proper end of a mark may begin a mark, so marks cannot arise where a text meets
a mark. `read_back` recovers roles and texts from the formatted string alone.

Results: turns are ordered by `turn` (null first), ties by role and then text; rows that repeat are turns of their own; a null text
or role is empty; a role that the template does not list is written, escaped, between the marks of `other`; a null `conv_id` is one
conversation. `valid` tells whether the machine accepts; `bad_turn` is the position of the first turn that it refuses (0-based; the
number of turns when the conversation only ends too early), else null. Invalid conversations are formatted as well. Only the four
columns are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import table

# The template's marks and the machine's table.
TEMPLATE = {
    "begin": "<s>",
    "end": "</s>",
    "other": {"open": "<other>", "name": "<is>", "close": "</other>", "loss": False},
    "roles": {
        "system": {"open": "<sys>", "close": "</sys>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<asst>", "close": "</asst>", "loss": True},
    },
}
MACHINE = {
    "start": "empty",
    "accept": ("answered",),
    "steps": {
        ("empty", "system"): "told",
        ("empty", "user"): "asked",
        ("told", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
}
CODES = "0123456789acdefghijklmnopqrstuvwxyz"


def marks(template: dict) -> list[str]:
    found = [template["begin"], template["end"], *(template["other"][k] for k in ("open", "name", "close"))]
    for role in template["roles"].values():
        found += [role["open"], role["close"]]
    for x in found:
        for y in found:
            if "\\" in x or not x or any(y.startswith(x[k:]) or x[k:].startswith(y) for k in range(1, len(x))) or x != y and x.startswith(y):
                raise ValueError(f"marks {x!r} and {y!r} overlap")
    if len(set(found)) != len(found) or len(found) > len(CODES):
        raise ValueError("marks must differ")
    return found


def escape(text: Column, template: dict) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for code, mark in zip(CODES, marks(template), strict=False):
        text = F.replace(text, F.lit(mark), F.lit("\\" + code))
    return text


def unescape(text: Column, template: dict) -> Column:
    for code, mark in zip(CODES, marks(template), strict=False):
        text = F.replace(text, F.lit("\\" + code), F.lit(mark))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _of_role(role: Column, template: dict, part: str) -> Column:
    other = template["other"]
    out = F.lit(other[part])
    if part == "open":
        out = F.concat(out, escape(role, template), F.lit(other["name"]))
    for name, marks_of in template["roles"].items():
        out = F.when(role == name, F.lit(marks_of[part])).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE) -> DataFrame:
    """`(conv_id, n_turns, valid, bad_turn, segments, formatted)`; segments are `(role, text, loss)`, joined they are `formatted`."""
    marks(template)
    steps = F.create_map(*[F.lit(x) for (state, role), to in machine["steps"].items() for x in (f"{state} {role}", to)])
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(steps, F.concat_ws(" ", at["state"], turn["role"]))
        bad = F.when(at["bad"].isNotNull(), at["bad"]).when(to.isNull(), at["n"])
        return F.struct(F.coalesce(to, at["state"]).alias("state"), (at["n"] + 1).alias("n"), bad.alias("bad"))

    start = F.struct(F.lit(machine["start"]).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    end = F.aggregate("turns", start, step)
    bad = F.when(end["bad"].isNotNull(), end["bad"]).when(~end["state"].isin(*machine["accept"]), end["n"])

    def pieces(t: Column) -> Column:
        part = lambda text, loss: F.struct(t["role"].alias("role"), text.alias("text"), loss.alias("loss"))
        return F.array(
            part(_of_role(t["role"], template, "open"), F.lit(False)),
            part(escape(t["text"], template), _of_role(t["role"], template, "loss")),
            part(_of_role(t["role"], template, "close"), F.lit(False)),
        )

    def edge(mark: str) -> Column:
        return F.array(F.struct(F.lit("").alias("role"), F.lit(mark).alias("text"), F.lit(False).alias("loss")))

    segments = F.concat(edge(template["begin"]), F.flatten(F.transform("turns", pieces)), edge(template["end"]))
    done = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), bad.alias("bad_turn"), segments.alias("segments"))
    return done.select(
        "conv_id", "n_turns", F.col("bad_turn").isNull().alias("valid"), "bad_turn", "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Array of `(role, text)` from a formatted conversation."""
    roles, other = template["roles"], template["other"]
    quote = lambda mark: "".join(f"\\{c}" if not c.isalnum() else c for c in mark)
    opening = "|".join([*(quote(r["open"]) for r in roles.values()), f"{quote(other['open'])}.*?{quote(other['name'])}"])
    closing = "|".join(quote(r["close"]) for r in [*roles.values(), other])
    pattern = F.lit(f"(?s)({opening})(.*?)({closing})")
    role_of = F.create_map(*[F.lit(x) for name, r in roles.items() for x in (r["open"], name)])
    named = lambda mark: F.substring(mark, F.lit(len(other["open"]) + 1), F.char_length(mark) - len(other["open"]) - len(other["name"]))
    return F.zip_with(
        F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)),
        lambda mark, text: F.struct(F.coalesce(F.try_element_at(role_of, mark), unescape(named(mark), template)).alias("role"), unescape(text, template).alias("text")),
    )


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = format_chats(given.unionByName(tricky))
    back = chats.select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("back"))
    whole = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    in_loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], TEMPLATE))
    loss = F.array_join(in_loss, "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(F.array_join(whole, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
