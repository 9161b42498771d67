r"""Chat formatting, in DataFrame functions only.

A :class:`Template` declares a finite-state machine over roles, the marks around the
turns of each role, and what of them counts for the loss. The machine reads the roles of a
conversation in order: a turn for which its state has no move breaks the order, and the
machine goes on from where that role leads. With each turn it emits segments
``(text, loss)``; all segments joined are the formatted conversation.

Marks hold control strings, which no text may contain: before formatting a backslash in
a text is doubled and a control string gets a backslash after its first character, so
``[INST]`` becomes ``[\INST]``. Reading back drops the first of each two characters that begin with a
backslash. So a control string in the output is a mark, and roles and texts can be read back
from it exactly (:func:`read_back`).

Rows are grouped by conversation with the aggregate of lists, which collects what lies together before the
shuffle; a conversation is one row of the result and so one value in one task, at most 2 GB, as is its digest.

Defined results: rows go by turn, then role, then text (nulls first); a null text or
role is empty; rows without a conversation are one conversation without an id; a role that the template
doesn't know gets marks with its name, has no loss and breaks the order; repeated rows are turns of their own; an empty table
gives an empty one; other columns are neither used nor kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import let, scanned


@dataclass(frozen=True)
class Turn:
    """Marks around a text, and whether the text and the mark after it count for the loss."""

    before: str
    after: str
    loss: bool = False
    loss_after: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks for other roles (before and after the role's name, and after the text), and the machine."""

    turns: dict[str, Turn]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    moves: dict[str, dict[str, str]]
    accepting: tuple[str, ...]
    start: str = ""
    end: str = ""
    first: str = "start"
    #: Where a role leads that breaks the order.
    resume: dict[str, str] = field(default_factory=dict)

    @property
    def marks(self) -> list[str]:
        return [m for t in self.turns.values() for m in (t.before, t.after)] + list(self.other)

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"A control string has two or more characters and no backslash: {c!r}")
        for m in [m for m in (*self.marks, self.start, self.end) if m]:
            if not any(c in m for c in self.controls):
                raise ValueError(f"A mark holds no control string: {m!r}")
            for c in self.controls:
                for k in range(1, len(c)):
                    if m.endswith(c[:k]) or m.startswith(c[k:]):
                        raise ValueError(f"The mark {m!r} and text beside it could make {c!r}")
        opens = [t.before for t in self.turns.values()] + [self.other[0]]
        if len({*opens}) < len(opens) or any(a != b and b.startswith(a) for a in opens for b in opens):
            raise ValueError("Marks before turns begin alike.")


_MOVES = {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
_RESUME = {"system": "ready", "user": "asked", "assistant": "answered"}
INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"),
    moves=_MOVES,
    accepting=("answered",),
    resume=_RESUME,
)
CHATML = Template(
    turns={r: Turn(f"<|im_start|>{r}\n", "<|im_end|>\n", loss=r == "assistant") for r in ("system", "user", "assistant")},
    other=("<|im_role|>", "<|im_text|>\n", "<|im_end|>\n"),
    controls=("<|im_start|>", "<|im_end|>", "<|im_role|>", "<|im_text|>", "<|im_all|>", "<|im_over|>"),
    moves=_MOVES,
    accepting=("answered",),
    start="<|im_all|>\n",
    end="<|im_over|>",
    resume=_RESUME,
)


def escaped(text: Column, template: Template) -> Column:
    """A text without control strings, from which :func:`unescaped` makes it again."""
    # One character is taken at a time, so control strings that overlap are all met.
    broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?:{broken})", "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _choice(key: Column, values: dict[str, Column], other: Column) -> Column:
    return reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), values.items(), other)


def _segments(turn: Column, template: Template) -> Column:
    """Segments of a turn (role, text)."""
    part = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    own = {r: F.array(part(F.lit(t.before)), part(turn["text"], t.loss), part(F.lit(t.after), t.loss_after)) for r, t in template.turns.items()}
    named = F.concat(F.lit(template.other[0]), escaped(turn["role"], template), F.lit(template.other[1]))
    return _choice(turn["role"], own, F.array(part(named), part(turn["text"]), part(F.lit(template.other[2]))))


def _judged(roles: Column, template: Template) -> Column:
    """For each role, ``(ok, state)``: whether the machine has a move, and where it is then."""
    kind = "struct<ok:boolean,state:string>"
    to = lambda state, role: _choice(state, {s: _choice(role, {r: F.lit(t) for r, t in moves.items()}, F.lit(None)) for s, moves in template.moves.items()}, F.lit(None))
    back = lambda state, role: _choice(role, {r: F.lit(t) for r, t in template.resume.items()}, state)
    step = lambda state, role: F.coalesce(to(state, role), back(state, role))
    return scanned(roles, F.lit(template.first), step, lambda state, role: F.struct(to(state, role).isNotNull().alias("ok"), step(state, role).alias("state")), kind)


def format_chats(rows: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, n_turns, segments ``(text, loss)``, formatted, valid, and broken_at (the first turn that breaks the order, from 0)."""
    named = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("row"))
    each = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    judged = each.withColumn("path", _judged(F.col("turns.role"), template))
    ready = judged.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: let(F.struct(t["role"].alias("role"), escaped(t["text"], template).alias("text")), lambda e: _segments(e, template)))).alias("segments"),
        F.array_position(F.col("path.ok"), False).alias("at"),
        F.element_at("path.state", -1).alias("last"),
    )
    ends = [F.array(F.struct(F.lit(m).alias("text"), F.lit(False).alias("loss"))) for m in (template.start, template.end)]
    ready = ready.withColumn("segments", F.filter(F.concat(ends[0], "segments", ends[1]), lambda s: s["text"] != ""))
    return ready.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        ((F.col("at") == 0) & F.col("last").isin(*template.accepting)).alias("valid"),
        F.when(F.col("at") > 0, F.col("at") - 1).alias("broken_at"),
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """``array<struct<role,text>>`` of a formatted conversation: the control strings tell where turns are."""
    either = lambda marks: "|".join(re.escape(m) for m in dict.fromkeys(marks))
    opens = {t.before: r for r, t in template.turns.items()}
    afters = either([*(t.after for t in template.turns.values()), template.other[2]])
    pattern = f"(?s)(?:({either(opens)})|{re.escape(template.other[0])}(.*?){re.escape(template.other[1])})(.*?)(?:{afters})"
    found = let(formatted, lambda f: F.arrays_zip(*(F.regexp_extract_all(f, F.lit(pattern), F.lit(k)).alias(c) for k, c in ((1, "mark"), (2, "name"), (3, "text")))))
    role = lambda t: _choice(t["mark"], {m: F.lit(r) for m, r in opens.items()}, unescaped(t["name"]))
    return F.transform(found, lambda t: F.struct(role(t).alias("role"), unescaped(t["text"]).alias("text")))


def under_loss(segments: Column) -> Column:
    """The texts that count for the loss, as they were before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op13_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and a made one full of control strings, read back from the formatted texts."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    made = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(rows.unionByName(made))
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_loss(F.col("segments")).alias("loss"), "valid", "broken_at")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        F.col("broken_at").cast("bigint").alias("broken_at"),
    )


ORACLE_SQL = r"""
WITH each AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2', 'g') AS e,
         regexp_replace(replace(role, '\', '\\'), '([<\[])(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2', 'g') AS r,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'none') AS before
  FROM each
), placed AS (
  SELECT *, CASE role WHEN 'system' THEN before <> 'none' WHEN 'user' THEN before NOT IN ('none', 'system', 'assistant') WHEN 'assistant' THEN before <> 'user' ELSE true END AS broken,
         CASE role WHEN 'system' THEN '<<SYS>>' || chr(10) || e || chr(10) || '<</SYS>>' || chr(10) WHEN 'user' THEN '[INST] ' || e || ' [/INST]' WHEN 'assistant' THEN '<s>' || e || '</s>' ELSE '[ROLE] ' || r || ' [TEXT] ' || e || ' [/ROLE]' END AS f
  FROM safe
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(f))::BIGINT AS formatted_chars, count(*) FILTER (broken) = 0 AND max_by(role, place) = 'assistant' AS valid, min(place) FILTER (broken) AS broken_at
FROM placed GROUP BY conv_id
"""
