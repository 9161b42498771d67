import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["[INST]", " [/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "<|im_start|>", "<|im_end|>\n", "\\", "\\\\", "[\\INST]", "<", "[", ">", "$0", "$1", " ", "\n", "é", "日本", "a", "ok", "|", "<<<SYS>>>", "<|im_", "\r\n", " "]


def chats(seed=1, count=40):
    r = random.Random(seed)
    text = lambda: None if r.random() < 0.05 else "".join(r.choices(PIECES, k=r.randint(0, 9)))
    rows = []
    for conv in range(count):
        roles = ["system"] * (r.random() < 0.3) + ["user", "assistant"] * r.randint(0, 4)
        if r.random() < 0.4:
            roles.insert(r.randint(0, len(roles)), r.choice(["user", "assistant", "system", "tool", "[INST]", "a\\b", None]))
        rows += [(conv, 3 * k, role, text()) for k, role in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (900, None, "assistant", "first"), (900, 1, "user", "then"), (901, 1, "user", "b"), (901, 1, "user", "a"), (901, 1, "assistant", "c"), (902, 0, "user", "same"), (902, 0, "user", "same")]
    rows += [(903, k, ("user", "assistant")[k % 2], "[INST]" * 3) for k in range(3000)] + [(904, 0, "user", "\\<s>é" * 100_000), (904, 1, "assistant", "[/INST]" * 100_000)]
    r.shuffle(rows)
    return rows


def grouped(rows):
    key = lambda v: (v is not None, v)
    out = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (key(x[1]), x[2], x[3])):
        out.setdefault(conv, []).append((role, text))
    return out


def machine(template, roles):
    """(valid, broken_at) by walking the moves."""
    state, broken = template.first, None
    for k, role in enumerate(roles):
        there = template.moves.get(state, {}).get(role)
        if there is None:
            broken = k if broken is None else broken
            there = template.resume.get(role, state)
        state = there
    return broken is None and state in template.accepting, broken


@pytest.mark.parametrize("template", [chat.INSTRUCT, chat.CHATML], ids=["instruct", "chatml"])
def test_round_trip(spark, template):
    rows = chats()
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3), template)
    made = made.withColumns({"back": chat.read_back(F.col("formatted"), template), "loss": chat.under_loss(F.col("segments"))}).collect()
    want = grouped(rows)
    assert {r.conv_id for r in made} == set(want) and len(made) == len(want)
    for r in made:
        turns = want[r.conv_id]
        assert [tuple(t) for t in r.back] == turns and r.n_turns == len(turns)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert (r.valid, r.broken_at) == machine(template, [role for role, _ in turns])
        # Every control string that is left belongs to a mark.
        marks = sum(m.count(c) for m in (template.start, template.end) for c in template.controls)
        for role, _ in turns:
            own = template.turns.get(role)
            marks += sum(m.count(c) for m in ((own.before, own.after) if own else template.other) for c in template.controls)
        assert sum(r.formatted.count(c) for c in template.controls) == marks


def test_end_marks_under_the_loss(spark):
    turns = dict(chat.INSTRUCT.turns, assistant=chat.Turn("<s>", "</s>", loss=True, loss_after=True))
    template = chat.Template(turns, chat.INSTRUCT.other, chat.INSTRUCT.controls, chat.INSTRUCT.moves, chat.INSTRUCT.accepting)
    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>")], SCHEMA), template).first()
    assert made.formatted == "[INST] q [/INST]<s>a<\\/s></s>" and [tuple(s) for s in made.segments if s.loss] == [("a<\\/s>", True), ("</s>", True)]


@pytest.mark.parametrize("bad", [{"controls": ("<s>", "x")}, {"controls": ("a\\b",)}, {"other": ("plain", " [TEXT] ", " [/ROLE]")}, {"other": ("[ROLE] ", " [TEXT] <", " [/ROLE]")}, {"other": ("[ROLE] ", "s>[TEXT]", " [/ROLE]")}, {"other": ("[INST] ", " [TEXT] ", " [/ROLE]")}])
def test_templates_that_could_not_be_read_back(bad):
    kind = chat.INSTRUCT
    parts = {"turns": kind.turns, "other": kind.other, "controls": kind.controls, "moves": kind.moves, "accepting": kind.accepting} | bad
    with pytest.raises(ValueError):
        chat.Template(**parts)


def test_query(spark, tmp_path):
    rows = chats(2)
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"formatted": F.lit("x"), "segments": F.lit(1)})
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    made = chat.op13_chat(spark, str(tmp_path))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for conv, turns in grouped([*rows, *((-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant")))]).items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), digest("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), digest(loss), *machine(chat.INSTRUCT, [role for role, _ in turns]))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.broken_at) for r in made.collect()}
    assert got == want
    assert made.where("conv_id = -1").first().formatted_chars == len("[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>")
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, tmp_path):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op13_chat(spark, str(tmp_path)).collect()] == [-1]
