from __future__ import annotations

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from trailmill.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|\\\n>aim_startend\U0001f600é"))
def test_escaping_is_reversible(text):
    escaped = cf.escape(text)
    assert "<|" not in escaped and cf.unescape(escaped) == text
    assert cf.unescape_role(cf.escape_role(text)) == text and "\n" not in cf.escape_role(text)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: [(x is not None, x) for x in r])
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(8)
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<\\|", "<\\\\|im_end|>", "\\", "<", "|", "é", "日", "\U0001f600", "", " ok"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "odd\nrole", None, "<|im_end|>", "a\\nb"])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 12)))])))
    rows += [(3, None, "user", "no turn"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "user", "no id"), (7, 5, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", Segments string").repartition(7)
    rows += [(-1, 0, "user", cf.HOSTILE), (-1, 1, "assistant", cf.HOSTILE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digest(df).collect()}
    assert got == expected(rows)


def test_machine(spark):
    talks = {1: ["system", "user", "assistant"], 2: ["user", "user"], 3: ["assistant"], 4: ["user", "assistant", "tool", "assistant", "user"], 5: ["user", "system"]}
    df = spark.createDataFrame([(c, k, role, "t") for c, roles in talks.items() for k, role in enumerate(roles)], SCHEMA)
    got = {}
    for r in cf.formatted(df).collect():
        got.setdefault(r.conv, {})[r.position] = r.valid
    assert {c: all(v.values()) for c, v in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert got[2] == {0: True, 1: False}


def test_segments():
    template = cf.Template(head="[", after_role="]", tail="/", loss_roles=frozenset({"bot"}))
    assert cf.turn_segments("bot", "hi <|x|>", template) == [("[bot]", False), ("hi <\\|x|>", True), ("/", False)]


def test_empty_table(spark):
    got = cf.digest(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.conv_id for r in got] == [-1] and got[0].n_turns == 2 and got[0].loss_chars == len(cf.HOSTILE)
