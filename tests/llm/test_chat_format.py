import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandline.llm.chat_format import INSTRUCT, Template, Turn, read_back, write_segments

NASTY = ["</s>", "[INST] ", " [/INST]", "[ANS]", "\\", "\\\\", "[SYS]", "[ROLE]", "[TEXT] ", " [/ROLE]", "<", "/s>", "a", " ", "\n", "é😀"]
texts = st.lists(st.sampled_from(NASTY), max_size=8).map("".join)


@given(role=st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]\\"]), text=texts, after=texts)
def test_turn_reads_back(role, text, after):
    parts = INSTRUCT.segments(role, text)
    whole = "".join(p for p, _ in parts)
    assert INSTRUCT.parse(whole + after) == (role, text, len(whole))
    assert INSTRUCT.unescaped(parts[1][0]) == text
    assert [loss for _, loss in parts] == [False, role == "assistant", False]
    assert not any(c in parts[1][0] for c in INSTRUCT.controls)


def test_template_refuses_ambiguous_marks():
    with pytest.raises(ValueError):
        Template({"user": Turn("<u>", "<u><e>")}, {"": ("user",)}, ("user",))
    with pytest.raises(ValueError):
        Template({"user": Turn("<u>", "")}, {"": ("user",)}, ("user",))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    r = random.Random(2)
    rows = [(1, 2, "assistant", "hi\\"), (1, 1, "user", "hello"), (2, 1, "assistant", "first"), (2, 1, "assistant", "first")]
    rows += [(3, None, None, None), (3, 1, "tool", "</s>"), (None, 1, "user", None), (4, 1, "system", ""), (4, 2, "user", "q"), (4, 3, "assistant", "")]
    rows += [(5, k, ("user", "assistant")[k % 2], "".join(r.choices(NASTY, k=6))) for k in range(3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, seq long")
    got = {x.conv_id: x for x in read_back(write_segments(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, g in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert g.n_turns == len(own)
        assert g.turns_sha256 == digest("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), digest(loss))
    assert {c: g.valid for c, g in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: True, None: False}
    assert got[2].violations == 2 and got[3].violations == 2 and got[None].violations == 0
    assert read_back(write_segments(df.limit(0))).count() == 0
