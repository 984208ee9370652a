import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.chat_format import assemble, escaped, escaped_role, format_conversations, read_back, unescaped, unescaped_role
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PARTS = st.sampled_from(["<|im_end|>", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<\\</s>", "\\", "<", "[", "\n", "a", "é"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
def test_escape_round_trip(text):
    out = escaped(pa.array([text]))[0].as_py()
    assert unescaped(out) == text
    assert "<|im_end|>" not in out and "<|im_start|>" not in out and "[INST]" not in out and "</s>" not in out
    role = escaped_role(pa.array([text]))[0].as_py()
    assert unescaped_role(role) == text and "\n" not in role


def test_assembly_equals_concatenation():
    role, text = pa.array(["user", "", "é"], pa.large_string()), pa.array(["a b", "", "日本</s>"], pa.large_string())
    buffer, turns, at, length = assemble(role, text)
    want = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("user", "a b"), ("", ""), ("é", "日本<\\/s>"))]
    assert buffer.tobytes().decode() == "".join(want)
    assert [buffer[a:b].tobytes().decode() for a, b in zip(turns[:-1], turns[1:])] == want
    assert buffer[at[2]:at[2] + length[2]].tobytes().decode() == "日本<\\/s>"


def _want(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def test_whole_table_against_brute_force(spark):
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    control = "</s>[INST] ok [/INST]"
    rows[-7] = [("user", control), ("assistant", control)]
    assert got == {k: _want(v) for k, v in rows.items()}


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_fragments_nulls_and_repeats(spark, size):
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "x" * 500), (1, 2, None, None), (1, None, "system", "first"),
             (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 0, "assistant", "no id"), (3, 0, "odd\nrole", "")]
    turns += [(9, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as seq", "3 as row")
    fragments = format_conversations(df, fragment_bytes=size)
    if size == 64:
        assert fragments.where("conv_id = 9").count() > 50
    got = {r.conv_id: r for r in read_back(fragments).collect()}
    by = {}
    for c, k, r, t in sorted(turns, key=lambda x: (x[0] or 0, -1 if x[1] is None else x[1])):
        by.setdefault(c, []).append((r, t))
    assert {k: tuple(v)[1:5] for k, v in got.items()} == {k: _want(v) for k, v in by.items()}
    assert got[2].formatted_chars == 2 * len("<|im_start|>assistant\nsame<|im_end|>\n")
    assert read_back(format_conversations(df.limit(0))).count() == 0
