import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import fill_in_middle as M
from docweave.llm.fill_in_middle import arranged, byte_at, fim_restore, fim_transform, restored, reverse, rotate

TEXTS = st.lists(st.sampled_from(["<", "P>", "<S", ">", "<P", "M>", "a", "é", "日", "🙂", "\n", "\x00"]), max_size=12).map("".join)


def _plain_way(text, a, b, form):
    p, m, s = text[:a], text[a:b], text[b:]
    return {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]


def _bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 40), st.integers(0, 40), st.sampled_from(["plain", "psm", "spm"]))
def test_rotations_equal_slices_and_invert(text, a, b, form):
    if form != "plain" and any(x in text for x in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    out = arranged(_bytes(text), a, b - a, form)
    assert out.decode() == _plain_way(text, a, b, form)
    assert restored(bytes(out), form).decode() == text


@pytest.mark.parametrize("step", [1, 3, 1 << 16])
def test_reversal_and_rotation_in_pieces(monkeypatch, step):
    monkeypatch.setattr(M, "_STEP", step)
    for n in range(12):
        for cut in range(n + 1):
            buf = bytearray(range(n))
            reverse(buf, cut, n)
            assert list(buf) == [*range(cut), *reversed(range(cut, n))]
            buf = bytearray(range(n))
            rotate(buf, 0, cut, n)
            assert list(buf) == [*range(cut, n), *range(cut)]
    text = "aé日🙂" * 3
    assert [byte_at(_bytes(text), i) for i in range(len(text) + 2)] == [len(text[:i].encode()) for i in range(len(text) + 2)]


def _want(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    return (n, form, None if form == "plain" else a, None if form == "plain" else b - a, _plain_way(text, a, b, form), text)


def test_odd_rows(spark, odd_docs, no_docs):
    odd_docs = odd_docs.selectExpr("*", "1 as _id", "2 as _h", "'q' as output", "'q' as form", "'q' as restored")
    rows = odd_docs.select("doc_id", "text").collect()
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["has <P> inside", "é" * 70_000, "x<S", "<M>"], 100)], "doc_id long, text string")
    got = fim_restore(fim_transform(odd_docs)).union(fim_restore(fim_transform(more))).collect()
    key = lambda r: (r[0] is None, r[0], r[1:])
    want = [(r.doc_id, *_want(r.doc_id, r.text)) for r in rows + more.collect()]
    assert sorted((tuple(r) for r in got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    assert fim_restore(fim_transform(no_docs)).count() == 0


def test_shares_of_forms(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'some words to be cut' as text")
    n = {r.form: r["count"] for r in fim_transform(docs, seed=5, plain_pct=30, spm_pct=50).groupBy("form").count().collect()}
    assert abs(n["plain"] - 1200) < 150 and abs(n["spm"] - n["psm"]) < 200


def test_very_long_text_keeps_memory_low():
    import tracemalloc

    data = _bytes("aé" * 7_000_000)
    tracemalloc.start()
    out = arranged(data, 3_000_001, 5_000_000, "spm")
    assert bytes(restored(out, "spm")) == data.tobytes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(data)
