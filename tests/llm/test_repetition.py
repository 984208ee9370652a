import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.queries import QUERIES
from docweave.llm.repetition import Limits, measure, repetition_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    words = WORD.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    seen, lines, dup, line_chars, dup_chars = set(), 0, 0, 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines, line_chars = lines + 1, line_chars + len(line)
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    out |= {"n_dup_lines": dup, "n_lines": lines, "line_chars": line_chars, "dup_line_chars": dup_chars}
    for k in range(2, 11):
        grams = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        count, met, all_, later = collections.Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                all_.update(range(i, i + k))
                if g in met:
                    later.update(range(i, i + k))
            met.add(g)
        if k == 5:
            out["n_repeat_words"] = len(all_)
        if k >= 5:
            out[f"dup_{k}_chars"] = sum(len(words[i]) for i in later)
        else:
            most = max(count.values(), default=0)
            cover = max((sum(map(len, g)) * c for g, c in count.items() if c == most and c > 1), default=0)
            out[f"top_{k}_chars"] = min(cover if most >= 3 else 0, out["word_chars"])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(["a", "b", "ç#", "\n", "\t", "a b", "\r\n"]), max_size=40).map(" ".join), st.text(max_size=20)),
                min_size=1, max_size=4))
def test_measures(texts):
    got = measure(pa.array(texts, pa.large_string()), Limits())
    for i, t in enumerate(texts):
        want = plain(t)
        assert {k: int(got[k][i]) for k in want} == want


def test_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_repetition"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(rows[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdict(spark):
    rng = np.random.default_rng(3)
    clean = " ".join(f"w{i}" for i in rng.integers(0, 5000, 400))
    line = " ".join(f"v{i}" for i in range(12))
    texts = [clean, "\n".join([clean] + [line] * 2), "\n".join([" ".join(f"u{i}" for i in range(150))] + [line + " x"] * 6), "spam ham " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition_rules(df).collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]


def test_odd_documents(spark, odd_docs, no_docs):
    got = repetition_rules(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted(
        (str(r.doc_id), len(WORD.findall(r.text or ""))) for r in odd_docs.collect())
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 10)
    assert repetition_rules(no_docs).count() == 0
