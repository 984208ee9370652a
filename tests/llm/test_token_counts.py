import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.queries import QUERIES
from docweave.llm.token_counts import TokenTree, clean_up_edits, counter, edited_token_counts

SF = "/root/testdata/sf0.01"
COUNT = counter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
PIECE = st.sampled_from(["a", "word", " ", "  ", "\n", "'", "s", "'re", "'ll", "12", "é", "🙂", ".", "<|endoftext|>", "\t", "x's"])
TEXT = st.lists(PIECE, max_size=60).map("".join)


def whole(text):
    return len(COUNT.tokenizer.encode(text, add_special_tokens=False).ids)


def apply(text, edits):
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    return text


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 130), st.integers(0, 12), TEXT), max_size=6))
def test_any_edits_equal_encoding_anew(text, edits):
    tree = TokenTree(text * 3, COUNT)
    text *= 3
    for a, k, new in edits:
        a = min(a, len(text))
        tree.replace(a, min(a + k, len(text)), new)
        text = text[:a] + new + text[a + k:]
        assert tree.text() == text and tree.n_chars == len(text) and tree.n_tokens == whole(text)
        assert [p for leaf in tree.leaves for p in leaf] == COUNT.lex.findall(text)


def test_only_touched_regions_are_encoded_again():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = TokenTree(text, COUNT)
    tree.replace(50_000, 50_003, "xyz")
    assert tree.reencoded < 200
    tree.replace(len(text) // 2, len(text) // 2, " many new words" * 2000)
    assert tree.n_tokens == whole(tree.text()) and tree.reencoded < 40_000


def test_whole_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_edit_token_counts"](spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_edits for r in got) > 50
    for r in got:
        edits = clean_up_edits(rows[r.doc_id])
        after = apply(rows[r.doc_id], edits)
        assert (r.n_edits, r.n_tokens, r.n_chars_after, r.n_tokens_after) == (len(edits), whole(rows[r.doc_id]), len(after), whole(after))
        assert r.n_edits or r.reencoded_chars == 0


def test_odd_documents(spark, odd_docs, no_docs):
    got = edited_token_counts(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    want = sorted((str(r.doc_id), whole(r.text or "")) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert edited_token_counts(no_docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


ADDRESS = st.lists(st.sampled_from(["@", "a", ".", "b.co", "-", " ", "é", "com", "@x.org"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(ADDRESS)
def test_addresses_equal_the_plain_pattern(line):
    import re

    from docweave.llm.token_counts import addresses

    assert list(addresses(line)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", line)]


def test_long_runs_take_linear_time():
    import time

    from docweave.llm.token_counts import clean_up_edits

    began = time.time()
    for text in ("a" * 1_000_000 + "@", "a@" * 300_000, "a." * 300_000 + "@" + "b." * 300_000 + "c", "1" + " " * 1_000_000 + "x"):
        clean_up_edits(text)
    assert clean_up_edits("x" * 500_000 + "@mail.org") == [(0, 500_009, "[EMAIL]")]
    assert time.time() - began < 10
