import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.queries import QUERIES, new_folder
from docweave.llm.token_store import Shard, pack_shard, token_output
from docweave.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "it's I'M <|endoftext|>x <|STARTOFTEXT|> don't a<b", "é—,x 1a2,3 €5 a€b", "foó,bar Å ß İstanbul ΟΔΟΣ ﬁ", "a b c,d́",
       "...!!!--- 'S 's x's", "日本語テキスト。これ,は 🙂👍🏽 a🙂b", "×3 ÷4 Ã×b ́a,́", "\x00 \x1f a\x85b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=30)), max_size=5))
def test_encoding_equals_whole_texts(texts):
    enc = encoder(PATH)
    ids, offsets = enc.encode(pa.array(texts, pa.large_string()))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8))
def test_shard_round_trip_and_random_access(docs):
    docs = [np.array([*d, 2], np.uint32) for d in docs]
    shard = Shard(pack_shard([None, *range(1, len(docs))], np.array([len(d) for d in docs]), np.concatenate(docs), 10, 5, 2))
    assert shard.doc_ids == [None, *range(1, len(docs))] and shard.n_tokens == sum(map(len, docs))
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d.tolist()
        for a in range(0, len(d), 7):
            assert shard.tokens(i, a, min(a + 5, len(d))).tolist() == d[a:a + 5].tolist()


def test_repetition_is_compressed():
    ids = np.tile(np.arange(8, dtype=np.uint32), 4000)
    blob = pack_shard([0], np.array([len(ids)]), ids, 49_408, 6, 16)
    assert len(blob) < len(ids) / 2
    assert Shard(blob).document(0).tolist() == ids.tolist()


def test_whole_table_against_the_library(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_store"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, {}
    for r in rows:
        ids = np.array([*encoder(PATH).tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("shard_tokens", [50, 1 << 19])
def test_odd_documents(spark, odd_docs, no_docs, shard_tokens):
    got = sorted(token_output(odd_docs, new_folder(spark, "t"), PATH, shard_tokens=shard_tokens).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert got[1].n_tokens == 1 and got[1].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert got[5].ids_crc32 == got[6].ids_crc32
    assert token_output(no_docs, new_folder(spark, "t"), PATH).count() == 0
