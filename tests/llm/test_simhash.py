import random

import numpy as np
import pytest
import xxhash

from docweave.llm.components import connected_components, local_forest
from docweave.llm.queries import QUERIES
from docweave.llm.simhash import fingerprint, link_fingerprints, simhash_components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ") \
        .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= bits):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 255, 256, 257, 70_000])
def test_fingerprint(n):
    text = " ".join(random.Random(n).choices(["The", "a", "É", "x y", "z"], k=n))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_whole_table_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    want = {d: (f"{int(f):016x}", c) for d, f, c in zip(ids, fps, components(fps, ids))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SF).collect()} == want


@pytest.mark.parametrize("hot_key", [2, 4096])
@pytest.mark.parametrize("bits", [1, 3])
def test_links_lose_none(spark, hot_key, bits):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):  # clusters with many fingerprints in one key
        base = rng.getrandbits(64)
        for _ in range(40):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, 2**64 - 1, 2**63, 7, 2**64 - 8}
    arr = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long").repartition(4)
    links = link_fingerprints(df, bits, hot_key).collect()
    assert all(np.bitwise_count(np.uint64((a ^ b) % 2**64)) <= 64 for a, b in links)
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    node, root = local_forest(a, b)
    got = dict(zip(node.tolist(), root.tolist()))
    label = [got.get(int(x), int(x)) for x in arr.view(np.int64)]
    want = components(arr, list(range(len(arr))), bits)
    assert len(set(label)) == len(set(want)) == len(set(zip(label, want)))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = chain + star + [(5, 5), (3, 4), (-8, 2000)]
    rng.shuffle(links)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in links], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {2000: -8}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    want = sorted((str(r.doc_id), f"{int(f):016x}", c) for r, f, c in zip(rows, fps, components(fps, [r.doc_id for r in rows])))
    got = simhash_components(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash_components(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_texts_read_in_blocks_give_the_same_fingerprint(block):
    from docweave.llm.simhash import fingerprint

    for text in ("", " ", "a", "a b", " a b c ", "a b c d", "One two\tthree\n\nfour  five \x0b six é ", "word " * 300, "x" * 500 + " y z w"):
        for shingle in (1, 2, 3, 5):
            assert fingerprint(text.encode(), shingle, block=block) == fingerprint(text.encode(), shingle)


def test_long_text_in_bounded_memory():
    import tracemalloc

    from docweave.llm.simhash import fingerprint

    text = b" ".join(b"w%d" % (i * i % 99_991) for i in range(3_000_000))
    tracemalloc.start()
    fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
