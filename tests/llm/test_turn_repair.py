import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm.queries import QUERIES
from docweave.llm.turn_repair import _choose, _edges, _flags, applied, damaged, flag, repair, repair_audits, repair_conversations

SF = "/root/testdata/sf0.01"
KINDS, FLAGS = "suua-", "--tbd"


def _targets(n):
    yield ""
    for k in range(1, n + 2):
        yield "ua" * k
        yield "s" + "ua" * k


def _brute(kinds, flags):
    """Every target in full, every cell holding its cheapest, then ASCII-least audit."""
    best = None
    for target in _targets(len(kinds)):
        row = {}
        for i in range(len(kinds) + 1):
            old, row = row, {}
            for j in range(len(target) + 1):
                ways = [(0, "")] if i == j == 0 else []
                if j and target[j - 1] != "s" and j - 1 in row:
                    ways.append((row[j - 1][0] + 2, row[j - 1][1] + "I"))
                if i:
                    k, f = kinds[i - 1], flags[i - 1]
                    if j in old:
                        ways.append((old[j][0] + 3, old[j][1] + "D"))
                    if j and j - 1 in old and f not in "bd":
                        c, a = old[j - 1]
                        if k == target[j - 1]:
                            ways.append((c + (f == "t"), a + "K"))
                        if target[j - 1] != "s":
                            ways.append((c + 2 + (f == "t"), a + "R"))
                if ways:
                    row[j] = min(ways)
        end = row.get(len(target))
        best = min(x for x in (best, end) if x) if best or end else None
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.sampled_from(FLAGS)), max_size=9))
def test_least_cost_and_audit(turns):
    kinds, flags = "".join(k for k, _ in turns), "".join(f for _, f in turns)
    assert repair(kinds, flags) == _brute(kinds, flags)
    roles, texts = applied([{"s": "system", "u": "user", "a": "assistant"}.get(k, "tool") for k in kinds], list(flags), repair(kinds, flags)[1])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)) and len(texts) == len(roles)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.sampled_from(FLAGS)), min_size=1, max_size=9), st.integers(1, 4))
def test_fragments_together_equal_the_whole(turns, size):
    import pyarrow as pa

    kinds, flags = "".join(k for k, _ in turns), "".join(f for _, f in turns)
    rows = []
    for seq, lo in enumerate(range(0, len(kinds), size)):
        edges = _edges(kinds[lo:lo + size], *_flags(flags[lo:lo + size]), whole=False)
        rows.append((1, 0, seq, flags[lo:lo + size], [a + b for a, b in edges], [c for c, _ in edges.values()], [a for _, a in edges.values()]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[::-1])], names=["conv_id", "part", "seq", "flags", "states", "costs", "audits"])
    got = [r for b in _choose(iter([batch])) for r in b.to_pylist()]
    assert (sum(r["cost"] for r in got), "".join(r["piece"] for r in got)) == _brute(kinds, flags)


def _damage(rows):
    """Rows (conv, turn, role, text) in order, damaged."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        yield row
        if h == 3:
            yield row


def _want(rows, originals):
    out = {c: [] for c in originals}
    for r in rows:
        out[r[0]].append(r)
    for conv, turns in out.items():
        seen, flags = set(), ""
        for _, _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            flags += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        kinds = "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "-" for r in turns)
        cost, audit = _brute(kinds, flags) if len(turns) < 40 else repair(kinds, flags)
        numbers = {r[1] for r in turns if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        roles, texts = applied([r[2] for r in turns], [r[3] for r in turns], audit)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()
        out[conv] = (gaps, flags.count("b"), flags.count("d"), flags.count("t"), illegal, cost, audit, sha)
    return out


def _order(r):
    return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)


def test_whole_table_against_brute_force(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()), key=_order)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_turn_repair"](spark, SF).collect()}
    assert got == _want(list(_damage(rows)), {r[0] for r in rows})


@pytest.mark.parametrize("size", [2, 7, 1024])
def test_odd_rows_and_fragment_sizes(spark, size):
    roles = ["user", "assistant"]
    rows = [(1, i, roles[i % 2], f"text {i % 9}.") for i in range(60)] + [(2, 0, "system", "be kind."), (2, 1, "user", "hi!"), (2, 1, "user", "hi!")]
    rows += [(3, None, "user", "no turn?"), (3, 4, None, "x."), (3, 5, "user", None), (None, 1, "assistant", "no conversation"), (4, 0, "", ""),
             (None, 2, None, None), (5, 0, "user", "q" * 100_000 + "?"), (5, 3, "tool", "日本 。 "), (6, 1, "user", " \t "), (7, 0, "a", "ends\n.\n")]
    rows += [(8, i, "user", "the same.") for i in range(30)] + [(9, i, roles[i % 2 ^ (i > 20)], f"{i} !") for i in range(38)]
    rows.sort(key=_order)
    df = spark.createDataFrame([r + (1, 1, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part long, seq long, n long, _c string")
    if size > 2:
        want = _want(list(_damage(rows)), {r[0] for r in rows})
        got = repair_audits(damaged(df), df, fragment_turns=size)
    else:
        want, got = _want([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows}), repair_audits(df, df, fragment_turns=size)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    if size == 2:
        fragments = repair_conversations(df, fragment_turns=size)
        assert fragments.where("conv_id = 1").count() >= 30
        one = [r for r in fragments.where("conv_id = 2").orderBy("part", "seq").collect()]
        assert "".join(r.audit for r in one) == "KKDI" and [x for r in one for x in r.roles] == ["system", "user", "assistant"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_audits(damaged(none), none).count() == 0 and repair_conversations(none).count() == 0


def test_flags_and_long_conversations():
    assert [flag(t) for t in ("", " \n\t", "a.", "a. \n", "a", "a. ", " ")] == ["b", "b", "-", "-", "t", "t", "t"]
    kinds = "ua" * 400 + "a" + "ua" * 100
    assert repair(kinds, "-" * len(kinds)) == (2, "K" * 800 + "I" + "K" * 201)
    kinds = "u" * 900
    cost, audit = repair(kinds, "-" * 900)  # every second one becomes an assistant turn
    assert cost == 900 and set(audit) == {"K", "R"}
