"""Conversation structure repair by Wagner-Fischer target alignment (operator 11).

A conversation is repaired into the grammar ``(s?(ua)+)?`` of role initials at least cost:
Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit for blank and duplicate turns),
Insert an empty user or assistant turn 2, and 1 for every truncated turn that stays.

The turns are aligned with every feasible length of the alternating target. Targets of all
lengths share their ends, so one table of suffix costs S[turn][letters left] serves them all;
a greedy repair is the incumbent, and its cost bounds the diagonals that an alignment as good
can touch (Ukkonen's band). The alignments of equal cost are traced through the table, and
their audits (edits' initials) compared; the ASCII-least wins.

A conversation of any size: turns are range-partitioned and cut into fragments of bounded size.
Fragments of a longer conversation are aligned by themselves from and to each grammar state
(nothing yet, system only, after assistant, after user); what is brought together for one
conversation are these small tables, one letter a turn and state, and its audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import staged, tasks

FRAGMENT_TURNS, FRAGMENT_CHARS = 1024, 1 << 20
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
NONE = 1 << 40  # no alignment
ROLE = {"u": "user", "a": "assistant"}
# grammar states: nothing yet, system only, after an assistant turn, after a user turn
START, SYSTEM, CLOSED, OPEN = "0", "s", "a", "u"


# --- alignment of one fragment ------------------------------------------------------------

class _Suffix:
    """Least cost of aligning turns i.. with the alternating target of r letters ending in ``end``, within the band."""

    def __init__(self, kinds: str, bad: np.ndarray, cut: np.ndarray, end: str, excess: int):
        self.kinds, self.bad, self.cut, self.end = kinds, bad, cut, end
        n, half = len(kinds), excess // 2  # an insertion costs 2; deleting a good turn costs 2 more than keeping it at least
        self.width = 2 * half + 1
        good = np.concatenate([np.cumsum(~bad[::-1])[::-1], [0]])
        self.low = good - half
        step = 2 * np.arange(self.width)
        self.cost = np.full((n + 1, self.width), NONE, np.int64)
        left = self.low[n] + np.arange(self.width)
        self.cost[n] = np.where(left >= 0, 2 * left, NONE)
        for i in range(n - 1, -1, -1):
            below, row = self.cost[i + 1], self.cost[i]
            if bad[i]:
                row[:] = below + 3
            else:
                row[:-1] = below[1:] + 3
                left = self.low[i] + np.arange(self.width)
                odd, even = self.match(i, 1), self.match(i, 2)
                np.minimum(row, np.where(left >= 1, below + np.where(left % 2 == 1, odd, even), NONE), out=row)
            np.minimum(row, np.minimum.accumulate(row - step) + step, out=row)

    def letter(self, left: int) -> str:
        return self.end if left % 2 else ("a" if self.end == "u" else "u")

    def match(self, i: int, left: int) -> int:
        return int(self.cut[i]) + (0 if self.kinds[i] == self.letter(left) else 2)

    def at(self, i: int, left: int) -> int:
        w = left - self.low[i]
        return int(self.cost[i, w]) if left >= 0 and 0 <= w < self.width else NONE

    def lengths(self, i: int, parity: int, least: int) -> tuple[int, list[int]]:
        """Least cost over the targets of ``least`` letters or more and that parity, and all lengths that reach it."""
        left = self.low[i] + np.arange(self.width)
        costs = np.where((left >= least) & (left % 2 == parity), self.cost[i], NONE)
        best = int(costs.min())
        return best, [int(x) for x in left[costs == best]] if best < NONE else []

    def trace(self, i: int, left: int) -> str:
        """The ASCII-least audit among the cheapest alignments of turns i.. with ``left`` letters."""
        out, n = [], len(self.kinds)
        while i < n or left > 0:
            here = self.at(i, left)
            if i < n and here == 3 + self.at(i + 1, left):
                out.append("D")
                i += 1
            elif left > 0 and here == 2 + self.at(i, left - 1):
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.kinds[i] == self.letter(left) else "R")
                i, left = i + 1, left - 1
        return "".join(out)


def _incumbent(kinds: str, bad: np.ndarray, cut: np.ndarray, expected: str, first: int = 0) -> tuple[int, str | None]:
    """Cost above what no repair avoids of a greedy repair of the good turns from ``first`` on, and its last letter."""
    events, last = 0, None
    for i in range(first, len(kinds)):
        if bad[i]:
            continue
        if kinds[i] in "ua" and kinds[i] != expected:  # insert what is missing, then keep
            events, last = events + 1, kinds[i]
        else:
            events, last = events + (kinds[i] != expected), expected
        expected = "u" if last == "a" else "a"
    return 2 * events, last


def _excess(kinds: str, bad: np.ndarray, cut: np.ndarray, whole: bool) -> int:
    """Cost above the unavoidable that an optimal alignment can have: the incumbent's."""
    cost, last = _incumbent(kinds, bad, cut, "u")
    if not whole:  # for any state to begin and to end with
        return max(cost, _incumbent(kinds, bad, cut, "a")[0]) + 4
    cost += 2 * (last == "u")
    good = np.flatnonzero(~bad)
    if len(good) and kinds[good[0]] == "s":
        other, last = _incumbent(kinds, bad, cut, "u", int(good[0]) + 1)
        cost = min(cost, other + (4 if last is None else 2 * (last == "u")))
    return cost


def _least(found: list[tuple[int, list[str]]]) -> tuple[int, str] | None:
    """The cheapest of (cost, audits), ties by audit."""
    found = [(cost, min(audits)) for cost, audits in found if audits and cost < NONE]
    return min(found) if found else None


def _edges(kinds: str, bad: np.ndarray, cut: np.ndarray, whole: bool) -> dict[tuple[str, str], tuple[int, str]]:
    """(from state, to state) -> (cost, audit): the cheapest, then ASCII-least alignment of the turns."""
    n = len(kinds)
    none = (3 * n, ["D" * n])
    excess = _excess(kinds, bad, cut, whole)
    tables = {end: _Suffix(kinds, bad, cut, end, excess) for end in ("a" if whole else "au")}
    system = [i for i in range(n) if kinds[i] == "s" and not bad[i]]
    edges = {(START, START): none, (SYSTEM, SYSTEM): none}
    for end, table in tables.items():
        user_first = 0 if end == "a" else 1  # parity of the targets that begin with u

        def best(i: int, parity: int, least: int, before: str = "") -> tuple[int, list[str]]:
            cost, lengths = table.lengths(i, parity, least)
            return cost, [before + table.trace(i, left) for left in lengths]

        found = [best(0, user_first, 1)]
        if not whole:
            edges[SYSTEM, end] = found[0]
            edges[CLOSED, end] = best(0, user_first, 0)
            edges[OPEN, end] = best(0, 1 - user_first, 0)
        for i in system:  # turns before a kept system turn go
            cost, lengths = table.lengths(i + 1, user_first, 1)
            cost += 3 * i + int(cut[i])
            if cost <= min(c for c, _ in found):
                found.append((cost, ["D" * i + "K" + table.trace(i + 1, left) for left in lengths]))
        edges[START, end] = _least(found)
    if system:
        edges[START, SYSTEM] = _least([(3 * (n - 1) + int(cut[i]), ["D" * i + "K" + "D" * (n - 1 - i)]) for i in system])
    flat = {k: v if isinstance(v[1], str) else _least([v]) for k, v in edges.items() if v}
    return {k: v for k, v in flat.items() if v}


@functools.lru_cache(maxsize=1 << 14)
def _repair_known(kinds: str, flags: str) -> tuple[int, str]:
    return _repair(kinds, flags)


def _flags(flags: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(flags.encode(), np.uint8)
    return (codes == ord("b")) | (codes == ord("d")), codes == ord("t")


def _repair(kinds: str, flags: str) -> tuple[int, str]:
    bad, cut = _flags(flags)
    edges = _edges(kinds, bad, cut, whole=True)
    return min(edges[k] for k in ((START, START), (START, CLOSED)) if k in edges)


def repair(kinds: str, flags: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: its role initials and a flag a turn (b blank, d duplicate, t truncated, - none)."""
    return _repair_known(kinds, flags) if len(kinds) <= 64 else _repair(kinds, flags)


def applied(roles: list[str], texts: list[str], audit: str, state: str = START) -> tuple[list[str], list[str]]:
    """The turns that the edits of ``audit`` make of a fragment that is entered in ``state``."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            state = roles[i][:1]
            out_roles.append(roles[i])
        else:
            state = "a" if state == "u" else "u"
            out_roles.append(ROLE[state])
        out_texts.append("" if edit == "I" else texts[i])
        i += edit != "I"
    return out_roles, out_texts


# --- fragments ---------------------------------------------------------------------------------

def flag(text: str) -> str:
    """b: nothing but white space; t: the last other character ends no sentence; -: neither."""
    last = text.rstrip(WHITE)[-1:]
    return "b" if not last else "-" if last in ENDS else "t"


_FRAGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("kinds", pa.string()), ("flags", pa.string()),
                       ("digests", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_FRAGMENT_SQL = "conv_id long, part long, seq long, kinds string, flags string, digests array<binary>, roles array<string>, texts array<string>"


def _fragment(conv, part: int, seq: int, roles: list[str], texts: list[str]) -> tuple:
    digests = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in zip(roles, texts)]
    seen, flags = set(), []
    for d, t in zip(digests, texts):
        f = flag(t)
        flags.append("d" if f != "b" and d in seen else f)
        seen.add(d)
    return conv, part, seq, "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r in roles), "".join(flags), digests, roles, texts


def _cut(batches: Iterator[pa.RecordBatch], fragment_turns: int, fragment_chars: int) -> Iterator[pa.RecordBatch]:
    seq, conv, part, roles, texts, chars, out, size = 0, None, 0, [], [], 0, [], 0

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _FRAGMENT)], schema=_FRAGMENT)

    for batch in batches:
        for c, p, r, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if roles and (c != conv or len(roles) >= fragment_turns or chars + len(t) > fragment_chars):
                out.append(_fragment(conv, part, seq, roles, texts))
                seq, size, roles, texts, chars = seq + 1, size + chars, [], [], 0
                if size > fragment_chars or len(out) > 4096:
                    yield batch_of(out)
                    out, size = [], 0
            conv, part, chars = c, p, chars + len(t) + len(r)
            roles.append(r)
            texts.append(t)
    if roles:
        out.append(_fragment(conv, part, seq, roles, texts))
    if out:
        yield batch_of(out)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("kinds", pa.string()), ("flags", pa.string()),
                       ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_REPAIRED_SQL = "conv_id long, part long, seq long, kinds string, flags string, cost long, audit string, roles array<string>, texts array<string>"


def _lists(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _repaired(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_REPAIRED)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _REPAIRED)], schema=_REPAIRED)


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, seq, kinds, flags, roles, texts in _lists(batch, "conv_id", "part", "seq", "kinds", "flags", "roles", "texts"):
            cost, audit = repair(kinds, flags)
            out.append((conv, part, seq, kinds, flags, cost, audit, *applied(roles, texts, audit)))
        yield _repaired(out)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of fragments; turns whose first occurrence lies in an earlier fragment are duplicates."""
    names = ["conv_id", "part", "seq", "flags", "states", "costs", "audits"]
    for batch in batches:
        out = []
        for conv, part, seq, kinds, flags, digests, first in _lists(batch, "conv_id", "part", "seq", "kinds", "flags", "digests", "first"):
            here = set(first or ())
            flags = "".join(f if f == "b" or d in here else "d" for f, d in zip(flags, digests))
            bad, cut = _flags(flags)
            edges = _edges(kinds, bad, cut, whole=False)
            out.append((conv, part, seq, flags, [a + b for a, b in edges], [c for c, _ in edges.values()], [a for _, a in edges.values()]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]
        cols = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


_ALIGNED_SQL = "conv_id long, part long, seq long, flags string, states array<string>, costs array<long>, audits array<string>"


def _letters(node) -> Iterator[str]:
    while node is not None:
        yield from node[1]
        node = node[2]


def _before(a, b) -> bool:
    """Whether the audit that begins at ``a`` comes before that at ``b``: (cost, piece, following node, state, fragment)."""
    for x, y in zip(_letters(a), _letters(b)):
        if x != y:
            return x < y
    return False


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen piece of every fragment; the fragments of a conversation come together, last one first."""
    names = ["conv", "p", "s", "flags", "cost", "piece", "state"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def chosen(conv, best):
        node, state, out = best[START], START, []
        while node[4] is not None:
            out.append((conv, *node[4], node[5], node[1], state))
            node, state = node[2], node[3]
        for lo in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 4096]), types)], names=names)

    end = (0, "", None, None, None, 0)
    current, best = None, None
    for batch in batches:
        for conv, part, seq, flags, states, costs, audits in _lists(batch, "conv_id", "part", "seq", "flags", "states", "costs", "audits"):
            if best is None or conv != current:
                if best is not None:
                    yield from chosen(current, best)
                current, best = conv, {START: end, CLOSED: end}
            new: dict = {}
            for (a, b), cost, audit in zip(states, costs, audits):
                if b in best:
                    node = (cost + best[b][0], audit, best[b], b, (part, seq, flags), cost)
                    if a not in new or node[0] < new[a][0] or (node[0] == new[a][0] and _before(node, new[a])):
                        new[a] = node
            best = new
    if best is not None:
        yield from chosen(current, best)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, seq, kinds, flags, cost, piece, state, roles, texts in _lists(
                batch, "conv_id", "part", "seq", "kinds", "flags", "cost", "piece", "state", "roles", "texts"):
            out.append((conv, part, seq, kinds, flags, cost, piece, *applied(roles, texts, piece, state)))
        yield _repaired(out)


def repair_conversations(turns: DataFrame, fragment_turns: int = FRAGMENT_TURNS, fragment_chars: int = FRAGMENT_CHARS) -> DataFrame:
    """Repaired fragments: conv_id, part, seq, kinds and flags of the turns as they came, cost, audit, and the turns after
    the edits (roles, texts). A conversation is its fragments in order of (part, seq), put end to end.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns go by turn
    (null first), then role, then a hash of the text, so repeated rows lie side by side. A
    null role or text is one space, so a null text is blank; a null conv_id is a
    conversation of its own; no rows give none. Roles count by their first letter. A
    fragment has ``fragment_turns`` turns and ``fragment_chars`` characters at most (one
    turn at least); the result does not depend on them.
    """
    n = tasks(turns.sparkSession)
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "tie"]
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = staged(ordered.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "role", "text").mapInArrow(
        functools.partial(_cut, fragment_turns=fragment_turns, fragment_chars=fragment_chars), _FRAGMENT_SQL), "fragments")
    several = staged(cut.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c")), "several")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    whole = cut.join(several, same, "left_anti").mapInArrow(_repair_whole, _REPAIRED_SQL)
    more = cut.join(several, same, "left_semi")
    # a digest belongs to the first fragment that has it
    first = more.select("conv_id", "part", "seq", F.explode(F.array_distinct("digests")).alias("d")).groupBy("conv_id", "d").agg(
        F.min(F.struct("part", "seq")).alias("at")).groupBy("at.part", "at.seq").agg(F.collect_list("d").alias("first")) \
        .select(F.col("part").alias("_p"), F.col("seq").alias("_s"), "first")  # at most the digests of one fragment
    tables = more.select("conv_id", "part", "seq", "kinds", "flags", "digests").join(
        first, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")), "left").mapInArrow(_align, _ALIGNED_SQL)
    pieces = staged(tables.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(
        _choose, "conv long, p long, s long, flags string, cost long, piece string, state string"), "pieces")
    rest = more.drop("flags").join(pieces, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).mapInArrow(_apply, _REPAIRED_SQL)
    return whole.unionByName(rest)


# --- digest of the repaired conversations -------------------------------------------------------

_SUMMARY = pa.schema([("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                      ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY_SQL = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Summary:
    """Counts, cost, audit and digest of one conversation, fragment by fragment."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.cost, self.audit, self.last = {"b": 0, "d": 0, "t": 0}, 0, 0, [], ""
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, kinds: str, flags: str, cost: int, audit: str, roles: list[str], texts: list[str]) -> None:
        for f in self.counts:
            self.counts[f] += flags.count(f)
        chain = self.last + kinds
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in zip(chain, chain[1:]))
        self.last = kinds[-1:]
        self.cost += cost
        self.audit.append(audit)
        for role, text in zip(roles, texts):
            self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True

    def row(self, conv) -> tuple:
        return (conv, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its fragments come together and in order."""
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)

    current, summary = None, None
    for batch in batches:
        out = []
        for conv, *fragment in _lists(batch, "conv_id", "kinds", "flags", "cost", "audit", "roles", "texts"):
            if summary is None or conv != current:
                if summary is not None:
                    out.append(summary.row(current))
                current, summary = conv, _Summary()
            summary.add(*fragment)
        if out:
            yield batch_of(out)
    if summary is not None:
        yield batch_of([summary.row(current)])


def summarise(fragments: DataFrame) -> DataFrame:
    """Per conversation: blank, duplicate, truncated, illegal, cost, audit and the digest of its repaired ``role:text`` lines.

    Conversations in one fragment are read where they are; the fragments of longer ones are
    read in sequence, which the digest needs, holding one letter a turn.
    """
    n = tasks(fragments.sparkSession)
    several = staged(fragments.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c")), "several")
    same, cols = F.col("conv_id").eqNullSafe(F.col("_c")), ["conv_id", "kinds", "flags", "cost", "audit", "roles", "texts"]
    one = fragments.join(several, same, "left_anti").select(*cols)
    more = fragments.join(several, same, "left_semi").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seq").select(*cols)
    return one.mapInArrow(_summaries, _SUMMARY_SQL).unionByName(more.mapInArrow(_summaries, _SUMMARY_SQL))


# --- the fixture's damage ------------------------------------------------------------------------

def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes sentence ends out, 3 repeats, 4 makes the
    role user. Nulls count as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def repair_audits(turns: DataFrame, original: DataFrame, **sizes) -> DataFrame:
    """A row for every conv_id of ``original``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of ``turns``."""
    found = summarise(staged(repair_conversations(turns, **sizes), "repaired"))
    gaps = turns.groupBy(F.col("conv_id").alias("_g")).agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    ids = original.select(F.col("conv_id").alias("_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(gaps, F.col("_id").eqNullSafe(F.col("_g")), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
