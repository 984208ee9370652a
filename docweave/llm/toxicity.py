"""Toxicity scores from a character n-gram linear classifier scaled by naive Bayes log-count ratios (operator 9).

Features are n-grams of code points of the lower-cased text (by Unicode's rule), any white space
being one blank. Over all labelled training rows, Spark counts in how many texts of either class
an n-gram occurs; r = log(p / q) of the smoothed class shares is its naive Bayes log-count
ratio. Counting takes two passes of bounded size: first by slots of a hash, which tells the slots
in which classes differ most; then the n-grams of these slots one by one (by 64-bit hash). The
most telling n-grams (by a two-proportion z) form the model; a text's value for an n-gram is
r * log(1 + occurrences per ``per_words`` words), and a logistic regression with an L2
penalty gives the weights. Only that last fit sees a bounded sample of the labelled rows
(``fit_rows``, chosen by a hash of the id); scoring reads every text whole, a piece at a time,
in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrays import text_column
from docweave.session import spread

BITS = 19
ORDERS = (2, 3, 4, 5, 6)
PIECE = 1 << 18  # code points of a long text that are hashed at once
SCREENED = 1 << 14  # slots whose n-grams are counted one by one
BROADCAST_ROWS = 4_000_000  # labels beyond this many rows are joined by a shuffle
_BLANK = np.zeros(0x110000, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def folded(texts: pa.Array) -> Iterator[np.ndarray]:
    """Code points of each lower-cased text, white space as blanks."""
    for text in pc.utf8_lower(texts):
        points = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
        yield np.where(_BLANK[points], np.uint32(32), points)


def pieces(points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, number of n-gram starts) of a text in parts that overlap by the longest n-gram less one."""
    for lo in range(0, len(points), PIECE):
        yield points[lo:lo + PIECE + max(ORDERS) - 1], min(PIECE, len(points) - lo)


def ngram_hashes(points: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of every order that begin at the first ``starts`` code points."""
    b = points.astype(np.uint64)
    h = np.full(len(b), 0xCBF29CE484222325, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[:len(b) - n + 1]
        if not len(h):
            return
        h = (h ^ b[n - 1:]) * np.uint64(0x100000001B3)
        if n in ORDERS:
            g = (h[:starts] ^ (h[:starts] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (g ^ (g >> np.uint64(32))) + np.uint64(n)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def slot_counts(docs: DataFrame) -> DataFrame:
    """(feature, pos, neg): in how many texts of either class a slot occurs, from (text, toxic)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, points in enumerate(folded(text_column(batch, "text"))):
                for part, starts in pieces(points):
                    for h in ngram_hashes(part, starts):
                        mark[slot_of(h)] = True
                found = np.flatnonzero(mark)
                mark[found] = False
                counts[toxic[i], found] += 1
        seen = np.flatnonzero(counts.sum(axis=0))
        for lo in range(0, len(seen), 1 << 16):
            part = seen[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], ["feature", "pos", "neg"])

    partial = docs.select("text", "toxic").mapInArrow(run, "feature long, pos long, neg long")
    return partial.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ngram_counts(docs: DataFrame, screened: np.ndarray, flush: int = 1 << 20) -> DataFrame:
    """(feature, pos, neg): in how many texts of either class an n-gram of the slots ``screened`` (bool by slot) occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0

        def summed():
            keys, inverse = np.unique(np.concatenate([*held[0], *held[1]]), return_inverse=True)
            pos = np.bincount(inverse[sum(map(len, held[0])):], minlength=len(keys))
            neg = np.bincount(inverse[:sum(map(len, held[0]))], minlength=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(neg)], ["feature", "pos", "neg"])

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, points in enumerate(folded(text_column(batch, "text"))):
                seen = [np.unique(np.concatenate([h[screened[slot_of(h)]] for h in ngram_hashes(part, starts)] or [np.zeros(0, np.uint64)]))
                        for part, starts in pieces(points)]
                if seen:
                    held[toxic[i]].append(np.unique(np.concatenate(seen)))
                    size += len(held[toxic[i]][-1])
                if size > flush:
                    yield summed()
                    held, size = ([], []), 0
        if size:
            yield summed()

    partial = docs.select("text", "toxic").mapInArrow(run, "feature long, pos long, neg long")
    return partial.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Model:
    """``feature``: hashes of the n-grams (ascending as unsigned numbers), their coefficient r * weight, and the intercept."""
    feature: np.ndarray
    coefficient: np.ndarray
    intercept: float
    per_words: float = 200.0


def _values(points: np.ndarray, feature: np.ndarray, screened: np.ndarray, per_words: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``feature``, log(1 + rate)) of the model's n-grams in a text."""
    counts = np.zeros(len(feature), np.int64)
    for part, starts in pieces(points) if len(feature) else ():
        for h in ngram_hashes(part, starts):
            h = h[screened[slot_of(h)]]
            at = np.minimum(np.searchsorted(feature, h), len(feature) - 1)
            counts += np.bincount(at[feature[at] == h], minlength=len(feature))
    blank = points == 32
    words = max(1, int(np.count_nonzero(~blank[1:] & blank[:-1])) + int(len(blank) > 0 and not blank[0]))
    at = np.flatnonzero(counts)
    return at, np.log1p(counts[at] * (per_words / words))


def _slots(feature: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[slot_of(feature)] = True
    return out


def select_features(counts: np.ndarray, n_pos: int, n_neg: int, features: int, min_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, r) of the ``features`` most telling rows of (feature, pos, neg)."""
    feature, pos, neg = counts.T
    pos, neg = pos.astype(float), neg.astype(float)
    pool = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(pool * (1 - pool), 1e-9) * (1 / n_pos + 1 / n_neg))
    z[pos + neg < min_texts] = 0
    top = np.sort(np.lexsort((feature, -np.abs(z)))[:features])
    top = top[z[top] != 0]
    r = np.log((pos[top] + 0.5) / (n_pos + 1)) - np.log((neg[top] + 0.5) / (n_neg + 1))
    order = np.argsort(feature[top])
    return feature[top][order], r[order]


def fit_weights(bounds: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray, n_slots: int, penalty: float, steps: int,
                block: int = 2000):
    """Logistic regression by adaptive gradient steps over rows ``bounds[i]:bounds[i+1]`` of (slot, value), a block of
    rows at a time, so that only the sparse rows themselves are held; returns (weights, intercept)."""
    w, b = np.zeros(n_slots), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    gw, gb = np.full(n_slots, 1e-8), 1e-8
    for _ in range(steps):
        g, total = penalty * w, 0.0
        for lo in range(0, len(y), block):
            hi = min(lo + block, len(y))
            part = slice(bounds[lo], bounds[hi])
            row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(bounds[lo:hi + 1]))
            s = np.bincount(row, w[slot[part]] * value[part], minlength=hi - lo) + b
            e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[lo:hi]) / len(y)
            g += np.bincount(slot[part], e[row] * value[part], minlength=n_slots)
            total += e.sum()
        gw += g * g
        w -= 0.1 * g / np.sqrt(gw)
        gb += total ** 2
        b -= 0.1 * total / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          features: int = 4096, min_texts: int = 5, fit_rows: int = 20_000, penalty: float = 1e-3, steps: int = 200,
          per_words: float = 200.0) -> Model:
    """Fit the model on the labelled rows given (leave held-out rows out of ``labels``).

    Rows without a label, and labels without a row, are not used; several labels of an id
    count as toxic if one says so. Without both classes the model has no features: its
    intercept is that of a small share of toxic texts. At most 2^19 counts, four times
    ``features`` n-grams and ``fit_rows`` sparse rows reach the driver, whatever the input's size.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("toxic"))
    if labels.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    slim = spread(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")))
    rows = slim.join(marks, F.col("_doc") == F.col("_id")).select("_id", "text", "toxic")
    n_neg, n_pos = (rows.select("toxic", "_id").groupBy().agg(
        F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first())
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, per_words)

    def table(counts: DataFrame) -> np.ndarray:
        return np.stack([c.to_numpy() for c in counts.toArrow().columns], axis=1)

    slots = table(slot_counts(rows))  # 2^BITS rows at most
    screened = np.zeros(1 << BITS, bool)
    screened[select_features(slots, n_pos, n_neg, SCREENED, min_texts)[0]] = True
    # only n-grams that could be chosen leave Spark: the rarest are too few, the least telling come last
    counts = ngram_counts(rows, screened).where(F.col("pos") + F.col("neg") >= min_texts)
    pool = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-9)))
    counts = table(counts.orderBy(F.desc(F.round(z, 9)), "feature").limit(4 * features))
    feature, r = select_features(counts, n_pos, n_neg, features, min_texts)
    feature = feature.astype(np.int64).view(np.uint64)
    order = np.argsort(feature)
    feature, r = feature[order], r[order]
    slots = _slots(feature)
    ways = max(1, -(-(n_pos + n_neg) // fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_values(p, feature, slots, per_words) for p in folded(text_column(batch, "text"))]
            at = pa.array(np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32))
            slot, value = (np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), pa.ListArray.from_arrays(at, pa.array(slot.astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], ["toxic", "tie", "slot", "value"])

    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(ways)) == 0).select("text", "toxic", F.xxhash64("_id", "text").alias("tie"))
    got = sample.mapInArrow(run, "toxic int, tie long, slot array<int>, value array<float>").toArrow()
    got = got.sort_by("tie").combine_chunks()  # the same sums whatever order the tasks end in
    y = got.column("toxic").to_numpy().astype(float)
    if not len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, per_words)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(got.column("slot")).to_numpy())]).astype(np.int64)
    slot = pc.list_flatten(got.column("slot")).to_numpy()
    value = pc.list_flatten(got.column("value")).to_numpy() * r.astype(np.float32)[slot]
    w, b = fit_weights(bounds, slot, value, y, len(feature), penalty, steps)
    return Model(feature, w * r, b, per_words)


def _scores(texts: pa.Array, shared) -> np.ndarray:
    feature, slots, coefficient, intercept, per_words = shared
    out = []
    for points in folded(texts):
        at, value = _values(points, feature, slots, per_words)
        out.append(intercept + float(value @ coefficient[at]))
    return 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))


def _shared(spark, model: Model):
    return spark.sparkContext.broadcast((model.feature, _slots(model.feature), model.coefficient, model.intercept, model.per_words))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) per row; a null text counts as empty and gets the intercept's score."""
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(text_column(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with all its columns, without the rows that score ``threshold`` or more."""
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(text_column(batch, text_col), shared.value) < threshold))

    return spread(docs).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that training never reads: crc32 of the id as text leaves 2 when divided by 4 (a null id: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
