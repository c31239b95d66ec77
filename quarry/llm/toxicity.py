"""Toxicity by averaged subword embeddings and a softmax over two classes.

A word is the bag of its character n-grams (bytes of the lower-cased UTF-8,
hashed to buckets). The vectors of the n-grams of a span of consecutive
words are averaged, a repeated word adding to the sum once but to the number
each time, and given to a linear softmax; vectors and softmax are
trained together by stochastic gradient descent in numpy. As n-grams are
shared, a misspelling that was never seen still lies near its word. A
document scores as its worst span, so that a long clean text cannot hide
one insult; a logistic fit on the training rows turns that into a
probability.

Defined cases: null and empty texts, and texts without a word, get the score
of a document in which nothing was found. Very long texts are scored whole.
Without any labelled row, or with labels of one class only, every score is
the share of toxic labels (0 if none), and the filter rejects nothing. Repeated rows are scored each; a
doc_id that is labelled twice is toxic if any of its labels is 1. Empty
input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import share, slices, written

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 17
SPAN = 12
#: Bytes of words; all others part words.
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True
_WORD[0x80:] = True


def _framed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with single spaces around words, and the number of words of each text."""
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
            inside = _WORD[raw]
            keep = inside.copy()
            keep[1:] |= inside[:-1]
            words = np.where(inside, raw, 32)[keep].tobytes().split()
            if not words:
                continue
            counts[i] = len(words)
            parts.append(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8))
    data = np.concatenate([np.full(1, 32, np.uint8), *parts]) if parts else np.full(1, 32, np.uint8)
    return data, counts


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and the word it belongs to; n-grams never cross a word's frame."""
    spaces = np.cumsum(data == 32)
    codes = data.astype(np.uint64)
    buckets, owners = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        mixed = np.full(m, 14695981039346656037 % (1 << 63), dtype=np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[k : k + m]) * np.uint64(1099511628211)
        mixed ^= mixed >> np.uint64(29)
        # no space inside: the spaces up to the last but one byte are those up to the first byte
        whole = spaces[n - 2 : n - 2 + m] == spaces[:m]
        buckets.append((mixed[whole] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(spaces[:m][whole] - 1)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


_POWERS = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15, dtype=np.uint64))
_MARKS = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)


def _last_seen(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the place of the same word before it in its text, far below 0 where there is none."""
    ends = np.flatnonzero(data[1:] == 32) + 1
    begins = np.append(1, ends[:-1] + 1)[: len(ends)]
    inside = np.arange(len(data)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(data)]])))
    names = np.add.reduceat(_MARKS[data] * _POWERS[inside % len(_POWERS)], begins) if len(ends) else np.zeros(0, np.uint64)
    names = names * np.uint64(31) + np.repeat(np.arange(len(counts)), counts).astype(np.uint64) * _POWERS[5]
    order = np.argsort(names, kind="stable")
    last = np.full(len(names), -(1 << 40))
    same = names[order[1:]] == names[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    return last


class Model:
    """What scoring needs: each bucket's part in the logit, and the two steps to a probability."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0, share: float = 0.0):
        self.weights, self.bias, self.slope, self.shift, self.share = weights, bias, slope, shift, share

    def peaks(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of a span of each text; the bias alone where there is no word."""
        data, counts = _framed(texts)
        buckets, owners = _grams(data)
        total = int(counts.sum())
        out = np.full(len(texts), self.bias)
        if not total:
            return out
        of_word = np.bincount(owners, weights=self.weights[buckets], minlength=total)[:total]
        sizes = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=total)[:total])])
        # a word adds to the spans that begin after its last occurrence and hold it
        place = np.arange(total)
        first = np.concatenate([[0], np.cumsum(counts)])
        begin = np.maximum(np.maximum(place - SPAN + 1, _last_seen(data, counts) + 1), np.repeat(first[:-1], counts))
        steps = np.bincount(begin, weights=of_word, minlength=total + 1) - np.bincount(place + 1, weights=of_word, minlength=total + 1)
        sums = np.cumsum(steps)
        for i, n in enumerate(counts):
            if n:
                width = min(SPAN, int(n))
                starts = np.arange(first[i], first[i] + n - width + 1)
                out[i] = (sums[starts] / np.maximum(1, sizes[starts + width] - sizes[starts])).max() + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.peaks(texts) + self.shift, -50, 50)))


#: Texts whose n-grams are in memory at a time.
PIECE = 64


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training spans of SPAN words: (n-gram buckets by span, first place of each span and the end, n-grams repeats included, text of each span)."""
    found, kept_sizes, sizes, owners_of = [], [], [], []
    for at in range(0, len(texts), PIECE):
        data, counts = _framed(texts[at : at + PIECE])
        buckets, owners = _grams(data)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.repeat(np.arange(len(counts)), counts)
        n_spans = -(-counts // SPAN)
        base = np.concatenate([[0], np.cumsum(n_spans)])
        place = np.arange(int(counts.sum())) - firsts[:-1][text_of]
        span_of_word = base[:-1][text_of] + place // SPAN
        new = _last_seen(data, counts) < np.arange(len(place)) - place % SPAN
        span_of_gram = span_of_word[owners] if len(owners) else np.zeros(0, np.int64)
        kept = new[owners] if len(owners) else np.zeros(0, bool)
        found.append(buckets[kept][np.argsort(span_of_gram[kept], kind="stable")])
        kept_sizes.append(np.bincount(span_of_gram[kept], minlength=int(base[-1])))
        sizes.append(np.bincount(span_of_gram, minlength=int(base[-1])))
        owners_of.append(at + np.repeat(np.arange(len(counts)), n_spans))
    starts = np.concatenate([[0], np.cumsum(np.concatenate(kept_sizes))])
    return np.concatenate(found), starts, np.concatenate(sizes), np.concatenate(owners_of)


def fit(texts: list[str], labels: list[int], dim: int = 8, seed: int = 7, share: float | None = None) -> Model:
    """Vectors and softmax trained together.

    First every span carries its document's label. Then, with what was
    learnt, toxic documents keep as toxic only spans near their worst one, and
    training goes on, so that clean spans of toxic documents stop counting.
    """
    toxic = np.asarray(labels) == 1
    share = float(toxic.mean()) if share is None and len(toxic) else share or 0.0
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(None, share=share)
    rng = np.random.default_rng(seed)
    buckets, starts, weight, text_of = _spans(texts)
    filled = np.flatnonzero(np.diff(starts) > 0)
    if not len(filled):
        return Model(None, share=share)
    epochs = max(3, min(20, 60_000 // len(filled)))  # few spans need more rounds
    vectors = (rng.random((BUCKETS, dim), dtype=np.float32) - 0.5) / dim
    soft = np.zeros((dim, 2), dtype=np.float32)
    offset = np.zeros(2, dtype=np.float32)
    squares_v, squares_s, squares_o = np.full(BUCKETS, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def epoch(spans: np.ndarray, target: np.ndarray, rate: float) -> None:
        for some in np.array_split(rng.permutation(len(spans)), max(1, len(spans) // 256)):
            chosen = spans[some]
            sizes = starts[chosen + 1] - starts[chosen]
            row = np.repeat(np.arange(len(chosen)), sizes)
            ends = np.cumsum(sizes)
            gram = buckets[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[chosen], sizes)]
            whole = weight[chosen, None]
            mean = np.add.reduceat(vectors[gram], ends - sizes, axis=0) / whole
            logits = mean @ soft + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), target[some]] -= 1
            back = (p @ soft.T / whole).astype(np.float32)
            grad = mean.T @ p / len(chosen)
            squares_s[...] += grad**2
            soft[...] -= rate * grad / np.sqrt(squares_s)
            grad = p.mean(0)
            squares_o[...] += grad**2
            offset[...] -= rate * grad / np.sqrt(squares_o)
            which, place = np.unique(gram, return_inverse=True)
            by_bucket = np.stack([np.bincount(place, weights=back[row, d], minlength=len(which)) for d in range(dim)], axis=1)
            squares_v[which] += (by_bucket**2).mean(1)
            vectors[which] -= (rate * by_bucket / np.sqrt(squares_v[which])[:, None]).astype(np.float32)

    def logits_of_spans() -> np.ndarray:
        side = vectors @ (soft[:, 1] - soft[:, 0])
        mean = np.zeros(len(starts) - 1)
        for at in range(0, len(mean), 1 << 15):
            cut = starts[at : at + (1 << 15) + 1]
            sums = np.concatenate([[0.0], np.cumsum(side[buckets[cut[0] : cut[-1]]], dtype=np.float64)])[cut - cut[0]]
            mean[at : at + len(cut) - 1] = np.diff(sums) / np.maximum(1, weight[at : at + len(cut) - 1])
        return mean + float(offset[1] - offset[0])

    target = toxic[text_of].astype(np.int64)
    for _ in range(epochs):
        epoch(filled, target[filled], 0.1)
    for _ in range(epochs):
        logit = logits_of_spans()
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text_of[filled], logit[filled])
        floor = np.median(worst[~toxic & np.isfinite(worst)]) if (~toxic & np.isfinite(worst)).any() else -np.inf
        middle = (worst[text_of] + floor) / 2
        sure = filled[(target[filled] == 0) | (logit[filled] >= middle[filled])]
        epoch(sure, target[sure], 0.1)
    side = (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
    model = Model(side, float(offset[1] - offset[0]), share=share)
    peaks = np.concatenate([model.peaks(texts[at : at + PIECE]) for at in range(0, len(texts), PIECE)])
    _calibrate(model, peaks, toxic, share)
    return model


def _calibrate(model: Model, x: np.ndarray, toxic: np.ndarray, share: float) -> None:
    """Logistic fit of the label on the peak, with classes weighted to the share of toxic labels at large."""
    center, scale = float(np.median(x)), float(x.std()) or 1.0
    z = (x - center) / scale
    share = min(max(share, 0.01), 0.99)
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        gap, curve = weight * (p - toxic), weight * p * (1 - p)
        g = np.array([(gap * z).sum() + 0.05 * a, gap.sum()])
        h = np.array([[(curve * z * z).sum() + 0.05, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -3, 3)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = max(a, 1e-3) / scale, b - max(a, 1e-3) * center / scale


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows_per_class: int = 1500, chars_per_class: int = 10_000_000) -> Model:
    """A model from the rows that have both a text and a label.

    Fitted on a bounded sample of these: of either class the rows first by a
    hash of doc_id, ``rows_per_class`` at most and as many as have
    ``chars_per_class`` characters together, but one at least.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids and lengths meet the labels; only then is drawn, so that labels without a document cost no place
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("chars"))
    both = written(known.join(sizes, "doc_id").select("doc_id", "toxic", "chars"), "labelled")
    counts = {r["toxic"]: r["count"] for r in both.groupBy("toxic").count().collect()}
    rows, order = [], (F.xxhash64("doc_id"), "doc_id", "chars")
    parts = [both.where(F.col("toxic") == label).orderBy(*order).limit(rows_per_class) for label in (0, 1)]
    named: dict = {}
    left = {0: chars_per_class, 1: chars_per_class}
    for r in parts[0].unionByName(parts[1]).collect():
        if left[r["toxic"]] > 0 and (r["chars"] <= left[r["toxic"]] or left[r["toxic"]] == chars_per_class):
            named[r["doc_id"]] = r["toxic"]
            left[r["toxic"]] -= r["chars"]
    if named:
        ids = docs.sparkSession.createDataFrame([(i,) for i in named], f"doc_id {dict(docs.dtypes)['doc_id']}")
        found = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
        found = found.select("doc_id", "text").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text").toArrow()
        rows = [(text, named[i]) for i, text in zip(*(found.column(c).to_pylist() for c in ("doc_id", "text")), strict=True)]
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([t for t, _ in rows], [y for _, y in rows], share=share)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = share(docs, model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                scores = shared.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without rows that score ``threshold`` or more; same columns. All rows where nothing could be learnt."""
    if model.weights is None:
        return docs
    shared = share(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                scores = shared.value.scores(part.column(at).to_pylist())
                yield part.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
