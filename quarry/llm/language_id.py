"""Language identification by known words, backing off to character n-grams.

A word that the model knows is scored by its log frequency in each
language. For any other word the longest order of character n-grams with a
known gram decides: the word's known grams of that order are averaged;
failing all orders the word says nothing. Tables are sorted hashes with the
languages that a word or gram is known in, so that many languages, most of
them rare, cost no more than their words. Words of some texts are scored
together, each different one once.

Defined cases: a null text, or one without a letter, gets ``und`` and score
0; so does every text when there is no labelled row to learn from. Very
long texts are scored whole. Repeated rows are scored each; equal scores go
to the alphabetically first language. Empty input gives an empty result.
Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import share, slices, small_batches

UNDETERMINED = "und"
words_in = regex.compile(r"\p{L}+").findall
#: Words of a text that count as evidence at most, so that scores of long texts stay apart from 1.
EVIDENCE = 30
#: Cells of words by languages that are in memory at a time, about.
CELLS = 1 << 17
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _framed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed code points of ^word$ of all words, and the ends of the words in them."""
    joined = "".join([f"^{w}$" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0x94D049BB133111EB), np.cumsum([len(w) + 2 for w in words], dtype=np.int64)


def _whole(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    begins = np.append(0, ends)[: len(ends)]
    inside = np.arange(len(points)) - np.repeat(begins, np.diff(np.append(0, ends)))
    return np.add.reduceat(points * _POWERS[inside % len(_POWERS)], begins) if len(ends) else np.zeros(0, np.uint64)


def _grams(points: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, and the word of each."""
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        hashes += points[k : len(points) - n + 1 + k] * _POWERS[k + 7]
    sizes = np.diff(np.append(0, ends))
    owner = np.repeat(np.arange(len(ends)), sizes)[: len(hashes)]
    inside = np.arange(len(hashes)) + n <= ends[owner]
    return hashes[inside], owner[inside]


class Table:
    """Log shares of hashed keys in each language: a default by language, and what known pairs differ from it."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, width: int):
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        keys, self.langs = keys[first], langs[first].astype(np.int32)
        own = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.begins = keys[own], np.append(own, len(keys))
        totals = np.bincount(self.langs, weights=counts, minlength=width) + 0.5 * max(1, len(self.keys))
        self.default = np.log(0.5 / totals)
        self.more = (np.log((counts + 0.5) / totals[self.langs]) - self.default[self.langs]).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in places, language, difference) of all known pairs of the keys at places."""
        sizes = self.begins[places + 1] - self.begins[places]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.begins[places], sizes)
        return np.repeat(np.arange(len(places)), sizes), self.langs[at], self.more[at]


class Model:
    """Per-language log frequencies of words (order 0) and of character n-grams."""

    def __init__(self, rows: list[tuple[str, str, int]], orders: int = 5):
        """rows: (language, word, count)."""
        langs, words, counts = ([r[i] for r in rows] for i in range(3))
        self.languages = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.languages)}
        self._count(np.array([place[lang] for lang in langs], np.int32), words, np.array(counts, np.float64), orders)

    @staticmethod
    def of_table(table: pa.Table, orders: int = 5) -> Model:
        """From columns lang, word and n."""
        model = Model.__new__(Model)
        named = table.column("lang").combine_chunks().dictionary_encode()
        model.languages = sorted(named.dictionary.to_pylist())
        place = np.array([model.languages.index(lang) for lang in named.dictionary.to_pylist()], np.int32)
        langs = place[named.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)
        model._count(langs, table.column("word").to_pylist(), table.column("n").to_numpy().astype(np.float64), orders)
        return model

    def _count(self, langs: np.ndarray, words: list[str], counts: np.ndarray, orders: int) -> None:
        points, ends = _framed(words)
        self.tables = [Table(_whole(points, ends), langs, counts, len(self.languages))]
        for n in range(1, orders + 1):
            hashes, owner = _grams(points, ends, n)
            self.tables.append(Table(hashes, langs[owner], 1 + np.log(counts[owner]), len(self.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; zeros for a word that says nothing."""
        width = len(self.languages)
        out = np.zeros((len(words), width))
        points, ends = _framed(words)
        left = np.arange(len(words))

        def add(table: Table, which: np.ndarray, places: np.ndarray, weight: np.ndarray) -> None:
            number, langs, more = table.entries(places)
            out.ravel()[:] += np.bincount(which[number] * width + langs, weights=more * weight[number], minlength=out.size)

        places = self.tables[0].find(_whole(points, ends))
        known = np.flatnonzero(places >= 0)
        add(self.tables[0], known, places[known], np.ones(len(known)))
        out[known] += self.tables[0].default
        open_ = np.ones(len(words), bool)
        open_[known] = False
        for n in range(len(self.tables) - 1, 0, -1):
            if not open_[left].any():
                break
            hashes, owner = _grams(points, ends, n)
            some = open_[owner]
            hashes, owner = hashes[some], owner[some]
            places = self.tables[n].find(hashes)
            some = places >= 0
            places, owner = places[some], owner[some]
            numbers = np.bincount(owner, minlength=len(words))
            add(self.tables[n], owner, places, 1 / np.maximum(1, numbers)[owner])
            out[numbers > 0] += self.tables[n].default
            open_ &= numbers == 0
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found: list[tuple[str, float]] = []
        numbers: dict[str, int] = {}
        held: list[list[int]] = []

        def flush() -> None:
            rows = self.word_scores(list(numbers))
            for at in held:
                if not at:
                    found.append((UNDETERMINED, 0.0))
                    continue
                which, counts = np.unique(at, return_counts=True)
                total = (counts / len(at)) @ rows[which] * min(len(at), EVIDENCE)
                share = np.exp(total - total.max())
                share /= share.sum()
                best = int(share.argmax())
                found.append((self.languages[best], float(share[best])))
            numbers.clear()
            held.clear()

        for text in texts:
            words = words_in(text.lower()) if text and self.languages else ()
            held.append([numbers.setdefault(w, len(numbers)) for w in words])
            if len(numbers) * len(self.languages) > CELLS:
                flush()
        flush()
        return found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_in(text.lower()))
        columns = zip(*((lang, w, n) for (lang, w), n in counts.items()), strict=True) if counts else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])


def train(docs: DataFrame, where: Column | None = None, rows_per_language: int = 2000, max_rows: int = 20_000) -> Model:
    """A model of all languages, from rows with a text and a language.

    Fitted on a bounded sample of these rows, drawn by a hash of doc_id: about
    ``rows_per_language`` of each language, or as many as ``max_rows`` give
    each, at least one. All words of the sample count.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if where is not None:
        rows = rows.where(where)
    sizes = rows.groupBy("lang").count().cache()
    languages = sizes.count()
    if not languages:
        return Model([])
    wanted = min(rows_per_language, max(1, max_rows // languages))
    rates = sizes.select("lang", (F.lit(float(wanted)) / F.col("count")).alias("quarry_rate"))
    if languages <= max_rows:
        rates = F.broadcast(rates)
    drawn = rows.join(rates, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("quarry_rate") * 1_000_003)
    counted = small_batches(drawn).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    sizes.unpersist()
    return Model.of_table(words)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = share(docs, model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shared.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """docs without the rows that are undetermined or scored under ``min_score``; same columns."""
    shared = share(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shared.value.scores(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and s >= min_score for lang, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
