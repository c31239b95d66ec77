"""Benchmark decontamination over a positional inverted index.

``index`` builds the index of a corpus, which knows nothing of benchmarks
and can be kept for any number of them. It is partitioned by documents: a
segment is some consecutive documents, with a sorted dictionary of their
terms and the postings of each term, positions that count on through all
documents of the segment. So no posting is shuffled, and a passage that a
third of all rows hold costs no task more than its rows.

``match`` looks windows of consecutive item words up. Document frequencies
of the items' terms are read from the dictionaries; every window starts
from the postings of its rarest term, and those of its other terms, by
rising frequency and adjusted by their offsets, are intersected until none
is left or all agree (an exact phrase). A window whose rarest terms merely
stand near each other is a proximity match. Windows with a term that a
segment lacks are not looked up there. All windows of a segment go through
these steps together, as arrays, in pieces of bounded size.

The items are held by every task, so they are taken in blocks of bounded
size, each a pass over the index; with more than one block the matches of a
document are merged by its place in the index.

Defined cases: a null or empty text has no words and no hits. Items with a
null id, a null text or no word are ignored; an item id given twice has
the windows of both texts. Very long documents are indexed whole, in a
segment of their own. Repeated rows each give a row. With no items nothing
is hit. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, drop_marked, share, slices, small_batches, words_of, written

#: Bytes of texts of a segment, unless one text has more, and characters of items that one pass over the index takes.
SEGMENT_BYTES, BLOCK_CHARS = 1_000_000, 8_000_000
#: Distinct terms of a window that must stand near each other for a proximity match.
NEAR_TERMS = 3
#: Places, and windows, that are looked at together.
PIECE, ROWS = 1 << 20, 1 << 16


class _Numbers(dict):
    """A number for each key, in order of their coming."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _segment(part: pa.RecordBatch) -> dict:
    """Columns of a segment of rows doc_id, text_hash, text."""
    texts, dictionary, numbers, sizes = as_bytes(part.column(2)), _Numbers(), [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        numbers += map(dictionary.__getitem__, words)
    ranked = sorted(dictionary)
    rank = np.empty(len(ranked), np.int32)
    rank[[dictionary[w] for w in ranked]] = np.arange(len(ranked), dtype=np.int32)
    terms = rank[np.array(numbers, np.int32)]
    places = np.argsort(terms, kind="stable").astype(np.int32)
    counts = np.bincount(terms, minlength=len(ranked))
    ends = np.cumsum(counts)
    # the postings of a term run through the documents in order, so each change is a document
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[places]
    new = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    new[(ends - counts)[counts > 0]] = True
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return {
        "doc_ids": part.column(0),
        "text_hashes": part.column(1),
        "n_words": pa.array(sizes, pa.int32()),
        "terms": squeeze(b"\n".join(ranked)),
        "documents": squeeze(np.bincount(terms[places[new]], minlength=len(ranked)).astype(np.int32).tobytes()),
        "postings": squeeze(np.concatenate([counts, np.diff(places, prepend=np.int32(0))]).astype(np.int32).tobytes()),
    }


class Segment:
    """A row of the index, read back."""

    def __init__(self, expand: Callable[[bytes], bytes], terms: bytes, documents: bytes | None = None, postings: bytes | None = None):
        words = expand(terms)
        self.terms = pa.array(words.split(b"\n") if words else [], pa.binary())
        if documents is not None:
            self.documents = np.frombuffer(expand(documents), np.int32)
        if postings is not None:
            flat = np.frombuffer(expand(postings), np.int32)
            self.ends, self.places = np.cumsum(flat[: len(self.terms)]), np.cumsum(flat[len(self.terms) :])


def index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each segment: its documents, its sorted terms, in how many documents each stands, and the postings; the last three packed."""
    kind = dict(docs.dtypes)["doc_id"]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum([len(t) if t else 0 for t in as_bytes(batch.column(2))])
        lo = 0
        while lo < batch.num_rows:
            start = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, start + segment_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_here = 0
        for batch in batches:
            for part in parts(batch):
                made = _segment(part)
                segment, made_here = f"{TaskContext.get().partitionId()}-{made_here}", made_here + 1
                arrays = [pa.array([segment])]
                for name in ("doc_ids", "text_hashes", "n_words"):
                    values = made[name].combine_chunks() if isinstance(made[name], pa.ChunkedArray) else made[name]
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                arrays += [pa.array([made[name]], pa.binary()) for name in ("terms", "documents", "postings")]
                yield pa.RecordBatch.from_arrays(arrays, names=["segment", "doc_ids", "text_hashes", "n_words", "terms", "documents", "postings"])

    rows = small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(
        run,
        f"segment string, doc_ids array<{kind}>, text_hashes array<bigint>, n_words array<int>, terms binary, documents binary, postings binary",
    )


class Windows:
    """The windows of some items: an array of term numbers, a row for each window, -1 beyond the end of a short one."""

    def __init__(self, items: list[tuple[str, bytes]], length: int):
        numbers: dict[bytes, int] = {}
        named: dict[str, int] = {}
        rows, owners = [np.zeros((0, length), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            row = np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], np.int32)
            if not len(row):
                continue
            if len(row) < length:
                row = np.append(row, np.full(length - len(row), -1, np.int32))
            rows.append(np.lib.stride_tricks.sliding_window_view(row, length))
            owners.append(np.full(len(rows[-1]), named.setdefault(item, len(named)), np.int32))
        ranked = sorted(numbers)
        rank = np.full(len(ranked) + 1, -1, np.int32)
        rank[[numbers[w] for w in ranked]] = np.arange(len(ranked), dtype=np.int32)
        #: sorted, as the dictionaries of segments are
        self.terms = ranked
        self.items = list(named)
        flat = rank[np.concatenate(rows)]
        self.windows, which = np.unique(flat, axis=0, return_inverse=True) if len(flat) else (flat, np.zeros(0, int))
        owned = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
        #: items of window k: owner[owner_ends[k - 1] : owner_ends[k]]
        self.owner, self.owner_ends = owned[:, 1].astype(np.int32), np.cumsum(np.bincount(owned[:, 0], minlength=len(self.windows)))
        self.sizes = (self.windows >= 0).sum(1).astype(np.int32)
        self.order = np.zeros(self.windows.shape, np.int8)

    def rank_by(self, frequency: np.ndarray) -> None:
        """Sets the order of offsets, those of rare terms first, and the different terms of each window that are rarest."""
        _, rank = np.unique(frequency, return_inverse=True)
        rank = np.append(rank, len(frequency)).astype(np.int32)  # -1, beyond the end of a window, comes last
        self.rare = np.full((len(self.windows), NEAR_TERMS), -1, np.int32)
        for at in range(0, len(self.windows), ROWS):
            windows = self.windows[at : at + ROWS]
            order = np.argsort(rank[windows], axis=1, kind="stable")
            self.order[at : at + ROWS] = order
            ranked, rare = np.take_along_axis(windows, order, axis=1), self.rare[at : at + ROWS]
            found = np.zeros(len(ranked), np.int64)
            for k in range(ranked.shape[1]):
                term = ranked[:, k]
                fresh = (term >= 0) & (found < NEAR_TERMS) & ~(rare == term[:, None]).any(1)
                rare[fresh, found[fresh]] = term[fresh]
                found += fresh

    def items_of(self, k: int) -> list[str]:
        return [self.items[i] for i in self.owner[self.owner_ends[k - 1] if k else 0 : self.owner_ends[k]]]


def document_frequency(segments: DataFrame, terms: list[bytes]) -> np.ndarray:
    """In how many documents each of the terms stands, read from the dictionaries of all segments."""
    shared = share(segments, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        counts = np.zeros(len(wanted), np.int64)
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for terms, documents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment = Segment(expand, terms, documents)
                at = pa.compute.index_in(wanted, segment.terms)
                known = np.flatnonzero(at.is_valid())
                counts[known] += segment.documents[at.fill_null(0).to_numpy()[known]]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if terms:
        rows = segments.select("terms", "documents").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


class Matcher:
    """Windows against one segment after the other."""

    def __init__(self, windows: Windows, slop: int):
        self.of, self.slop = windows, slop
        self.wanted = pa.array(windows.terms, pa.binary())

    def __call__(self, segment: Segment, n_words: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, window, first word) of exact matches and (document, window) of mere proximity, as rows of two arrays."""
        starts_of = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        ends, places = segment.ends, segment.places
        at = pa.compute.index_in(self.wanted, segment.terms)
        local = np.where(at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(), -1).astype(np.int32)
        self.local = np.append(local, np.int32(-2))  # terms of the segment: -1 is missing, -2 is beyond the end of the window
        windows, order, rarest = self.of.windows, self.of.order, self.of.rare
        self.begin = np.append(0, ends).astype(np.int64)
        self.size = len(places) + 1
        term_of = np.repeat(np.arange(len(ends), dtype=np.int64), np.diff(self.begin))
        self.posted = term_of * self.size + places  # sorted
        self.places = places.astype(np.int64)
        exact, near = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
        for row in range(0, len(windows), ROWS):
            here = slice(row, row + ROWS)
            whole = row + np.flatnonzero((self.local[windows[here]] != -1).all(1))
            for some in self._pieces(whole, self.local[windows[whole, order[whole, 0]]]):
                exact.append(self._phrases(some, starts_of))
            close = row + np.flatnonzero((self.local[rarest[here]] != -1).all(1) & (rarest[here, 1] >= 0))
            for some in self._pieces(close, self.local[rarest[close, 0]]):
                near.append(self._near(some, starts_of))
        exact, near = np.concatenate(exact), np.unique(np.concatenate(near), axis=0)
        n = max(1, len(windows))
        return exact, near[~np.isin(near[:, 0] * n + near[:, 1], exact[:, 0] * n + exact[:, 1])]

    def _pieces(self, windows: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Windows in pieces whose first terms have about PIECE places."""
        total = np.cumsum(self.begin[first + 1] - self.begin[first])
        for piece in np.split(windows, np.flatnonzero(np.diff(total // PIECE)) + 1) if len(windows) else ():
            yield piece

    def _start(self, windows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the first terms of windows: (window, place)."""
        counts = self.begin[first + 1] - self.begin[first]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(self.begin[first], counts)
        return np.repeat(windows, counts), self.places[at]

    def _phrases(self, windows: np.ndarray, starts_of: np.ndarray) -> np.ndarray:
        terms, order = self.of.windows, self.of.order
        which, place = self._start(windows, self.local[terms[windows, order[windows, 0]]])
        start = place - order[which, 0]
        for k in range(1, terms.shape[1]):
            if not len(which):
                break
            offset = order[which, k].astype(np.int64)
            term = self.local[terms[which, offset]].astype(np.int64)
            key = term * self.size + start + offset
            at = np.minimum(np.searchsorted(self.posted, key), len(self.posted) - 1)
            kept = (term == -2) | ((start + offset >= 0) & (start + offset < self.size - 1) & (self.posted[at] == key))
            which, start = which[kept], start[kept]
        doc = np.searchsorted(starts_of, start, side="right") - 1
        inside = (start >= 0) & (start + self.of.sizes[which] <= starts_of[np.minimum(doc + 1, len(starts_of) - 1)])
        return np.stack([doc[inside], which[inside], start[inside] - starts_of[doc[inside]]], axis=1)

    def _near(self, windows: np.ndarray, starts_of: np.ndarray) -> np.ndarray:
        rare = self.of.rare
        which, place = self._start(windows, self.local[rare[windows, 0]])
        doc = np.searchsorted(starts_of, place, side="right") - 1
        lo, hi = np.maximum(place - self.slop, starts_of[doc]), np.minimum(place + self.slop, starts_of[doc + 1] - 1)
        kept = np.ones(len(which), bool)
        for k in range(1, rare.shape[1]):
            term = self.local[rare[which, k]].astype(np.int64)
            at = np.minimum(np.searchsorted(self.posted, term * self.size + lo), len(self.posted) - 1)
            kept &= (term < 0) | ((self.posted[at] >= term * self.size + lo) & (self.posted[at] <= term * self.size + hi))
        return np.unique(np.stack([doc[kept], which[kept]], axis=1), axis=0)


def covered(starts: np.ndarray, sizes: np.ndarray) -> int:
    """Words inside any of the spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], (starts + sizes)[order]
    upto = np.maximum.accumulate(np.append(0, ends))[:-1]
    return int(np.maximum(0, ends - np.maximum(starts, upto)).sum())


def _match_block(segments: DataFrame, items: list[tuple[str, bytes]], length: int, slop: int) -> DataFrame:
    windows = Windows(items, length)
    windows.rank_by(document_frequency(segments, windows.terms))
    shared = share(segments, windows)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    pair = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        match, expand = Matcher(windows, slop), zstandard.ZstdDecompressor().decompress
        for row in (part for batch in batches for part in slices(batch, 1)):
            column = {name: row.column(i)[0] for i, name in enumerate(row.schema.names)}
            n_words = column["n_words"].values.to_numpy()
            exact, near = match(Segment(expand, column["terms"].as_py(), postings=column["postings"].as_py()), n_words)
            by_doc: dict[int, list] = defaultdict(list)
            for doc, k, start in exact[np.lexsort((exact[:, 2], exact[:, 1], exact[:, 0]))].tolist():
                by_doc[doc].append((k, start))
            close: dict[int, list[int]] = defaultdict(list)
            for doc, k in near.tolist():
                close[doc].append(k)
            n_hit, exact_rows, near_rows = [], [], []
            for doc in range(len(n_words)):
                found = by_doc.get(doc, ())
                named = [(item, start, int(windows.sizes[k])) for k, start in found for item in windows.items_of(k)]
                n_hit.append(covered(np.array([s for _, s in found], int), windows.sizes[[k for k, _ in found]]) if found else 0)
                exact_rows.append([{"item_id": i, "start": s, "length": n} for i, s, n in named])
                near_rows.append(sorted({i for k in close.get(doc, ()) for i in windows.items_of(k)} - {i for i, _, _ in named}))
            for at in range(0, len(n_words), 512):
                cut = slice(at, at + 512)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([column["segment"].as_py()] * len(n_words[cut])), pa.array(np.arange(len(n_words), dtype=np.int32)[cut]),
                        column["doc_ids"].values[cut], column["text_hashes"].values[cut], pa.array(n_words[cut].astype(np.int64)),
                        pa.array(n_hit[cut], pa.int64()), pa.array(exact_rows[cut], pair), pa.array(near_rows[cut], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "text_hash", "n_words", "n_hit", "exact", "near"],
                )

    return segments.select("segment", "doc_ids", "text_hashes", "n_words", "terms", "postings").mapInArrow(
        run,
        f"segment string, place int, doc_id {kind}, text_hash bigint, n_words bigint, n_hit bigint, "
        "exact array<struct<item_id:string,start:int,length:int>>, near array<string>",
    )


def match_index(segments: DataFrame, items: DataFrame, length: int = 10, slop: int = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, exact (item, first word, words) and near (items) of every document of an index.

    Windows have ``length`` words, or all words of a shorter item. Terms that
    stand up to ``slop`` words from the rarest one are near it. Item ids come
    back as strings.
    """
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // block_chars) or 1
    found = []
    for k in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.toArrow()
        texts = zip(rows.column(0).to_pylist(), (t.encode() for t in rows.column(1).to_pylist()), strict=True)
        found.append(_match_block(segments, list(texts), length, slop))
    if blocks == 1:
        return found[0].drop("segment", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("segment", "place").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("exact")))).alias("exact"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )
    reach = F.aggregate(
        F.array_sort(F.transform("exact", lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e")))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda a, m: F.struct(
            (a["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(m["s"], a["upto"]))).cast("bigint").alias("n"), F.greatest(a["upto"], m["e"]).alias("upto")
        ),
        lambda a: a["n"],
    )
    near = F.array_sort(F.array_except("near", F.transform("exact", lambda m: m["item_id"])))
    return merged.select("doc_id", "text_hash", "n_words", reach.alias("n_hit"), "exact", near.alias("near"))


def match(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """match_index() over an index of docs that is written to the shared folder."""
    return match_index(written(index(docs), "index"), items, **options)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of an item; same columns."""
    hit = match(docs, items, **options).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    return drop_marked(docs, written(hit, "contaminated"))
