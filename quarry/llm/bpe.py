"""BPE encoding that reuses content-defined chunks, and decoding.

A rolling hash over the bytes of a text sets chunk ends, so equal passages
of different documents fall into equal chunks wherever they stand. Chunk
hashes are counted over all documents; the chunks that save most work are
encoded once and shared with all tasks, as many as fit in a fixed size; any
other chunk is encoded where it is met, and kept by that task for a while.

A chunk's encoding is right inside, not at its ends, where it may have cut a
word. Each join is repaired: the text from the last white space before to
the first after it is encoded anew, and must come out the same with a
neighbouring word on either side. Where it does not, the repaired stretch
takes in more and more words of the chunk on that side, whose rest is
encoded anew, until it agrees with its new neighbour; where a chunk has no
more words, the document is encoded as a whole.

Defined cases: null is encoded like the empty text, to no tokens. Very long
texts are encoded whole, as is a text without white space. Strings of
special tokens in a text become special tokens, as in the library. Repeated
rows are encoded each. Empty input gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, sha256_hex, share, slices, small_batches

#: Bytes that the rolling hash sees, the chance of an end at a byte, the least bytes of a chunk.
REACH, ENDS, LEAST = 16, 1 << 10, 256
#: Bytes of text of the chunks that all tasks share, and of those that a task keeps.
SHARED_BYTES, KEPT_BYTES = 8_000_000, 8_000_000
#: Bytes of a chunk that is worth sharing at most, and their number at most.
LONGEST_SHARED, SHARED_CHUNKS = 16_384, 20_000
#: Words whose ids a worker keeps at least, and half of those that it keeps at most.
KEPT_WORDS = 120_000
_GEAR = np.random.default_rng(4).integers(0, 2**63, 256, dtype=np.uint64)
_SPACES = b" \t\n\r"


def ends(text: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text, its length last."""
    if len(text) <= LEAST:
        return [len(text)]
    raw = np.frombuffer(text, dtype=np.uint8)
    rolled, width = _GEAR[raw], 1
    while width < REACH:  # h_2w[i] = h_w[i] + (h_w[i - w] << w)
        more = rolled.copy()
        more[width:] += rolled[:-width] << np.uint64(width)
        rolled, width = more, 2 * width
    found, last = [], 0
    for at in (np.flatnonzero((rolled >> np.uint64(20)) & np.uint64(ENDS - 1) == 0) + 1).tolist():
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        if at - last >= LEAST and at < len(text):
            found.append(at)
            last = at
    return [*found, len(text)]


def chunks(text: bytes) -> list[bytes]:
    cut = ends(text)
    return [text[lo:hi] for lo, hi in zip([0, *cut[:-1]], cut, strict=True)] if text else []


class Encoder:
    """The library's encoding, by words where that is known to give the same; ids are packed as bytes of ``kind``."""

    #: Latin text: normal already but for case, and split alike here and in the library.
    LATIN = re.compile(r"[\t\n\v\f\r -~¡-įı-ɏ]*")
    #: The pretokenizer's pattern.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pretokens = regex.compile(self.WORDS).findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # words known before the last KEPT_WORDS came
        self.pieces = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.ending = np.array([p.endswith("</w>") for p in self.pieces])
        self.kind = np.dtype(np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.LATIN.fullmatch(text):
            return self.whole(text)
        words = text.lower().split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > KEPT_WORDS:
                self.before, self.known = known, {}
                known = self.known
            missed = set(words).difference(known)
            known.update({w: self.before[w] for w in missed if w in self.before})
            if new := [w for w in missed if w not in self.before]:
                known.update(zip(new, self._learn(new), strict=True))
        return b"".join(map(known.__getitem__, words))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, from one call: a pretoken's last piece, and no other, carries the end mark."""
        ids = self._ids(" ".join(words))
        last = np.cumsum([1 if w.isalpha() else len(self.pretokens(w)) for w in words])
        stops = np.flatnonzero(self.ending[ids])
        if last[-1] != len(stops):
            return [self.whole(w) for w in words]
        cuts = ((np.append(0, stops[last - 1] + 1)) * self.kind.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False), which joins pieces by spaces."""
        return " ".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One of each worker process, which its tasks take over with the words it knows."""
    return Encoder(path)


_WORD = re.compile(r"[ \t\n\r]+[^ \t\n\r]+")


class Chunk:
    """A chunk with its encoding: head and tail are the words at its ends, encoded alone; the body is all between."""

    __slots__ = ("head", "tail", "inside", "body", "plain")

    def __init__(self, text: str, encode: Callable[[str], bytes], body: bytes | None = None):
        spaces = [i for i in map(text.find, " \t\n\r") if i >= 0]
        self.plain = not spaces
        if self.plain:
            self.head, self.tail, self.inside, self.body = text, "", "", b""
            return
        start, stop = min(spaces), max(map(text.rfind, " \t\n\r"))
        self.head, self.inside, self.tail = text[:start], text[start:stop], text[stop:]
        self.body = encode(self.inside) if body is None else body


def first_words(text: str, n: int) -> int:
    """Where the first n words of a text, and the white space before them, end."""
    at = 0
    for _, found in zip(range(n), _WORD.finditer(text), strict=False):
        at = found.end()
    return at


def last_words(text: str, n: int) -> int:
    """Where the last n words of a text, with the white space before them, begin."""
    at = len(text)
    for _ in range(n):
        end = len(text[:at].rstrip(" \t\n\r"))
        space = max(text.rfind(c, 0, end) for c in " \t\n\r")
        if end <= 0 or space < 0:
            return 0
        at = len(text[:space].rstrip(" \t\n\r"))
    return at


class Coder:
    """Encodes texts from chunks. shared: packed ids of the bodies of chunks."""

    def __init__(self, encode: Encoder, shared: dict[bytes, bytes] | None = None):
        self.encode = encode
        self.shared, self.kept, self.size = shared or {}, {}, 0
        self.widened = self.given_up = 0

    def chunk(self, raw: bytes) -> Chunk:
        found = self.kept.get(raw)
        if found is None:
            found = Chunk(raw.decode("utf-8", "replace"), self.encode, self.shared.get(raw))
            self.size += len(raw)
            if self.size > KEPT_BYTES:
                self.kept, self.size = {}, len(raw)
            self.kept[raw] = found
        return found

    def repair(self, before: list | None, middle: str, after: list | None) -> bytes | None:
        """The ids of the text across a join; None where the bodies beside it have no more words to take in.

        before, after: text and ids of these bodies, cut back as far as needed; None at the ends of a document.
        """
        first, last = before[0] if before else "", after[0] if after else ""
        left, right, stretch, n, m = first, last, middle, 0, 0
        while True:
            found = self.encode(stretch)
            one, other = left[last_words(left, 1) :], right[: first_words(right, 1)]
            alone = self.encode(one), found, self.encode(other)
            if self.encode(one + stretch + other) == b"".join(alone):
                break
            # a side that agrees by itself stays as it is
            n = n if self.encode(one + stretch) == alone[0] + alone[1] else n + 1 + n // 16
            m = m if self.encode(stretch + other) == alone[1] + alone[2] else m + 1 + m // 16
            start, end = last_words(first, n), first_words(last, m)
            if before and not start or after and end >= len(last) or (left, right) == (first[:start], last[end:]):
                return None
            left, stretch, right = first[:start], first[start:] + middle + last[:end], last[end:]
        if n or m:
            self.widened += 1
        for side, rest in ((before, left), (after, right)):
            if side and rest != side[0]:
                side[:] = [rest, self.encode(rest)]
        return found

    def __call__(self, raw: bytes | None) -> bytes:
        bodies: list[list] = []
        stretches = [""]
        for piece in map(self.chunk, chunks(raw or b"")):
            stretches[-1] += piece.head
            if not piece.plain:
                bodies.append([piece.inside, piece.body])
                stretches.append(piece.tail)
        found = [self.repair(before, stretch, after) for before, stretch, after in zip([None, *bodies], stretches, [*bodies, None], strict=True)]
        if None in found:
            self.given_up += 1
            return self.encode.whole(raw.decode("utf-8", "replace"))
        return b"".join([found[0], *(part for (_, ids), stretch in zip(bodies, found[1:], strict=True) for part in (ids, stretch))])


def _hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def shared_chunks(docs: DataFrame, path: str) -> dict[bytes, bytes]:
    """The chunks whose reuse saves most, with the packed ids of their bodies, encoded once each; SHARED_BYTES of text and SHARED_CHUNKS at most."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, list[int]] = {}
            for part in slices(batch):
                for text in as_bytes(part.column(0)):
                    for raw in chunks(text or b""):
                        seen.setdefault(_hash(raw), [len(raw), 0])[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1))], names=["hash", "size", "n"]
            )

    texts = small_batches(docs).select("text")
    counted = texts.mapInArrow(hashed, "hash bigint, size bigint, n bigint").groupBy("hash").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    worth = (
        counted.where((F.col("n") > 1) & (F.col("size") <= LONGEST_SHARED))
        .orderBy(F.desc(F.col("size") * (F.col("n") - 1)), "hash")
        .limit(SHARED_CHUNKS)
        .select("hash", "size")
        .toArrow()
    )
    chosen, total = set(), 0
    for key, size in zip(worth.column(0).to_pylist(), worth.column(1).to_pylist(), strict=True):
        total += size
        if total > SHARED_BYTES:
            break
        chosen.add(key)
    if not chosen:
        return {}
    wanted = share(docs, chosen)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted.value)  # a task sends each chunk once
        for batch in batches:
            found: dict[int, bytes] = {}
            for part in slices(batch):
                for text in as_bytes(part.column(0)) if left else ():
                    for raw in chunks(text or b""):
                        if (key := _hash(raw)) in left:
                            left.discard(key)
                            found[key] = raw
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["hash", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            bodies = [Chunk(raw.decode("utf-8", "replace"), encode).body for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bodies, pa.binary())], names=["chunk", "body"])

    once = texts.mapInArrow(fetched, "hash bigint, chunk binary").dropDuplicates(["hash"])
    rows = once.mapInArrow(encoded, "chunk binary, body binary").toArrow()
    return dict(zip(*(rows.column(c).to_pylist() for c in ("chunk", "body")), strict=True))


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and ids if asked for.

    The digests are of the decimal ids joined by spaces, and of the text that the ids decode to.
    """
    shared = share(docs, shared_chunks(docs, path))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        coder, digits = Coder(encode, shared.value), [str(i) for i in range(len(encode.pieces))]
        for batch in batches:
            for part in slices(batch, 256):
                packed = [np.frombuffer(coder(t), encode.kind) for t in as_bytes(part.column(1))]
                found = [ids.tolist() for ids in packed]
                columns = [
                    part.column(0),
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array([sha256_hex(" ".join(map(digits.__getitem__, ids)).encode()) for ids in found]),
                    pa.array([sha256_hex(encode.decode(ids).encode()) for ids in found]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([ids.astype(np.int32) for ids in packed], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, 256):
                texts = [None if ids is None else coder.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
