"""SimHash fingerprints and the exact components of near-equal ones.

Work is on distinct fingerprints, so copies of a text, however many, are one
row. Every fingerprint gets its row of the pivot table: the Hamming
distances to 16 reference fingerprints, computed once. Two fingerprints at
distance r differ by at most r in every coordinate, so pairs with a larger
coordinate difference are discarded unseen and only survivors are compared
bit by bit.

A departure from the plain pivot table: it does not choose the candidates.
Distances of random fingerprints lie close to 32, so one coordinate within
2 keeps about half of all pairs, and a table alone would look at all pairs
once. Rows meet in partitions first: fingerprints that differ in 2 bits at
most agree in two of four 16-bit blocks, and each of the six choices of two
blocks is a partition key. No pair within reach is lost. A partition
reports links that span its components, never all pairs. In partitions too
large for a pairwise pass the same links come from shared neighbours: two
fingerprints are within 2 bits just when some value is within 1 bit of
both. Partitions beyond one task's memory do that by a shuffle.

Components come from alternating star contractions; every round is written
to the shared folder. Joins on a fingerprint or a node have one row of it on
one side, so where the other side holds very many, adaptive execution
splits them.

Defined cases: a null or empty text, or one of white space, has the zero
fingerprint, linked like any other. Fewer words than a shingle make one
shingle. Very long texts are hashed whole. Repeated rows give a row each.
A null doc_id never becomes a component's id unless there is no other.
Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, drop_marked, forget, only_marked, slices, small_batches, written

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
REACH = 2
REFERENCES = [int(x) for x in np.random.default_rng(20).integers(-(2**63), 2**63, 16, dtype=np.int64)]
BLOCK_PAIRS = list(combinations(range(4), 2))
#: Members up to which a partition is compared by pivot table, and up to which one task takes it.
PAIRWISE, ONE_TASK = 2_000, 200_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """As an unsigned 64-bit number."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    counts, total = np.zeros(64, dtype=np.int64), 0
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in as_bytes(part.column(2))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    rows = small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def _packed_distances(references: list[int]) -> Column:
    """Distances to eight references, a byte each."""
    packed = F.lit(0).cast("bigint")
    for k, ref in enumerate(references):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(ref))).cast("bigint"), 8 * k))
    return packed


def _components(n: int, near) -> np.ndarray:
    """Label of each of n nodes, the smallest place in its component; near(frontier) tells what it touches."""
    label = np.full(n, -1)
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(near(frontier) & (label < 0))
            label[frontier] = root
    return label


def by_pivots(fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Labels of the components of links, pairs being discarded by coordinate difference first.

    fps: uint64; table: the distances, a row of bytes for each fingerprint.
    """
    n, table = len(fps), table.astype(np.int16)
    linked = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 128):
        left = slice(at, at + 128)
        may = np.abs(table[left, None, 0] - table[None, :, 0]) <= REACH
        for k in range(1, table.shape[1]):
            may &= np.abs(table[left, None, k] - table[None, :, k]) <= REACH
        i, j = np.nonzero(may)
        sure = np.bitwise_count(fps[i + at] ^ fps[j]) <= REACH
        linked[i[sure] + at, j[sure]] = True
    return _components(n, lambda frontier: linked[frontier].any(0))


def by_neighbours(fps: np.ndarray, free_bits: list[int]) -> np.ndarray:
    """The same labels from shared values within one bit; only free_bits can differ."""
    flips = np.array([0, *(1 << b for b in free_bits)], dtype=np.uint64)
    values = (fps[:, None] ^ flips[None, :]).ravel()
    owner = np.repeat(np.arange(len(fps)), len(flips))
    order = np.argsort(values, kind="stable")
    ranked, owner = values[order], owner[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(first, len(ranked)))
    label = np.arange(len(fps))
    while True:
        least = np.minimum.reduceat(label[owner], first)
        new = label.copy()
        np.minimum.at(new, owner, np.repeat(least, sizes))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _free_bits(key: int) -> list[int]:
    fixed = BLOCK_PAIRS[key >> 32]
    return [b for b in range(64) if b // 16 not in fixed]


def links(distinct: DataFrame) -> DataFrame:
    """Links a, b that span the components of fingerprints within 2 bits. distinct: column fp, no value twice."""
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = F.array(*(F.lit(k << 32).cast("bigint") + block[i] * 65536 + block[j] for k, (i, j) in enumerate(BLOCK_PAIRS)))
    table = distinct.select("fp", _packed_distances(REFERENCES[:8]).alias("d0"), _packed_distances(REFERENCES[8:]).alias("d1"))
    rows = written(table.select(F.explode(keys).alias("key"), "fp", "d0", "d1"), "keyed")
    sizes = rows.groupBy("key").count().where("count > 1").withColumnRenamed("count", "n")
    met = written(rows.join(sizes, "key"), "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spanning(key: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            fps = columns[0].view(np.uint64)
            if len(fps) > PAIRWISE:
                label = by_neighbours(fps, _free_bits(key))
            else:
                label = by_pivots(fps, np.stack(columns[1:], axis=1).view(np.uint8).reshape(len(fps), 16))
            other = np.flatnonzero(label != np.arange(len(fps)))
            return columns[0][label[other]], columns[0][other]

        def flush(key: np.ndarray, columns: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
            pairs = [spanning(int(key[lo]), [c[lo:hi] for c in columns]) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True)]
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4)]
            if held and held[-1][0][-1] == columns[0][0] == columns[0][-1]:
                held.append(columns)
                continue
            joined = [np.concatenate([h[i] for h in [*held, columns]]) for i in range(4)]
            cuts = np.flatnonzero(joined[0][1:] != joined[0][:-1]) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            held = [[c[done:] for c in joined]]
            if done:
                yield flush(joined[0], joined[1:], cuts)
        if held:
            joined = [np.concatenate([h[i] for h in held]) for i in range(4)]
            yield flush(joined[0], joined[1:], np.array([len(joined[0])]))

    small = met.where(F.col("n") <= ONE_TASK).select("key", "fp", "d0", "d1")
    found = small.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a bigint, b bigint")
    free = F.array(
        *(
            F.array(F.lit(0).cast("bigint"), *(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in _free_bits(k << 32)))
            for k in range(len(BLOCK_PAIRS))
        )
    )
    values = met.where(F.col("n") > ONE_TASK).select(
        "key", "fp", F.explode(F.get(free, F.shiftright("key", 32).cast("int"))).alias("flip")
    )
    # at most 33 fingerprints share a value, so these lists are bounded
    shared = values.groupBy("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    beyond = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return found.unionByName(beyond)


def connected(edges: DataFrame) -> DataFrame:
    """node, root of every node of the undirected edges a, b; root is the smallest node of its component.

    Rounds go on until one changes nothing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state, before = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()), None
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, now = now, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        forget(last)
        before, state = state, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _with_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row."""
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected(links(classes.select("fp"))).toDF("fp", "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    return _with_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, of several by text hash; same columns.

    The keys of the rows to drop are collected, which are fewer than those that stay, and no text is shuffled for them.
    """
    found = written(_with_components(docs), "components")
    # the least (id, text hash) of a component; ids that are null come last
    order = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    first = found.groupBy(group.alias("group")).agg(F.min(order).alias("first")).select(F.col("first.id").alias("id"), F.col("first.hash").alias("hash"))
    keys = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    marks = keys.join(first.withColumn("stays", F.lit(True)), keys["doc_id"].eqNullSafe(first["id"]) & (keys["text_hash"] == first["hash"]), "left")
    marks = written(marks.select("doc_id", "text_hash", "rows", F.col("stays").isNotNull().alias("stays")).where("not stays or rows > 1"), "marks")
    kept = drop_marked(docs, marks.where("not stays").select("doc_id", "text_hash"))
    repeated = marks.where("stays").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return kept
    return drop_marked(kept, repeated).unionByName(only_marked(kept, repeated).dropDuplicates(["doc_id", "text"]))
