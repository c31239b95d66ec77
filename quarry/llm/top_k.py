"""Exact top-k inner products by a Voronoi join.

Vectors are grouped around pivots. A group's summary holds its number of
ids, each counted in one group only, and the largest distance of a member
from the pivot, which bounds the inner product of any query with any member
from both sides. From the summaries every query group learns a score that
each of its queries reaches k times for sure, and which data groups cannot
beat it. Neighbouring data groups are packed into blocks of bounded size, a
larger group is cut into several. A query goes, once, to each block with a
group that can still beat its own k-th score on a sample of the data. Queries
of a block are cut likewise; a task solves one block of data and one of
queries, and the bests are merged. Vectors travel in the smallest numbers
that hold them.

How much is ruled out depends on the data: in many dimensions, where vectors
point everywhere alike, nearly nothing; pruned() tells the share.

Defined cases: rows with a null vec_id, a null vector, or null or non-finite
components take no part. Vectors of different lengths are never compared.
Ties go to the smaller vec_id. A vec_id that stands on several rows counts
once, with its best score, as candidate and as query; a query is never its
own candidate. With fewer than k candidates all are returned. Scores
outside the range of a long are cut to it. Empty input gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import share, small_batches, written

#: Rows of the sample at most, and bytes of vectors in a block of data and of queries.
SAMPLE, DATA_BYTES, QUERY_BYTES = 1024, 32_000_000, 4_000_000
MOST_PIVOTS = 1024
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def _packed(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of whole numbers, given one after the other, as bytes of the smallest type that holds them all."""
    most = float(np.abs(flat).max(initial=0))
    kind = np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
    offsets = np.append(0, ends * kind.itemsize)
    if offsets[-1] >= 2**31:
        raise ValueError("an Arrow batch of vectors is too large")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.astype(kind).tobytes())])


def _matrix(rows, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows of doubles."""
    rows = list(rows)
    out = np.zeros((len(rows), dim))
    sizes = np.array([len(r) for r in rows], dtype=int) // max(1, dim)
    for size, kind in ((2, np.int16), (4, np.int32), (8, np.float64)):
        some = np.flatnonzero(sizes == size)
        if dim and len(some):
            out[some] = np.frombuffer(b"".join([rows[i] for i in some]), dtype=kind).reshape(len(some), dim)
    return out


def quantise(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """vec_id, dim, vec (packed floor(scale * x)) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            begins, ends = (column.offsets.to_numpy()[k : k + len(column)].astype(np.int64) for k in (0, 1))
            x = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            faults = np.append(0, np.cumsum(~np.isfinite(x)))  # nulls come as nan
            kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (faults[ends] == faults[begins]))
            sizes = (ends - begins)[kept]
            upto = np.cumsum(sizes)
            at = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - sizes, sizes) + np.repeat(begins[kept], sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int32()), _packed(np.floor(x[at] * scale), upto)], names=["vec_id", "dim", "vec"]
            )

    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("vec_id"), vector_column)
    return small_batches(rows).mapInArrow(run, "vec_id bigint, dim int, vec binary")


def _pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)[0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    best = gap.argmin(1)
    return best, np.sqrt(((x - centres[best]) ** 2).sum(1))


def _group(pivots: dict[int, np.ndarray], rows: DataFrame) -> DataFrame:
    """Rows with their cell and the distance from its pivot. Lengths without a pivot have the zero vector."""
    shared = share(rows, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            cell, gap = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                for part in np.array_split(some, -(-len(some) // 2048)):
                    centres = shared.value.get(int(dim), np.zeros((1, int(dim))))
                    cell[part], gap[part] = _nearest(_matrix([raw[i] for i in part], int(dim)), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=["vec_id", "dim", "vec", "cell", "gap"])

    return rows.mapInArrow(run, "vec_id bigint, dim int, vec binary, cell int, gap double")


def open_groups(pivots: np.ndarray, data: dict[int, tuple[int, float]], queries: dict[int, float], k: int) -> dict[int, list[int]]:
    """For each query group the data groups that its summary cannot rule out.

    data: number of ids (each counted in one cell only) and radius by cell;
    queries: radius by cell. For q = p + a and x = r + b the product lies within |p||b| + |r||a| + |a||b| of p.r.
    """
    cells = sorted(data)
    centres = pivots[cells]
    length = np.linalg.norm(centres, axis=1)
    sizes, radius = np.array([data[c][0] for c in cells]), np.array([data[c][1] for c in cells])
    open_for = {}
    for c, reach in queries.items():
        middle = centres @ pivots[c]
        spread = (np.linalg.norm(pivots[c]) * radius + length * reach + radius * reach) * (1 + 1e-9) + 1e-6
        low = middle - spread
        order = np.argsort(-low)
        enough = np.flatnonzero(np.cumsum(sizes[order]) >= k + 1)  # one of them may be the query itself
        sure = _cut(low[order[enough[0]]]) if len(enough) else -np.inf
        open_for[c] = [cells[i] for i in np.flatnonzero(_cut(middle + spread) >= sure)]
    return open_for


def _cut(scores):
    """Scores as far as a long reaches, beyond which all count as equal."""
    return np.clip(scores, float(_LOWEST), float(_HIGHEST))


def blocks(pivots: np.ndarray, sizes: dict[int, int], dim: int) -> np.ndarray:
    """The block of each cell: neighbouring cells together, as many as DATA_BYTES hold, a larger one by itself.

    Cells follow each other by their pivots' place along the line from the first pivot to the one farthest from it.
    """
    far = pivots[((pivots - pivots[0]) ** 2).sum(1).argmax()] - pivots[0]
    found, block, held = np.zeros(len(pivots), np.int32), 0, 0
    for c in np.argsort(pivots @ far, kind="stable"):
        size = sizes.get(int(c), 0) * max(1, dim) * 8
        if held and held + size > DATA_BYTES:
            block, held = block + 1, 0
        found[c] = block
        held += size
    return found


class Ways:
    """To which blocks a query goes. By dim: pivots, radius and block of each cell, open cells by query cell, and a sample (ids, vectors)."""

    def __init__(self, k: int, pivots: dict, radius: dict, block: dict, open_for: dict, sample: dict):
        self.k, self.pivots, self.radius, self.block, self.open_for, self.sample = k, pivots, radius, block, open_for, sample

    def cells(self, dim: int, cell: int, query_id: int, q: np.ndarray) -> np.ndarray:
        """The data groups that can hold one of the k best; a length without pivots has group 0 alone."""
        if dim not in self.pivots:
            return np.zeros(1, np.int64)
        ids, known = self.sample[dim]
        scores = (known @ q)[ids != query_id]
        bar = _cut(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]) if len(scores) >= self.k else -np.inf
        may = np.asarray(self.open_for[dim][cell], np.int64)
        best = self.pivots[dim][may] @ q + np.linalg.norm(q) * self.radius[dim][may]
        return may[_cut(best * (1 + 1e-9 * np.sign(best)) + 1e-6) >= bar]

    def blocks(self, dim: int, cells: np.ndarray) -> np.ndarray:
        return np.unique(self.block[dim][cells]) if dim in self.block else cells


def _send(queries: DataFrame, ways: Ways) -> DataFrame:
    """A row of each query for each block with a group that can hold one of its k best, and the number of these groups."""
    shared = share(queries, ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = shared.value
        for batch in batches:
            ids, dims, cells = (batch.column(i).to_numpy() for i in (0, 1, 3))
            raw, rows, targets, groups = batch.column(2).to_pylist(), [], [], []
            for i, dim in enumerate(dims.tolist()):
                kept = ways.cells(dim, int(cells[i]), int(ids[i]), _matrix([raw[i]], dim)[0])
                to = ways.blocks(dim, kept)
                rows += [i] * len(to)
                targets += to.tolist()
                groups += [len(kept)] + [0] * (len(to) - 1) if len(to) else []
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(targets, pa.int32()), pa.array(groups, pa.int32()), batch.column(2).take(picked)],
                names=["vec_id", "dim", "block", "groups", "vec"],
            )

    return queries.mapInArrow(run, "vec_id bigint, dim int, block int, groups int, vec binary")


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products, as int64."""
    reach = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if reach < 2**53:
        return (left @ right.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in right]
    return np.array(
        [[min(max(sum(int(a) * b for a, b in zip(x, y, strict=True)), _LOWEST), _HIGHEST) for y in whole] for x in left], dtype=np.int64
    ).reshape(len(left), len(right))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best distinct ids of each query among the data."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out = []
    for at in range(0, len(queries), 64):
        scores = products(queries[at : at + 64], data)
        if len(first) < len(ids):
            scores = np.maximum.reduceat(scores, first, axis=1)
        for query_id, row in zip(query_ids[at : at + 64], scores, strict=True):
            names = ids[first]
            if len(other := np.flatnonzero(names != query_id)) < len(names):
                names, row = names[other], row[other]
            if len(row) > k:
                some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                names, row = names[some], row[some]
            top = np.lexsort((names, -row.astype(object) if len(row) and row.min() == _LOWEST else -row))[:k]
            out += [(int(query_id), int(names[i]), int(row[i])) for i in top]
    return out


def _sent(vectors: DataFrame, k: int, every: int, scale: float, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame, int]:
    """Data with dim and block, queries with every block they go to, and the number of groups."""
    rows = written(quantise(vectors, id_column, vector_column, scale), "vectors")
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).toArrow()
    sample, pivots = {}, {}
    dims = np.array(drawn.column("dim").to_pylist(), dtype=int)
    ids, raw = np.array(drawn.column("vec_id").to_pylist(), dtype=np.int64), drawn.column("vec").to_pylist()
    for dim in np.unique(dims).tolist():
        some = np.flatnonzero(dims == dim)
        known = _matrix([raw[i] for i in some], dim)
        _, single = np.unique(ids[some], return_index=True)  # an id counts once in a bar
        sample[dim] = (ids[some][single], known[single])
        pivots[dim] = _pivots(known, min(MOST_PIVOTS, max(16, int((total / 50) ** 0.5))))

    grouped = written(_group(pivots, rows), "groups")
    is_query = F.col("vec_id") % every == 0
    # summaries of the lengths with pivots: no more groups than rows in the sample
    held = grouped.where(F.col("dim").isin(list(pivots))) if len(pivots) < SAMPLE else grouped
    # an id counts once, in the least of its groups
    single = held.groupBy("dim", "vec_id").agg(F.min("cell").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("ids"))
    summary = held.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.max(F.when(is_query, F.col("gap"))).alias("reach"))
    summary = summary.join(single, ["dim", "cell"], "left").select("dim", "cell", "n", F.coalesce("ids", F.lit(0)).alias("ids"), "radius", "reach")
    of: dict[int, dict] = {}
    for r in summary.where(F.col("dim").isin(list(pivots))).collect():
        of.setdefault(r["dim"], {})[r["cell"]] = r
    radius, block, open_for = {}, {}, {}
    for dim, cells in of.items():
        radius[dim] = np.array([cells[c]["radius"] if c in cells else 0.0 for c in range(len(pivots[dim]))])
        block[dim] = blocks(pivots[dim], {c: r["n"] for c, r in cells.items()}, dim)
        open_for[dim] = open_groups(
            pivots[dim], {c: (r["ids"], r["radius"]) for c, r in cells.items()}, {c: r["reach"] for c, r in cells.items() if r["reach"] is not None}, k
        )
    sent = written(_send(grouped.where(is_query), Ways(k, pivots, radius, block, open_for, sample)), "queries")
    table = [(dim, c, int(b)) for dim, of_cells in block.items() for c, b in enumerate(of_cells)]
    named = F.broadcast(vectors.sparkSession.createDataFrame(table, "dim int, cell int, block int"))
    data = grouped.join(named, ["dim", "cell"], "left").select("dim", F.coalesce("block", F.lit(0)).alias("block"), "vec_id", "vec")
    return data, sent, sum(map(len, of.values()))


def pruned(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """The share of pairs of a query and a data group that bounds rule out."""
    _, sent, groups = _sent(vectors, k, every, scale, id_column, vector_column)
    row = sent.agg(F.sum("groups").alias("met"), F.count_distinct("vec_id").alias("queries")).first()
    return 1 - row["met"] / max(1, groups * row["queries"]) if row["queries"] else 0.0


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Queries: the rows whose id is divisible by ``every``."""
    data, sent, _ = _sent(vectors, k, every, scale, id_column, vector_column)
    wanted = sent.groupBy("dim", "block").agg(F.count("*").alias("asked"))
    held = data.groupBy("dim", "block").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.col("dim") * 8)
    cuts = wanted.join(held, ["dim", "block"]).select(
        "dim", "block", F.ceil(F.col("n") * size / DATA_BYTES).cast("int").alias("data_parts"), F.ceil(F.col("asked") * size / QUERY_BYTES).cast("int").alias("query_parts")
    )
    mine = lambda parts: F.pmod(F.xxhash64("vec_id"), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    data = data.join(cuts, ["dim", "block"]).select("dim", "block", mine("data_parts").alias("i"), all_of("query_parts").alias("j"), "vec_id", "vec")
    asked = sent.join(cuts, ["dim", "block"]).select("dim", "block", all_of("data_parts").alias("i"), mine("query_parts").alias("j"), "vec_id", "vec")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dim = int(key[0])
            found = best(left["vec_id"].to_numpy(), _matrix(left["vec"], dim), right["vec_id"].to_numpy(), _matrix(right["vec"], dim), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["dim", "block", "i", "j"]
    found = asked.groupBy(keys).cogroup(data.groupBy(keys)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
