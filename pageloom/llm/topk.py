"""Exact top-k inner products of integer vectors: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are sorted by length and packed into blocks. The longest blocks of all give each query a first bar; a block of queries
is then only paired with candidate blocks whose longest vector can reach the bar of one of them, so other pairs are never moved.
Each block of queries meets its candidate blocks from the longest on and keeps its best k so far. A block is skipped
for the queries that its longest vector cannot help; for the others the first coordinates after a rotation to the principal axes,
which carry most of a vector's length, give a partial sum, and the lengths of what is left bound the rest. Only pairs whose bound
reaches the query's k-th score are summed, in integers. Bounds have a slack for rounding, so nothing is lost.

The queries are a stated set: a block of them is sent once to each of its tasks, ahead of the candidate blocks that it meets there.
A task holds two blocks and k results per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import stage

# components of queries that travel together, and the queries among them that are compared at a time
QUERY_BLOCK = 1 << 21
COMPARED = 2048
BLOCK = 1024
SEEDS = 4
_SLACK = 1e-9

_BLOCKS = "block long, longest double, width int, ids binary, rows binary, numbers binary"


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, factor: int, is_query: Column) -> DataFrame:
    """(id, row, v, length, is_query): floor(factor * component), without rows that have a null, non-finite or no vector or id.

    ``row`` tells rows apart that repeat an id or a vector. Written down, as both sides of the search must see the same numbers.
    """
    v = F.col(vector_column)
    clean = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    numbers = F.transform(v, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    rows = vectors.filter(v.isNotNull() & F.coalesce(clean, F.lit(False)) & F.col(id_column).isNotNull())
    rows = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        numbers.alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return stage(rows.withColumn("length", F.sqrt(squares)), "vectors")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Principal axes, largest first: the right singular vectors of all rows, from the sum of outer products."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _matrix(batch.column(0), width).astype(float)
            v /= max(1.0, np.abs(v).max(initial=0))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = rows.select("v").mapInArrow(outer, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    total = np.zeros(width * width)
    for row in sums.groupBy("at").agg(F.sum("x").alias("x")).collect():  # width squared numbers
        total[row["at"]] = row["x"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def _blocked(rows: DataFrame, width: int, size: int) -> DataFrame:
    """The rows from the longest on, packed ``size`` to a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield packed(whole.slice(0, size))
                rest = whole.slice(size)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield packed(pa.Table.from_batches(held))

    def packed(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        longs = lambda name: part.column(name).to_numpy().astype(np.int64).tobytes()
        numbers = _matrix(part.column("v").chunk(0), width)
        small = np.abs(numbers).max(initial=0) < 1 << 31
        values = [0, float(part.column("length")[0].as_py()), 4 if small else 8, longs("id"), longs("row")]
        values.append(numbers.astype(np.int32 if small else np.int64).tobytes())
        types = [pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], "block longest width ids rows numbers".split())

    ranged = rows.repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
    blocks = ranged.select("id", "row", "v", "length").mapInArrow(pack, _BLOCKS)
    return stage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


class Best:
    """The k best candidates so far of each query of a block; ``ids`` are what tells a query's own row."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.numbers, self.k = ids, numbers, k
        self.head = max(1, numbers.shape[1] // 4)
        self.axes = axes[:, : self.head]
        self.heads, self.lengths, self.rests = self._turned(numbers)
        self.least = np.full(len(ids), -np.inf)
        self.found = [np.zeros(0, np.int64)] * 3  # query, candidate id, score
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _turned(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = numbers.astype(float)
        heads = plain @ self.axes
        squares = (plain * plain).sum(axis=1)
        rests = np.sqrt(np.maximum(0, squares - (heads * heads).sum(axis=1)) + _SLACK * squares)
        return heads, np.sqrt(squares), rests

    def meet(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Candidates by id; ``rows`` tells which is a query's own, the ids themselves without it."""
        rows = ids if rows is None else rows
        if not len(ids) or not len(self.ids):
            return
        heads, lengths, rests = self._turned(numbers)
        slack = 1 + _SLACK
        queries = np.flatnonzero(self.lengths * lengths.max() * slack >= self.least)
        if not len(queries):
            return
        bounds = self.heads[queries] @ heads.T + np.outer(self.rests[queries], rests)
        margin = _SLACK * np.outer(self.lengths[queries], lengths) + 1e-6
        at, c = np.nonzero(bounds + margin >= self.least[queries][:, None])
        q = queries[at]
        exact_floats = self.lengths.max() * lengths.max() < 2**52
        kind = float if exact_floats else np.int64
        if len(q) > 0.1 * len(self.ids) * len(ids):
            scores = (self.numbers.astype(kind) @ numbers.astype(kind).T)[q, c].astype(np.int64)
        else:
            scores = np.zeros(len(q), np.int64)
            for low in range(0, len(q), 1 << 17):
                part = slice(low, low + (1 << 17))
                scores[part] = np.einsum("ij,ij->i", self.numbers[q[part]].astype(kind), numbers[c[part]].astype(kind)).astype(np.int64)
        kept = (scores >= self.least[q]) & (rows[c] != self.ids[q])
        self.new.append((q[kept], ids[c[kept]], scores[kept]))
        self._reduce()

    def _reduce(self) -> None:
        q, c, s = (np.concatenate([own, *(n[i] for n in self.new)]) for i, own in enumerate(self.found))
        self.new = []
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        begins = np.searchsorted(q, np.arange(len(self.ids) + 1))
        place = np.arange(len(q)) - begins[q]
        kept = place < self.k
        last = place == self.k - 1
        bar = s[last].astype(float)
        # beyond 52 bits the bar is a little lower than the score, which only keeps more
        self.least[q[last]] = bar - np.where(np.abs(bar) < 2**52, 0, np.abs(bar) * 2.0**-50)
        self.found = [q[kept], c[kept], s[kept]]


def _open(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, numbers, rows of a block"""
    numbers = np.frombuffer(row["numbers"], dtype=np.int32 if row["width"] == 4 else np.int64).astype(np.int64)
    ids, rows = (np.frombuffer(row[name], dtype=np.int64) for name in ("ids", "rows"))
    return ids, numbers.reshape(len(ids), width), rows


def _with_bars(asked: DataFrame, axes: Broadcast, seeds: Broadcast, k: int, width: int) -> DataFrame:
    """The query blocks with ``bars``, a score per query that its k-th best cannot be below, and ``reach``: no candidate
    shorter than that can be among the best of any query of the block."""

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_open(seed, width) for seed in seeds.value]
        for batch in batches:
            for row in batch.to_pylist():
                _, numbers, rows = _open(row, width)
                found, reach = [], np.inf
                for low in range(0, len(rows), COMPARED):
                    bar = Best(rows[low : low + COMPARED], numbers[low : low + COMPARED], axes.value, k)
                    for seed in opened:
                        bar.meet(*seed)
                    found.append(bar.least)
                    shortest = np.where(bar.least > 0, bar.least / np.maximum(bar.lengths, 1e-300), 0.0)
                    reach = min(reach, float(shortest.min(initial=np.inf)))
                bits = np.concatenate(found).tobytes() if found else b""
                yield pa.RecordBatch.from_pylist([{**row, "bars": bits, "reach": reach / (1 + _SLACK)}], batch_schema)

    batch_schema = pa.schema(
        [("block", pa.int64()), ("longest", pa.float64()), ("width", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]
        + [("numbers", pa.binary()), ("bars", pa.binary()), ("reach", pa.float64())]
    )
    return stage(asked.mapInArrow(bars, f"{_BLOCKS}, bars binary, reach double"), "asked")


def _search(runs: DataFrame, axes: Broadcast, k: int, width: int) -> DataFrame:
    """Best candidates of each (query block, share) run: the query block, then its candidate blocks from the longest on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Best]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bars"] is not None:
                    yield from out(held)
                    ids, numbers, rows = _open(row, width)
                    bars = np.frombuffer(row["bars"])
                    held = []
                    for low in range(0, len(ids), COMPARED):
                        part = slice(low, low + COMPARED)
                        best = Best(rows[part], numbers[part], axes.value, k)
                        best.least = bars[part].copy()
                        held.append((ids[part], best))
                    continue
                block = _open(row, width)
                for _, best in held:
                    best.meet(*block)
        yield from out(held)

    def out(held: list[tuple[np.ndarray, Best]]) -> Iterator[pa.RecordBatch]:
        for ids, best in held:
            q, c, s = best.found
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], best.ids[q], c, s)], ["query_id", "row", "vec_id", "score"])

    return runs.mapInArrow(search, "query_id long, row long, vec_id long, score long")


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    factor: int = 64,
    shares: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    ``is_query`` is a condition on the table's rows. Components become floor(factor * x), x as double. Vectors (or ids)
    that are null, or hold a null or non-finite component, take no part; shorter vectors are filled up with zeros. Every row
    but the query's own is a candidate: rows that repeat an id, a vector or both count each, as candidates and as
    queries. With fewer candidates all are returned. Scores must fit a long. An empty table gives no rows; other columns are not
    looked at.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_column, vector_column, factor, is_query)
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    axes = spark.sparkContext.broadcast(rotation(rows, width))
    candidates = _blocked(rows, width, BLOCK)
    # four blocks, whatever the table
    longest = candidates.orderBy(F.desc("longest"), "block").limit(SEEDS).collect()
    seeds = spark.sparkContext.broadcast([row.asDict() for row in longest])
    together = max(1, QUERY_BLOCK // width)
    asked = _with_bars(_blocked(rows.filter("is_query"), width, together), axes, seeds, k, width)
    # two numbers per block of queries
    reaches = sorted((row.block, row.reach) for row in asked.select("block", "reach").collect())
    if not reaches:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asking = F.array(*(F.struct(F.lit(b).alias("q_block"), F.lit(r).alias("reach")) for b, r in reaches))
    meant = F.explode(F.filter(asking, lambda x: x["reach"] <= F.col("longest"))).alias("x")
    bytes_of = ["width", "ids", "rows", "numbers"]
    share = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share")
    met = candidates.select(share, "longest", *bytes_of, meant).select(
        F.col("x.q_block").alias("q_block"), "share", "longest", *bytes_of, F.lit(None).cast("binary").alias("bars")
    )
    each_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    heads = asked.select(F.col("block").alias("q_block"), each_share, F.lit(None).cast("double").alias("longest"), *bytes_of, "bars")
    runs = heads.unionByName(met).repartition(F.col("q_block"), F.col("share"))
    runs = runs.sortWithinPartitions("q_block", "share", F.desc_nulls_first("longest"))
    found = _search(runs, axes, k, width)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
