"""Nearest neighbours by a hash-prefix forest.

Every tree has its own sequence of hyperplanes and gives each vector a string of 64 bits; a tree
is the sorted array of its strings. A query descends each tree to the longest prefix that it shares
with others; then all trees ascend together, one bit at a time, until they offer `wanted` entries in
all. So every query stops at a depth of its own: deep where vectors crowd, shallow where they are few.
The entries under the prefix of that depth in any tree are its candidates, and their exact
distances decide. An entry that several trees offer is compared once, in the first of them.

How many entries to ask for is measured, not guessed: for a bounded sample of queries the true
neighbours are found by brute force over all rows, together with the number of entries that the
trees hold at each depth, and `wanted` is the number that would have offered the stated share of them
(`recall`). Vectors without structure need many; clustered ones few.

Layout: each sorted array is cut into cells by its leading bits (`routing_bits`, so that a cell has
about a block of rows; 2^16 cells a tree at most), and a cell that is still larger into blocks by
hash. The number of rows of each cell is a table on the driver, which answers for depths up to those
bits. Deeper counts come from the cell that a query falls into. A first pass over strings alone
counts, a second one over strings and vectors compares.

Equal vectors are one entry that names its `k + 1` smallest ids: ties go to smaller ids, so no
further id of the entry can be among k answers.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold a null
or non-finite component take no part, as rows and as queries. Rows with null ids take no part.
Repeated rows (same id and vector) count once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialise, sampled

BITS = 64
#: Cells are told apart by this many leading bits at most, which bounds the table of their sizes.
ROUTED = 16


@dataclass(frozen=True)
class Forest:
    """planes: trees x dimensions x bits; offsets: trees x bits."""

    planes: np.ndarray
    offsets: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.planes)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x rows, the strings as unsigned 64-bit numbers (first bit highest)."""
        out = np.empty((self.trees, len(vectors)), np.uint64)
        for t in range(self.trees):
            out[t] = np.packbits(vectors @ self.planes[t] > self.offsets[t], axis=1).view(">u8").ravel()
        return out


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows (id, v) that take part, and the number of dimensions: the most frequent length."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null and v is not null")
    if rows.schema["v"].dataType.simpleString() != "array<float>":  # floats stay as small as they are
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    common = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 0
    # zeros of either sign are one
    return rows.where(usable(F.col("v"), dims)).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))), dims


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Entries (rep, ids, v): equal vectors once, with their k + 1 smallest ids.

    The ids are ranked with a limit that is applied before and after the shuffle, so a vector that a
    third of the rows share sends k + 1 rows a task.
    """
    ranked = rows.withColumn("at", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "v")


def fit(entries: DataFrame, dims: int, trees: int = 6, sample_rows: int = 2000, seed: int = 3) -> Forest:
    """Hyperplanes halve the way between two vectors of a sample: those of smallest hash, `sample_rows` of them."""
    sample = sampled(entries.select("rep", "v"), sample_rows, "rep").toArrow().sort_by("rep")
    points = _rows(sample["v"].combine_chunks(), dims)
    rng = np.random.default_rng(seed)
    planes, offsets = np.empty((trees, dims, BITS)), np.empty((trees, BITS))
    for t in range(trees):
        a, b = points[rng.integers(0, len(points), BITS)], points[rng.integers(0, len(points), BITS)]
        way = a - b
        way[(way == 0).all(axis=1)] = rng.standard_normal(dims)
        planes[t], offsets[t] = way.T, ((a + b) / 2 * way).sum(axis=1)
    return Forest(planes, offsets)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    differ = a ^ b
    for shift in (1, 2, 4, 8, 16, 32):
        differ = differ | differ >> np.uint64(shift)
    return (BITS - np.bitwise_count(differ)).astype(np.int64)


def _nearest(queries: np.ndarray, vectors: np.ndarray, allowed: np.ndarray | None, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the `keep` rows nearest each query, ties included; distances in double precision.

    Candidates come from a matrix product with a margin for its rounding; the differences decide.
    """
    rough = (queries**2).sum(axis=1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(axis=1)
    if allowed is not None:
        rough[~allowed] = np.inf
    n = rough.shape[1]
    if n > keep:
        bound = np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep]
        near = rough <= bound + 1e-9 * (1 + np.abs(bound))
    else:
        near = np.ones_like(rough, bool)
    q, r = np.nonzero(near & np.isfinite(rough))
    return q, r, np.sqrt(((queries[q] - vectors[r]) ** 2).sum(axis=1))


def exact_levels(own: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """For each query (own: trees x queries) the number of strings, of all trees, at each length of common prefix (0 to 64)."""
    out = np.zeros((own.shape[1], BITS + 1), np.int64)
    for t in range(len(own)):
        for q in range(own.shape[1]):
            out[q] += np.bincount(shared_bits(own[t, q], strings[t]), minlength=BITS + 1)
    return out


def calibrate(entries: DataFrame, forest: Forest, dims: int, k: int, recall: float, queries: int = 64) -> int:
    """Entries that the trees must offer so that they hold `recall` of the true neighbours of a sample of `queries` entries."""
    sample = sampled(entries.select("rep", "v"), queries, "rep").toArrow()
    points, reps = _rows(sample["v"].combine_chunks(), dims), np.asarray(sample["rep"])
    own = forest.strings(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.zeros((len(points), BITS + 1), np.int64)
        for batch in batches:
            vectors, rep = _rows(batch.column("v"), dims), np.asarray(batch.column("rep"))
            if not len(rep):
                continue
            strings = forest.strings(vectors)
            levels += exact_levels(own, strings)
            q, r, d = _nearest(points, vectors, reps[:, None] != rep[None, :], k)
            order = np.lexsort((r, d, q))
            q, r, d = q[order], r[order], d[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, r, d = q[first], r[first], d[first]
            depth = shared_bits(own[:, q], strings[:, r]).max(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rep[r]), pa.array(d), pa.array(depth), pa.array(np.zeros(len(q), np.int64))], ["q", "rep", "d", "depth", "n"])
        q, level = np.nonzero(levels)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.float64()), pa.array(level), pa.array(levels[q, level])], ["q", "rep", "d", "depth", "n"])

    found = materialise(entries.select("rep", "v").mapInArrow(run, "q long, rep long, d double, depth long, n long"), "forest-sample")
    levels = np.zeros((len(points), BITS + 2), np.int64)
    for r in found.where("rep is null").groupBy("q", "depth").agg(F.sum("n").alias("n")).collect():  # 65 rows a query
        levels[r.q, r.depth] = r.n
    deeper = levels[:, ::-1].cumsum(axis=1)[:, ::-1]  # entries at this depth or deeper
    best = found.where("rep is not null").withColumn("at", F.row_number().over(W.partitionBy("q").orderBy("d", "rep"))).where(F.col("at") <= k)
    # a neighbour at depth x is found as soon as more is asked for than lies deeper than x
    needed = np.sort([int(deeper[r.q, r.depth + 1]) + 1 for r in best.select("q", "depth").collect()])
    return int(needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1]) if len(needed) else 1


def routing_bits(rows: int, block_rows: int) -> int:
    return min(ROUTED, max(4, (-(-rows // block_rows)).bit_length() + 1))


LEVELS = pa.schema([("q", pa.int64()), ("level", pa.int32()), ("n", pa.int64())])
VISIT = pa.schema([("q", pa.int64()), ("tree", pa.int32()), ("cell", pa.int64()), ("block", pa.int32()), ("level", pa.int32())])
FOUND = pa.schema([("q", pa.int64()), ("ids", pa.list_(pa.int64())), ("d", pa.float64()), ("seen", pa.int64())])
_ALL = (1 << BITS) - 1


def _prefix_range(strings: np.ndarray, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted strings those lie that share the first `level` bits with each of own."""
    low_bits = np.where(level > 0, np.uint64(_ALL) >> np.minimum(level, 63).astype(np.uint64), np.uint64(_ALL))
    low_bits = np.where(level >= BITS, np.uint64(0), low_bits)
    return np.searchsorted(strings, own & ~low_bits), np.searchsorted(strings, own | low_bits, side="right")


def descend(strings: np.ndarray, q: np.ndarray, own: np.ndarray, routed: int) -> pa.Table:
    """How many strings of a block share exactly so many bits with each query, from its longest prefix up to the cell's."""
    strings = np.sort(strings)
    counts = np.zeros((len(q), BITS + 2), np.int64)
    for level in range(routed, BITS + 1):
        low, high = _prefix_range(strings, own, np.full(len(own), level))
        counts[:, level] = high - low
        if not counts[:, level].any():
            break
    exact = counts[:, :-1] - counts[:, 1:]
    exact[:, :routed] = 0
    at, level = np.nonzero(exact)
    return pa.Table.from_arrays([pa.array(q[at]), pa.array(level.astype(np.int32)), pa.array(exact[at, level])], schema=LEVELS)


def compare(index: pa.Table, visits: pa.Table, dims: int, tree: int, k: int, step: int = 64) -> pa.Table:
    """The k + 1 entries of a block nearest to each query, among those that share its prefix here and in no earlier tree."""
    if not len(index) or not len(visits):
        return FOUND.empty_table()
    each = np.asarray(index["strings"].combine_chunks().flatten()).view(np.uint64).reshape(len(index), -1).T
    order = np.argsort(each[tree], kind="stable")
    each = each[:, order]
    vectors, ids = _rows(index["v"].combine_chunks(), dims)[order], index["ids"].combine_chunks()
    reps = np.asarray(index["rep"])[order]
    q_all, level = np.asarray(visits["q"]), np.asarray(visits["level"])
    own = np.asarray(visits["strings"].combine_chunks().flatten()).view(np.uint64).reshape(len(visits), -1).T
    points = _rows(visits["v"].combine_chunks(), dims)
    low, high = _prefix_range(each[tree], own[tree], level)
    # wide ranges share a matrix product, narrow ones are cut out
    parts = [slice(a, a + step) for a in range(0, len(q_all), step)] if (high - low).mean() > len(index) / 4 else [slice(a, a + 1) for a in range(len(q_all))]
    got: list[list[np.ndarray]] = []
    seen: list[np.ndarray] = []
    for part in parts:
        at, to = low[part].min(), high[part].max()
        place = np.arange(at, to)
        allowed = (place >= low[part, None]) & (place < high[part, None])
        for t in range(tree):  # a level of 0 is looked at in the first tree only
            allowed &= (each[t, at:to] ^ own[t, part, None]) >> (np.uint64(BITS) - level[part, None].astype(np.uint64)) != 0
        seen.append(allowed.sum(axis=1))
        if not allowed.any():
            continue
        q, r, d = _nearest(points[part], vectors[at:to], allowed, k + 1)
        by = np.lexsort((reps[at + r], d, q))
        q, r, d = q[by], r[by], d[by]
        best = np.arange(len(q)) - np.searchsorted(q, q) <= k
        got.append([q_all[part][q[best]], order[at + r[best]], d[best]])
    totals = pa.Table.from_arrays([pa.array(q_all), pa.nulls(len(q_all), FOUND.field("ids").type), pa.nulls(len(q_all), pa.float64()), pa.array(np.concatenate(seen))], schema=FOUND)
    if not got:
        return totals
    q, r, d = (np.concatenate(x) for x in zip(*got))
    return pa.concat_tables([totals, pa.Table.from_arrays([pa.array(q), ids.take(pa.array(r)), pa.array(d), pa.array(np.zeros(len(q), np.int64))], schema=FOUND)])


def search(df: DataFrame, is_query: str, k: int = 10, trees: int = 6, recall: float = 0.96, block_rows: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: the k nearest rows found for each row that is_query holds for (a condition on `id`).

    candidates: entries whose distance from the query was computed.
    """
    spark = df.sparkSession
    rows, dims = clean_vectors(df, id_col, vector_col)
    entries = materialise(distinct_vectors(rows, k), "forest-entries")
    members = materialise(rows.where(is_query).distinct(), "forest-queries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, candidates long")
    forest = fit(entries, dims, trees, seed=seed)
    wanted = calibrate(entries, forest, dims, k, recall) + trees  # each tree also offers the query's own entry
    routed = routing_bits(total, block_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                strings = forest.strings(_rows(batch.column("v"), dims)).T.ravel().view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees), pa.array(strings))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "strings"])

    def with_strings(frame: DataFrame) -> DataFrame:
        return frame.mapInArrow(hashed, T.StructType([*frame.schema, T.StructField("strings", T.ArrayType(T.LongType()))]))

    cell = F.shiftrightunsigned("string", BITS - routed)
    entries = materialise(with_strings(entries), "forest-strings")
    asked = materialise(with_strings(members.groupBy("v").agg(F.min("id").alias("q"))), "forest-asked")
    placed = entries.select("rep", F.posexplode("strings").alias("tree", "string")).withColumn("cell", cell)
    # one row a cell: trees x 2^routed rows at most
    sizes = np.zeros((trees, 1 << routed), np.int64)
    counted = placed.groupBy("tree", "cell").count().toArrow()
    sizes[np.asarray(counted["tree"]), np.asarray(counted["cell"])] = np.asarray(counted["count"])
    before = np.concatenate([np.zeros((trees, 1), np.int64), sizes.cumsum(axis=1)], axis=1)
    blocks = -(-sizes // block_rows)
    keys = spark.createDataFrame(pa.table({"tree": pa.array(np.nonzero(sizes)[0].astype(np.int32)), "cell": pa.array(np.nonzero(sizes)[1]), "blocks": pa.array(blocks[np.nonzero(sizes)])}))
    block = F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")

    def under(own: int, level: int) -> tuple[int, int]:
        """First and last + 1 of the cells under the first `level` bits of a string."""
        up = max(routed - level, 0)
        first = (own & _ALL) >> (BITS - routed) >> up << up
        return first, first + (1 << up)

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries at each depth short of the cells', from the cells' sizes."""
        for batch in batches:
            out = []
            for q, strings in zip(batch.column("q").to_pylist(), batch.column("strings").to_pylist()):
                n = [sum(int(before[t, b] - before[t, a]) for t, (a, b) in enumerate(under(x, level) for x in strings)) for level in range(routed + 1)]
                out += [(q, level, n[level] - n[level + 1]) for level in range(routed) if n[level] > n[level + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), LEVELS.types)], schema=LEVELS) if out else pa.RecordBatch.from_pylist([], schema=LEVELS)

    # a block's visitors are dealt into parts, each with a copy of the block, so none is unbounded
    parts = max(1, -(-members.count() // block_rows))
    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    group = ["tree", "cell", "block", "part"]
    # descent: the longest prefixes, counted from the strings alone
    falls = asked.select("q", F.posexplode("strings").alias("tree", "string")).withColumn("cell", cell).join(F.broadcast(keys), ["tree", "cell"])
    falls = falls.select("tree", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), part, "q", "string")
    strings = placed.join(F.broadcast(keys), ["tree", "cell"]).select("tree", "cell", block, copies, "string")

    def counts(index: pa.Table, visits: pa.Table) -> pa.Table:
        if not len(index) or not len(visits):
            return LEVELS.empty_table()
        return descend(np.asarray(index["string"]).view(np.uint64), np.asarray(visits["q"]), np.asarray(visits["string"]).view(np.uint64), routed)

    levels = strings.groupBy(*group).cogroup(falls.groupBy(*group)).applyInArrow(counts, "q long, level int, n long")
    levels = levels.unionByName(asked.select("q", "strings").mapInArrow(shallow, "q long, level int, n long"))
    # synchronous ascent: the deepest level at which all trees together offer what is wanted, else the root
    levels = levels.groupBy("q", "level").agg(F.sum("n").alias("n"))
    offered = levels.withColumn("offered", F.sum("n").over(W.partitionBy("q").orderBy(F.desc("level"))))
    stops = offered.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("offered") >= wanted, F.col("level"))), F.lit(0)).alias("level"))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each query looks into: those under its prefixes; at the root one tree holds all."""
        for batch in batches:
            out = []
            for q, level, strings in zip(*(batch.column(c).to_pylist() for c in ("q", "level", "strings"))):
                for t in range(trees if level else 1):
                    out += [(q, t, c, b, level) for c in range(*under(strings[t], level)) for b in range(blocks[t, c])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VISIT.types)], schema=VISIT) if out else pa.RecordBatch.from_pylist([], schema=VISIT)

    where = asked.join(stops, "q").select("q", "level", "strings").mapInArrow(visited, "q long, tree int, cell long, block int, level int")
    visiting = where.join(asked, "q").select("tree", "cell", "block", part, "q", "level", "strings", "v")
    indexed = entries.select("rep", "ids", "v", "strings", F.posexplode("strings").alias("tree", "string")).withColumn("cell", cell)
    indexed = indexed.join(F.broadcast(keys), ["tree", "cell"]).select("tree", "cell", block, copies, "rep", "ids", "v", "strings")

    def nearest(key: tuple, index: pa.Table, visits: pa.Table) -> pa.Table:
        return compare(index, visits, dims, key[0].as_py(), k)

    found = indexed.groupBy(*group).cogroup(visiting.groupBy(*group)).applyInArrow(nearest, "q long, ids array<long>, d double, seen long")
    # the row without an id, which comes first, holds a query's number of candidates
    near = found.select("q", "d", "seen", F.explode_outer("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.min("d").alias("d"), F.sum("seen").alias("seen"))
    near = near.withColumn("at", F.row_number().over(W.partitionBy("q").orderBy(F.col("vec_id").isNotNull(), "d", "vec_id"))).where(F.col("at") <= k + 2)
    own = members.join(asked.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q")
    each = own.join(near.select("q", "d", "vec_id", "seen"), "q").withColumn("candidates", F.max("seen").over(W.partitionBy("query_id")))
    each = each.where("vec_id <> query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id")))
    return each.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"), "candidates")
