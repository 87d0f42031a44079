"""Near copies at a stated similarity of shingle sets, found by SimHash fingerprints in BK-trees.

Copies that share four fifths of their five-word shingles may differ in more than a quarter of a
64-bit fingerprint, which is too far for shards cut from fingerprint bits. Here shards are named
by content: every document goes to a few shards, each named by a pair of minimum shingle hashes,
so a shard holds documents that share passages, and documents of similarity s meet in at least one
of n shards with probability 1 - (1 - s^2)^n (0.99996 at 0.8 and n = 10). In a shard a BK-tree of
the fingerprints gives the pairs within the radius, a sketch of the shingle sets (least hash of each
of 256 bins) settles what is clear, and the sets themselves decide the rest. Fingerprints are of the
sets too (repeats don't count), and the radius follows from the similarity: a pair that similar is
beyond it once in a million. A shard gives a spanning forest of its links, never all pairs.

No shard is taken whole by a task if it has more than `most` members. The members of a larger one,
mostly a group of copies, are dealt into blocks, to each of which the member of smallest hash is added as
well, so a group costs about its size. Members of large shards that are not in one group with all others
then meet by an exact rule: sets of this similarity share one of the rarest fifth of their own hashes (a
prefix in the order of the frequency of bins of hashes), so members with such a hash in common are compared, and where more than
`most` have it, blocks of members that are not yet in the same group are. No pair of a large shard is left out.

Defined cases: texts are compared in lower-cased words, so a null, empty or white text equals
another; a text of fewer words than a shingle has its whole sequence as one. Equal contents are
one entry, whatever their ids. Of each group one row stays: the smallest id and, among texts of that
id in the group, the one of smallest digest. Rows of one id whose texts belong to different groups
are judged each for itself. Rows with null ids stay and answer for no other. An empty table gives an
empty result; other columns pass as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import MOST_HOT, id_and_text, in_slices, materialise, remove, spread_join, stored, whole_groups
from .components import connected_components
from .simhash import BKForest, _signed, majority, shingle_hashes

BINS = 256
#: Sketches this far from the bound are clear: six standard errors at 0.8.
CLEAR = 0.15
#: Members of a shard that a task takes.
MOST = 2048
#: Bins of shingle hashes whose frequency is counted for prefixes.
KINDS = 1 << 18
_MULTIPLIERS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> bytes:
    """For each bin of shingle hashes, 1 to 255 from its least hash, 0 if it has none."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        h = np.sort(hashes)  # bins are runs of the sorted hashes
        bin_of = (h >> np.uint64(56)).astype(np.int64)
        first = np.ones(len(h), bool)
        first[1:] = bin_of[1:] != bin_of[:-1]
        out[bin_of[first]] = (h[first] % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out.tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of rows of sketches; two empty ones are alike."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    both = ((a == b) & (a > 0)).sum(axis=1)
    # a pair of unlike least hashes agrees by chance once in 255
    chance = np.maximum(both - np.maximum(either - both, 0) / 255, 0)
    return np.where(either == 0, 1.0, chance / np.maximum(either, 1))


def _bit_differs(both: int, left: int, right: int) -> float:
    """Chance that a majority bit differs between sets with `both` common shingles and so many of their own."""

    def set_by(k: int, own: int) -> float:
        return sum(math.comb(own, x) for x in range(own + 1) if 2 * (k + x) > both + own) / 2**own

    chance = 0.0
    for k in range(both + 1):
        a, b = set_by(k, left), set_by(k, right)
        chance += math.comb(both, k) / 2**both * (a * (1 - b) + b * (1 - a))
    return chance


@lru_cache
def radius_of(similarity: float, miss: float = 1e-6) -> int:
    """Least radius that a pair of sets of this similarity, or a higher one, exceeds with a chance of at most `miss`.

    Sets of equal sizes have the lowest correlation, 2s / (1 + s); a bit of large sets differs with
    arccos of that over pi. Small sets, where ties are frequent, are counted out.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(1, 17):
        for both in range(math.ceil(similarity * n - 1e-9), n + 1):
            p = max([p, *(_bit_differs(both, left, n - both - left) for left in range(n - both + 1))])
    tail, radius = 1.0, -1
    while tail > miss and radius < 64:
        radius += 1
        tail = math.fsum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(radius + 1, 65))
    return radius


def shard_names(hashes: np.ndarray, shards: int) -> list[int]:
    """A name for each of `shards` pairs of minimum hashes."""
    if not len(hashes):
        return []
    with np.errstate(over="ignore"):
        least = [int((hashes * m >> np.uint64(8)).min()) for m in _MULTIPLIERS[: 2 * shards]]
    return [_signed(xxhash.xxh3_64_intdigest(f"{i}:{least[2 * i]}:{least[2 * i + 1]}")) for i in range(shards)]


def content_of(text: str) -> bytes:
    """Digest of the words."""
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()))


def described(df: DataFrame, words: int = 5, shards: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, fp, sketch, shards, hashes (the set, sorted, 32 bits each) of every whole text. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            content, prints, sketches, names, sets = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                content.append(content_of(text))
                hashes = np.unique(shingle_hashes(text, words))
                prints.append(_signed(majority(hashes)))
                sketches.append(sketch(hashes))
                names.append(shard_names(hashes, shards))
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), pa.array(names, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "content", "fp", "sketch", "shards", "hashes"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, content binary, fp long, sketch binary, shards array<long>, hashes binary")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this share of their union in common."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _joined(n: int, forest: BKForest, sketches: np.ndarray, sets: list[bytes], radius: int, similarity: float, step: int = 1 << 16) -> np.ndarray:
    """Smallest item that links reach; pairs already joined are not looked at again."""
    label = np.arange(n)
    for a, b in forest.links(radius, 1 << 14):
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            alike = likeness(sketches[x], sketches[y])
            clear, open_ = alike >= similarity + CLEAR, np.abs(alike - similarity) < CLEAR
            u, v = x[clear], y[clear]
            while len(u):
                lu, lv = label[u], label[v]
                differ = lu != lv
                u, v, lu, lv = u[differ], v[differ], lu[differ], lv[differ]
                np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
                while (label[label] != label).any():
                    label = label[label]
            # the likeliest first: what they join needs no look at the others
            order = np.argsort(-alike[open_], kind="stable")
            for p, q in zip(x[open_][order].tolist(), y[open_][order].tolist()):
                p_label, q_label = label[p], label[q]
                if p_label != q_label and similar(np.frombuffer(sets[p], "<u4"), np.frombuffer(sets[q], "<u4"), similarity):
                    label[label == max(p_label, q_label)] = min(p_label, q_label)
    return label


def _compared(placed: DataFrame, heads: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Spanning links (src, dst) of the items (shard, node) that share a shard; no shard may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard", 10_000):
            node = np.asarray(table["node"])
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
            forest = BKForest(np.asarray(table["shard"]), np.asarray(table["fp"]).view(np.uint64))
            label = _joined(len(node), forest, sketches, table["hashes"].to_pylist(), radius, similarity)
            moved = np.flatnonzero(label != np.arange(len(label)))
            pairs = np.unique(np.stack([node[moved], node[label[moved]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    sets = heads.select("node", "fp", "sketch", "hashes")
    nodes = materialise(placed.select("node").distinct(), "copies-nodes")
    if nodes.count() <= MOST_HOT:  # keeps the sets of all others from being shuffled
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    full = placed.hint("merge").join(sets, "node").select("shard", "node", "fp", "sketch", "hashes")
    return full.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "src long, dst long").where("src <> dst")


def _sized(placed: DataFrame, name: str) -> DataFrame:
    """(shard, node, size) of the items whose shard has others too; a shard of many rows is not gathered.

    Of shards with the same members (told by their number, least, largest and a checksum) one is kept:
    copies mostly share all of their shards, and whoever meets in one of them meets in the one that is kept.
    """
    mark = F.bit_xor(F.xxhash64("node"))
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last"), mark.alias("mark")).where("size > 1")
    sizes = sizes.groupBy("size", "first", "last", "mark").agg(F.min("shard").alias("shard")).select("shard", "size", F.col("size").alias("n"))
    return materialise(spread_join(placed, materialise(sizes, f"{name}-sizes"), "shard", "n", merge=True), name)


def _dense_blocks(dense: DataFrame, most: int) -> DataFrame:
    """(shard, node): members of large shards in blocks, and with each block the shard's member of smallest hash."""
    blocks = F.ceil(2 * F.col("size") / F.lit(most))
    key = lambda b: F.xxhash64("shard", b.cast("long"))
    dealt = dense.select(key(F.pmod(F.xxhash64("node"), blocks)).alias("shard"), "node")
    heads = dense.groupBy("shard", "size").agg(F.min_by("node", F.xxhash64("node")).alias("node"))
    heads = heads.select("shard", "node", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"))
    return dealt.unionByName(heads.select(key(F.col("block")).alias("shard"), "node")).distinct()


def _prefixes(open_: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(shard, node, component): the hashes, rarest among these items first, of which two sets of this similarity share one at least.

    Such sets of n hashes share ceil(similarity * n) of them, so one is among the first n + 1 less as many of both.
    That holds for any order that is the same for all. This one goes by how many hashes the sets have in the hash's
    bin, then by the hash; what reaches the driver, and the tasks, is a count for each of KINDS bins.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(KINDS, np.int64)
        for batch in in_slices(batches, "hashes"):
            counts += np.bincount(_kind(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u4")), minlength=KINDS)
        kind = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(counts[kind])], ["kind", "n"])

    if open_.count() <= MOST_HOT:  # keeps the sets of all others from being shuffled
        open_ = F.broadcast(open_)
    sets = materialise(heads.select("node", "hashes").join(open_, "node").select("node", "component", "hashes"), "copies-open-sets")
    found = sets.select("hashes").mapInArrow(count, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(KINDS, np.int64)
    counts[np.asarray(found["kind"], np.int64)] = np.asarray(found["n"], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "hashes"):
            node, component = np.asarray(batch.column("node")), np.asarray(batch.column("component"))
            sets = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("hashes").to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            first = size + 1 - np.ceil(similarity * size - 1e-9).astype(np.int64)
            owner, hashes = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
            order = np.lexsort((hashes, counts[_kind(hashes)], owner))
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
            taken = order[place < first[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes[taken], node[owner[taken]], component[owner[taken]])], ["shard", "node", "component"])

    return sets.mapInArrow(run, "shard long, node long, component long")


def _kind(hashes: np.ndarray) -> np.ndarray:
    """The bin of each 32-bit hash."""
    return (hashes >> 14).astype(np.int64)


def _parted(placed: DataFrame, name: str) -> DataFrame:
    """The (shard, node, component) of shards whose items are in several components, with the shard's size."""
    several = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shard", "size", F.col("size").alias("n"))
    return spread_join(placed, materialise(several, f"{name}-several"), "shard", "n")


def _open_blocks(dense: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """(shard, node): pairs of blocks of a large shard whose members are not all in one group yet.

    Large groups have blocks of their own, small ones share some; two blocks of one group don't meet again.
    """
    half = most // 2
    known = dense.join(components, "node", "left").select("shard", "node", F.coalesce("component", "node").alias("component"))
    known = known.withColumn("part", F.xxhash64("shard", "component"))
    parts = materialise(known.groupBy("part").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n")), "copies-parts")
    several = parts.groupBy("shard").agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(F.when(F.col("n") < half, F.col("n"))), F.lit(0)).alias("pooled")).where("parts > 1").select("shard", "pooled")
    parts = parts.join(several, "shard").withColumn("own", F.col("n") >= half)
    parts = parts.withColumn("of", F.when(F.col("own"), F.ceil(F.col("n") / half)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("pooled") / half)))).select("part", "own", "of", "n")
    parts = materialise(parts, "copies-open")
    if parts.isEmpty():
        return dense.select("shard", "node").where("false")
    # an own block: (part, number by node); a shared one: (null, number by part)
    member = spread_join(known.select("shard", "node", "part"), parts, "part", "n")
    number = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("part")), F.col("of"))
    member = materialise(member.select("shard", "node", F.xxhash64("shard", F.when(F.col("own"), F.col("part")), number).alias("block"), F.when(F.col("own"), F.col("part")).alias("whole")), "copies-members")
    blocks = member.select("shard", "block", "whole").distinct()
    a, b = blocks.select("shard", F.col("block").alias("a"), F.col("whole").alias("wa")), blocks.select("shard", F.col("block").alias("b"), F.col("whole").alias("wb"))
    pairs = a.join(b, "shard").where("a < b and not coalesce(wa = wb, false) or a = b and wa is null")
    pairs = pairs.select(F.xxhash64("shard", "a", "b").alias("meet"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return member.join(pairs, "block").select(F.col("meet").alias("shard"), "node")


def links(names: DataFrame, heads: DataFrame, similarity: float = 0.8, radius: int | None = None, most: int = MOST) -> DataFrame:
    """Spanning links (src, dst) among the items of names (node, shards), whose (node, fp, sketch, hashes) heads holds; the radius follows from the similarity."""
    radius = radius_of(similarity) if radius is None else radius
    placed = _sized(names.select(F.explode(F.array_distinct("shards")).alias("shard"), "node"), "copies-shards")
    small = placed.where(F.col("size") <= most).select("shard", "node")
    if placed.where(F.col("size") > most).isEmpty():
        return _compared(small, heads, similarity, radius)
    dense = placed.where(F.col("size") > most)
    placed = materialise(small.unionByName(_dense_blocks(dense, most)), "copies-placed")
    components = connected_components(_compared(placed, heads, similarity, radius))
    found = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    known = dense.select("shard", "node").join(components, "node", "left").select("shard", "node", F.coalesce("component", "node").alias("component"))
    open_ = materialise(_parted(known, "copies-dense").select("node", "component").distinct(), "copies-apart")
    if open_.isEmpty():
        return found
    meeting = _sized(materialise(_parted(materialise(_prefixes(open_, heads, similarity), "copies-prefixes"), "copies-prefix").select("shard", "node"), "copies-met"), "copies-meeting")
    pairs = meeting.where(F.col("size") <= most).select("shard", "node")
    dense = meeting.where(F.col("size") > most)
    if not dense.isEmpty():
        pairs = materialise(pairs.unionByName(_open_blocks(dense, components, most)), "copies-pairs")
    return found.unionByName(_compared(pairs, heads, similarity, radius))


def duplicates(df: DataFrame, similarity: float = 0.8, words: int = 5, shards: int = 10, radius: int | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, component_id, stays of every row with an id: the smallest id of its group of copies, and whether the row may answer for it."""
    rows = described(df, words, shards, id_col, text_col).where("doc_id is not null")
    rows, path = stored(rows.withColumn("row", F.monotonically_increasing_id()), "copies")  # stored, so the numbers are settled
    contents = materialise(rows.groupBy("content").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "copies-contents")
    heads = rows.withColumnRenamed("row", "node")
    names = materialise(heads.select("node", "shards").join(contents.select("node").hint("merge"), "node", "left_semi"), "copies-names")
    components = connected_components(links(names, heads, similarity, radius, most))
    named = contents.join(components, "node", "left").withColumn("group", F.coalesce("component", "node")).select("content", "least", "n", "group")
    named = materialise(named, "copies-groups")
    first = materialise(named.groupBy("group").agg(F.min(F.struct("least", "content")).alias("first"), F.count(F.lit(1)).alias("contents")), "copies-first")
    judged = spread_join(named, first, "group", "contents").select("content", F.col("first.least").alias("component_id"), (F.col("content") == F.col("first.content")).alias("here"), "n")
    found = spread_join(rows.select("doc_id", "content"), materialise(judged, "copies-judged"), "content", "n")
    found = materialise(found.select("doc_id", "content", "component_id", (F.col("here") & (F.col("doc_id") == F.col("component_id"))).alias("stays")), "copies-found")
    remove(df.sparkSession, path)  # the sets are large
    return found


def drop_copies(df: DataFrame, similarity: float = 0.8, words: int = 5, most: int = MOST) -> DataFrame:
    """The rows of df without copies: of each group one row, as it is, and all rows without an id."""
    found = duplicates(df, similarity, words, most=most)
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("stays").alias("staying"))
    # an id that occurs once is told by itself; of the others the content decides
    marks = materialise(ids.select("doc_id", "n", F.when(F.col("staying") == 0, "goes").when(F.col("n") == 1, "stays").otherwise("open").alias("_copy_mark")), "copies-marks")
    known = df.where("doc_id is not null").withColumn("_copy_id", F.col("doc_id").cast("long"))
    marked = spread_join(known, marks.where("_copy_mark <> 'stays'").select(F.col("doc_id").alias("_copy_id"), "n", "_copy_mark"), "_copy_id", "n", how="left", merge=True)
    kept = df.where("doc_id is null").unionByName(marked.where("_copy_mark is null").select(*df.columns))
    if marks.where("_copy_mark = 'open'").isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_copy_content", pa.array([content_of(t or "") for t in batch.column("text").to_pylist()], pa.binary()))

    doubted = marked.where("_copy_mark = 'open'").drop("_copy_mark")
    doubted = doubted.mapInArrow(run, StructType([*doubted.schema, StructField("_copy_content", BinaryType())])).dropDuplicates(["_copy_id", "_copy_content"])
    staying = found.where("stays").select(F.col("doc_id").alias("_copy_id"), F.col("content").alias("_copy_content")).distinct()
    return kept.unionByName(doubted.join(staying, ["_copy_id", "_copy_content"], "left_semi").select(*df.columns))
