"""SimHash near-duplicates: 64-bit fingerprints, BK-trees, connected components.

Fingerprint: a bit is set where more than half of the shingle hashes (XXH64, seed 42, repeats
included) have it set. Two fingerprints link at `radius` or fewer differing bits.

Search: the 64 bits are cut into blocks; fingerprints that differ in at most `radius` bits
agree in at least blocks - radius of them, so each fingerprint goes to one shard for every
choice of that many blocks, and every link lies within a shard. In each shard a BK-tree is
built (children keyed by their Hamming distance to the parent) and every member is looked up
following only edges within the radius. A shard gives a spanning forest of its links, never
all pairs; components follow by alternating large-star and small-star steps.

The trees are not broadcast: the set of fingerprints grows with the corpus and has no bound.
Each tree is built where its shard was shuffled to.

Defined cases: a null or empty text (or one of white space) has fingerprint zero, linked like
any other; exact copies share a fingerprint and cost one entry in the trees. Null ids take part
but never name a component unless all ids of a component are null. Repeated rows give repeated
results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, materialise, spread_join, whole_groups
from .components import connected_components

SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (of the whole sequence if shorter), A-Z lowered, split at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], np.uint64, n)


def majority(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The 64 majority bits; a tie is 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_text(text: str, words: int = 4) -> int:
    return majority(shingle_hashes(text, words))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            fps = [_signed(fingerprint_text(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many shards, built and searched together, level by level.

    keys: shard of each item; items of a shard form a tree whose root is its first item.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        n = len(keys)
        self.prints = prints
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.ones(n, bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        root = np.empty(n, np.int64)
        root[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        root = order[root]
        item = np.flatnonzero(root != np.arange(n))
        at = root[item]
        self.levels = 0
        while len(item):
            self.levels += 1
            d = np.bitwise_count(prints[item] ^ prints[at]).astype(np.int64)
            slot = at * 65 + d  # a node has one child for each distance
            _, lead = np.unique(slot, return_index=True)
            heads = item[lead]
            parent[heads], edge[heads] = at[lead], d[lead]
            child = np.empty(len(item), np.int64)
            by = np.argsort(slot, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = slot[by][1:] != slot[by][:-1]
            child[by] = item[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            rest = child != item
            item, at = item[rest], child[rest]
        self.root = root
        kids = np.flatnonzero(parent >= 0)
        code = parent[kids] * 65 + edge[kids]
        by = np.argsort(code)
        self.kids, self.code = kids[by], code[by]

    def links(self, radius: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (query item, found item), each link once, found by following edges within the radius."""
        n = len(self.prints)
        for a in range(0, n, chunk):
            stack = [(np.arange(a, min(a + chunk, n)), self.root[a : a + chunk])]
            while stack:
                query, node = stack.pop()
                if len(query) > 4 * chunk:  # bounds memory; the rest waits
                    stack.append((query[4 * chunk :], node[4 * chunk :]))
                    query, node = query[: 4 * chunk], node[: 4 * chunk]
                d = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.code, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.code, node * 65 + np.minimum(d + radius, 64), side="right")
                many = high - low
                keep = many > 0
                if keep.any():
                    low, many = low[keep], many[keep]
                    upto = np.cumsum(many)
                    at = np.arange(upto[-1]) - np.repeat(upto - many, many) + np.repeat(low, many)
                    stack.append((np.repeat(query[keep], many), self.kids[at]))


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each item the smallest item that the links reach from it (minima are hooked and halved until none changes)."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _block_masks(blocks: int, agree: int) -> list[int]:
    """One mask of agreeing bits for each choice of `agree` of the blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, agree)]


def links(prints: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Spanning links (src, dst) among distinct fingerprints; prints: fp, node (a name for it). src is the larger name."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed radius")
    masks = _block_masks(blocks, blocks - radius)
    shards = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    placed = prints.select("fp", "node", F.explode(shards).alias("s")).select(F.xxhash64("s.choice", "s.bits").alias("shard"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shard, fp, node = (np.asarray(table[c]) for c in ("shard", "fp", "node"))
            fp = fp.view(np.uint64)
            same = np.zeros(len(shard), bool)
            same[1:] = shard[1:] == shard[:-1]
            same[:-1] |= same[1:]
            shard, fp, node = shard[same], fp[same], node[same]
            label = spanning(len(shard), BKForest(shard, fp).links(radius))
            joined = np.flatnonzero(label != np.arange(len(label)))
            src, dst = node[joined], node[label[joined]]  # items of a shard are in the order of their names
            pairs = np.unique(np.stack([src, dst], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    return placed.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "src long, dst long")


def near_duplicates(df: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links reach, its own included."""
    docs = materialise(fingerprints(df, words, id_col, text_col), "simhash")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    named = materialise(distinct, "simhash-distinct")
    found = links(named.where("node is not null"), radius, blocks)
    return join_components(docs, named, connected_components(found))


def join_components(docs: DataFrame, named: DataFrame, components: DataFrame) -> DataFrame:
    """Fingerprints get the component of their name, rows that of their fingerprint; one that many rows share comes to them."""
    classes = named.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n")
    return spread_join(docs, classes, "fp", "n").select("doc_id", "fp", "component_id")


def spelled(fp) -> F.Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
