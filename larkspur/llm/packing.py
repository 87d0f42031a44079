"""Lexical retrieval packing: related documents share a training window.

Documents become token ids once (in the shared folder), document frequencies of all ids are
counted over the whole corpus, and documents are dealt by content into shards of about
`shard_tokens` tokens. In each shard an inverted index with BM25 impacts (corpus-wide frequencies)
is built; the document that opens a window is its seed, and its nearest unused neighbours fill the
window in order of score. All terms of a seed are asked for. A document that meets the end of the
window is cut there and opens the next one, so only the last window of a shard is padded.

Dealing: each document draws a term with a chance in proportion to its BM25 impact, by the same
fixed numbers everywhere (a weighted minimum hash), so two documents draw the same term with a
probability of the share of impact that they have in common, however many shards there are.
Documents of one term share a shard; if a term has too many for one, they are dealt by a second
drawn term, and copies that agree in both by a hash: those are related however they are dealt.
Terms that only one document has are not drawn.

Defined cases: a null or empty text is the end id alone. Each row is a document of its own, also
where ids or texts repeat. Without a neighbour left, the next unused document (by id, null first, then
tokens) fills. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, materialise, remove, stored

WINDOW = 2048
END_ID = 1
_CUT = re.compile(r"(?<=\S)(?= \S)")


@dataclass
class Tokens:
    """Byte-level BPE whose vocabulary fits 16 bits.

    A space between two non-white characters always starts a token of its own pattern, so text
    may be cut there and each word encoded once. opens: whether an id begins with a space.
    """

    encoding: object
    opens: np.ndarray

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 16-bit ids of each text (no nulls). Each word that the texts have is encoded once, all in one call."""
        split = pa.compute.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        bound = np.concatenate(([0], np.cumsum(np.asarray(split.value_lengths(), np.int64))))
        word = np.asarray(words.indices, np.int64)
        known = words.dictionary.to_pylist()
        safe = np.array([bool(p) and not p[0].isspace() and not p[-1].isspace() for p in known], bool)
        ids = self.ids("".join([" " + p for p, s in zip(known, safe.tolist()) if s]))
        at = np.flatnonzero(self.opens[ids])
        start, length = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        start[safe], length[safe] = at, np.diff(np.append(at, len(ids)))
        # behind the first word of a text, which no space precedes
        first = bound[:-1]
        many, unsafe = length[word], ~safe[word]
        many[first], unsafe[first] = 0, False
        plain = ~np.logical_or.reduceat(unsafe, first) if len(first) else first
        upto = np.cumsum(many)
        data = ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start[word] - upto + many, many)].tobytes()
        ends = np.append(0, upto)[bound] * 2
        out = []
        for i, (head, n, a, b) in enumerate(zip(word[first].tolist(), np.diff(bound).tolist(), ends.tolist(), ends[1:].tolist())):
            head = known[head]
            if n > 1 and not (plain[i] and head and not head[-1].isspace()):
                out.append(b"".join(self.ids(part).tobytes() for part in _CUT.split(texts[i].as_py())))
            else:
                out.append(self.ids(head).tobytes() + data[a:b])
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Tokens:
    """path: a byte-level BPE in the tokenizers library's format.

    Its merges, in order, are ranks as tiktoken takes them, which gives the same ids in half the time (a
    test holds both against each other).
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    if max(vocabulary.values()) >= 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    ranks = {bytes(map(_BYTE_OF.__getitem__, piece)): rank for piece, rank in vocabulary.items() if all(c in _BYTE_OF for c in piece)}
    special = [piece for piece in vocabulary if piece.startswith("<|") and piece.endswith("|>")]
    for piece in special:  # their spellings in a text are ordinary text
        ranks.pop(piece.encode(), None)
    opens = np.zeros(1 << 16, bool)
    opens[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True
    return Tokens(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), opens)


def _byte_letters() -> dict[str, int]:
    """How such files spell bytes: printable ones as themselves, the others as the letters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_letters()


def tokenise(df: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 16-bit, the end id last) and their number. A narrow pass."""
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(tokenizer)
        for batch in in_slices(batches, "text"):
            ids = [x + end for x in tokens.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, n long")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a document, each once, and how often it has them (a radix sort; documents are never empty)."""
    ordered = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(ordered)))


@dataclass(frozen=True)
class Statistics:
    """Of all documents: their number, their mean length, and for each id the documents that hold it."""

    documents: int
    mean_length: float
    frequency: np.ndarray


def statistics(tokenised: DataFrame) -> Statistics:
    """Counted per task, summed by id; what reaches the driver is bounded by the vocabulary (65,536 ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                counts[distinct(np.frombuffer(ids, "<u2"))[0]] += 1
                documents += 1
                total += len(ids) // 2
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(counts[at], [documents, total]))], ["id", "n"])

    rows = tokenised.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["id"].to_pylist(), rows["n"].to_pylist()))
    documents, total = found.pop(-1, 0), found.pop(-2, 0)
    frequency = np.zeros(1 << 16, np.int64)
    frequency[list(found)] = list(found.values())
    return Statistics(documents, total / max(documents, 1), frequency)


def idf_of(stats: Statistics) -> np.ndarray:
    return np.log(1 + (stats.documents - stats.frequency + 0.5) / (stats.frequency + 0.5))


def impacts(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """BM25 weight of terms in documents."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


class Index:
    """Inverted index of a shard: for each id its documents and BM25 impacts."""

    def __init__(self, documents: list[np.ndarray], stats: Statistics):
        found = [distinct(d) for d in documents]
        self.query = [t.astype(np.int64) for t, _ in found]
        term = np.concatenate(self.query)
        doc = np.repeat(np.arange(len(documents)), [len(t) for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float64)
        length = np.array([len(d) for d in documents], np.float64)[doc]
        impact = impacts(tf, idf_of(stats)[term], length, stats.mean_length)
        self.n = len(documents)
        # terms that many documents have are rows of a table, the others lists of documents
        holders = np.bincount(term, minlength=1 << 16)
        frequent = np.flatnonzero(holders > max(64, self.n // 8))
        self.row = np.full(1 << 16, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.table = np.zeros((len(frequent), self.n))
        dense = self.row[term] >= 0
        self.table[self.row[term[dense]], doc[dense]] = impact[dense]
        term, doc, impact = term[~dense], doc[~dense], impact[~dense]
        by = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[by], impact[by]
        self.at = np.searchsorted(term[by], np.arange((1 << 16) + 1))

    def neighbours(self, seed: int, used: np.ndarray, most: int = 0) -> np.ndarray:
        """The `most` (0: all) unused documents that share a term with the seed, best first, ties in document order."""
        terms = self.query[seed]
        if not len(terms):
            return terms
        rows = self.row[terms]
        rare = terms[rows < 0]
        scores = self.table[rows[rows >= 0]].sum(axis=0)
        low, many = self.at[rare], self.at[rare + 1] - self.at[rare]
        upto = np.cumsum(many)
        if len(rare) and upto[-1]:
            at = np.arange(upto[-1]) + np.repeat(low - upto + many, many)
            scores += np.bincount(self.doc[at], self.impact[at], self.n)
        scores[used] = 0
        hit = np.flatnonzero(scores)
        if most and len(hit) > most:  # a window takes a few; ties at the edge stay
            hit = hit[scores[hit] >= np.partition(scores[hit], len(hit) - most)[len(hit) - most]]
        return hit[np.argsort(-scores[hit], kind="stable")]


def pack_shard(documents: list[np.ndarray], stats: Statistics, window: int = WINDOW, few: int = 32) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset)."""
    index = Index(documents, stats)
    used = np.zeros(len(documents), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = first = 0
    waiting: list[int] = []
    opened = seed = -1  # the sequence whose neighbours are waiting, and its first document
    more = False  # whether the seed has neighbours beyond those
    while True:
        doc = -1
        while waiting:
            doc = waiting.pop()
            if not used[doc]:
                break
            doc = -1
        if doc < 0 and more and offset and opened == sequence:  # the few are used up, the window isn't full
            more, waiting = False, index.neighbours(seed, used)[: window - offset][::-1].tolist()
            continue
        if doc < 0:
            while first < len(documents) and used[first]:
                first += 1
            if first == len(documents):
                return pieces
            doc = first
        used[doc] = True
        start, n = 0, len(documents[doc])
        while start < n:
            length = min(window - offset, n - start)
            pieces.append((doc, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == window:
                sequence, offset = sequence + 1, 0
        if offset and opened != sequence:
            # this document is the first of its window, or was cut into it: it is the seed
            opened, seed, more = sequence, doc, True
            waiting = index.neighbours(doc, used, few)[: window - offset][::-1].tolist()


def drawn(tokenised: DataFrame, stats: Statistics, terms: int = 2, seed: int = 13) -> DataFrame:
    """tokenised with the terms k0, k1 that each document draws in proportion to their impact (-1 where it shares none)."""
    races = np.random.default_rng(seed).exponential(size=(terms, 1 << 16))
    idf = np.where(stats.frequency > 1, idf_of(stats), 0.0)
    names = [f"k{i}" for i in range(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for ids in batch.column("ids").to_pylist():
                term, tf = distinct(np.frombuffer(ids, "<u2"))
                weight = impacts(tf, idf[term], len(ids) // 2, stats.mean_length)
                term, weight = term[weight > 0], weight[weight > 0]
                keys.append([int(term[np.argmin(r[term] / weight)]) if len(term) else -1 for r in races])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int32()) for i in range(terms))], [*batch.schema.names, *names])

    return tokenised.mapInArrow(run, ", ".join(["doc_id long, ids binary, n long", *(f"{n} int" for n in names)]))


def dealt(keyed: DataFrame, shard_tokens: int) -> DataFrame:
    """The rows of a stored table (doc_id, ids, n, k0, k1) with the shard of each: about shard_tokens tokens, twice that at most but for a document's own length.

    On the driver are the tokens of each first term (bounded by the vocabulary). Places of more than
    a shard after the second term, of which there are fewer than tokens / (2 * shard_tokens), are broadcast.
    """
    counted = materialise(keyed.groupBy("k0", "k1").agg(F.sum("n").alias("n")), "packing-terms")
    totals = counted.groupBy("k0").agg(F.sum("n").alias("n")).toArrow()
    terms, tokens = np.asarray(totals["k0"]), np.asarray(totals["n"])
    order = np.argsort(terms)
    terms, tokens = terms[order], tokens[order]
    parts = np.where(tokens > shard_tokens, -(-2 * tokens // shard_tokens), 1)
    # small terms share shards, large ones have numbers of their own behind them
    small = np.where(parts == 1, tokens, 0)
    first = (np.cumsum(small) - small) // shard_tokens
    large = np.cumsum(np.where(parts > 1, parts, 0)) - np.where(parts > 1, parts, 0)
    start = np.where(parts == 1, first, first[-1] + 1 + large) if len(terms) else first
    places = keyed.sparkSession.createDataFrame(pa.table({"k0": pa.array(terms, pa.int32()), "place0": pa.array(start.astype(np.int64)), "parts": pa.array(parts.astype(np.int64))}))
    placed = lambda frame: frame.join(F.broadcast(places), "k0").withColumn("place", F.col("place0") + F.pmod(F.xxhash64("k1"), "parts"))
    over = placed(counted).groupBy("place").agg(F.sum("n").alias("m")).where(F.col("m") > 2 * shard_tokens)
    over = over.select("place", F.ceil(F.col("m") / shard_tokens).alias("split"))
    # by the place in the stored table, since ids and texts may be those of any number of rows
    spread = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "split"), F.lit(0))
    return placed(keyed).join(F.broadcast(over), "place", "left").select("doc_id", "ids", "n", (F.shiftleft(F.col("place"), 20) + spread).alias("shard"))


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, tokenizer: str, window: int = WINDOW, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: its document, where it starts there, its ids' CRC-32 (32-bit little-endian), its sequence and offset."""
    tokenised, path = stored(tokenise(df, tokenizer, END_ID, id_col, text_col), "packing-ids")
    stats = statistics(tokenised)
    keyed = materialise(drawn(tokenised, stats), "packing-drawn")
    remove(df.sparkSession, path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.append_column("none", pa.compute.is_valid(shard["doc_id"])).sort_by([("none", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])
        documents = [np.frombuffer(x, "<u2") for x in shard["ids"].to_pylist()]
        ids = shard["doc_id"].to_pylist()
        base = shard["shard"][0].as_py() << 17  # windows of a shard
        rows = [(ids[d], start, n, zlib.crc32(documents[d][start : start + n].astype("<u4").tobytes()), len(documents[d]), base + sequence, offset) for d, start, n, sequence, offset in pack_shard(documents, stats, window)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, zip(*rows))})

    return dealt(keyed, shard_tokens).groupBy("shard").applyInArrow(run, PIECE_SCHEMA)
