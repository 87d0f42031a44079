"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes proposes boundaries. Chunk sizes are normalised: below the
normal size a boundary needs a strict mask, beyond it a loose one, and a chunk ends at the
largest size at the latest. A fingerprint is the set of chunk digests, each weighted by the
bytes that its chunk covers in the document; an insertion shifts bytes but leaves the chunks
on either side of it as they were.

Defined cases: a null text counts as empty and has the empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another are not (0.0). Equal texts have equal
fingerprints. Rows with equal ids are ordered by their text; null ids come first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: A gear hash of 32 bits depends on the last 32 bytes.
WINDOW = 32
_ENTRY = np.dtype([("digest", ">u8"), ("weight", ">u4")])


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; the smallest must be the gear window at least, so hashes never reach back over a start."""

    smallest: int = 32
    normal: int = 96
    largest: int = 512
    strict_bits: int = 7
    loose_bits: int = 5
    seed: int = 7

    def __post_init__(self):
        if not WINDOW <= self.smallest <= self.normal <= self.largest:
            raise ValueError("sizes must satisfy 32 <= smallest <= normal <= largest")

    def gear(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-j]] << j over the 32 last bytes, by doubling the span five times."""
    h, span = gear[data], 1
    while span < WINDOW:
        out = h.copy()
        out[span:] += h[:-span] << np.uint32(span)
        h, span = out, span * 2
    return h


def boundaries(data: bytes, how: Chunking, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of data, the last one len(data)."""
    n = len(data)
    if n <= how.smallest:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8), gear)
    top = np.uint32(32 - how.loose_bits)
    loose = np.flatnonzero(h >> top == 0)
    strict = h[loose] >> np.uint32(32 - how.strict_bits) == 0
    loose += 1  # a boundary lies behind its byte
    at, stops = loose.tolist(), loose[strict].tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > how.smallest:
        low, mid, high = start + how.smallest, start + how.normal, min(start + how.largest, n)
        while j < len(stops) and stops[j] < low:
            j += 1
        if j < len(stops) and stops[j] < mid and stops[j] <= high:
            end = stops[j]
        else:
            while i < len(at) and at[i] < mid:
                i += 1
            end = at[i] if i < len(at) and at[i] <= high else high
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(data: bytes, how: Chunking, gear: np.ndarray) -> dict[int, int]:
    """Digest of each distinct chunk -> bytes that it covers."""
    out: dict[int, int] = {}
    start = 0
    for end in boundaries(data, how, gear):
        d = xxhash.xxh3_64_intdigest(data[start:end])
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def serialise(weights: dict[int, int]) -> str:
    entries = np.array(sorted(weights.items()), dtype=np.uint64).reshape(-1, 2)
    packed = np.empty(len(entries), _ENTRY)
    packed["digest"], packed["weight"] = entries[:, 0], entries[:, 1]
    return base64.b64encode(packed.tobytes()).decode()


def parse(fingerprint: str) -> dict[int, int]:
    packed = np.frombuffer(base64.b64decode(fingerprint), _ENTRY)
    return dict(zip(packed["digest"].tolist(), packed["weight"].tolist()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Weight of the shared chunks over that of the smaller document: containment, 0 to 1."""
    small = min(sum(a.values()), sum(b.values()))
    if not small:
        return 1.0 if not a and not b else 0.0
    if len(b) < len(a):
        a, b = b, a
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / small


def fingerprint_text(text: str, how: Chunking = Chunking()) -> str:
    return serialise(chunk_weights(text.encode("utf-8", "surrogatepass"), how, how.gear()))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:
    """doc_id, fingerprint of every row; extra columns are left behind. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = how.gear()
        for batch in batches:
            prints = [serialise(chunk_weights(t.encode(), how, gear)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def in_runs(df: DataFrame, rows_a_run: int = 64) -> DataFrame:
    """Deals rows (doc_id, text) into runs of neighbouring ids, sorted; columns run, guest, doc_id, text.

    Behind its own rows each run holds, as a guest, the row that follows its last one (for the
    last run: the very first row). The cuts between runs are quantiles of the ids alone, so
    texts are moved once and only the guests twice. Their number is bound to the number of
    shuffle partitions, whatever the number of rows.
    """
    spark = df.sparkSession
    ids = df.select("doc_id")
    rows, first = ids.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    n_runs = max(1, min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // rows_a_run))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n_runs for i in range(1, n_runs)], 0.2 / n_runs))) if n_runs > 1 else []
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    if cuts:
        held = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="run")
        placed = held.transform(df.withColumn("place", place)).withColumn("run", F.col("run").cast("int"))
        begins = (F.col("run") > 0) & (F.element_at(F.array(*map(F.lit, cuts)), F.greatest("run", F.lit(1))) == F.col("place"))
        own = F.struct("run", F.lit(False).alias("guest"))
        ahead = F.struct((F.col("run") - 1).alias("run"), F.lit(True).alias("guest"))
        placed = placed.withColumn("to", F.explode(F.when(begins, F.array(own, ahead)).otherwise(F.array(own))))
        placed = placed.select("to.run", "to.guest", "doc_id", "text")
    else:
        placed = df.select(F.lit(0).alias("run"), F.lit(False).alias("guest"), "doc_id", "text")
    nulls = rows and df.where("doc_id is null").limit(1).count()
    head = df.where("doc_id is null") if nulls else df.where(F.col("doc_id") == F.lit(first))
    head = head.orderBy("text").limit(1).select(F.lit(len(cuts)).alias("run"), F.lit(True).alias("guest"), "doc_id", "text")
    return placed.unionByName(head).repartition(F.col("run")).sortWithinPartitions("run", "guest", F.col("doc_id").asc_nulls_first(), "text")


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points of text replaced by as many (or all) first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:
    """Fingerprints every text, its half-edited text, and their likeness to it and to the next document's.

    An empty table gives an empty result; a single row is its own next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = how.gear()
        held = None  # run, id, text, weights, fingerprint of the row that still waits for the next one
        for batch in batches:
            out = []
            for r, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text"))):
                if guest and (held is None or held[0] != r):
                    continue  # a further row of the guest's id
                weights = chunk_weights(text.encode(), how, gear)
                if held is not None and held[0] == r:
                    _, own_id, own, own_weights = held
                    edited = edited_text(own, text).encode()
                    edited_weights = chunk_weights(edited, how, gear)
                    out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), serialise(own_weights), serialise(edited_weights), likeness(own_weights, edited_weights), likeness(own_weights, weights)))
                held = None if guest else (r, doc_id, text, weights)
            yield pa.RecordBatch.from_pylist([dict(zip(_EDITED.names, x)) for x in out], schema=_EDITED)

    return in_runs(id_and_text(df, id_col, text_col)).mapInArrow(run, EDITED_SCHEMA)


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
