"""Secret scans: fixed credential patterns, and character Markov models for the rest.

First-order character models are trained from labelled strings of the corpus itself: what the
fixed patterns find is labelled secret, every other run of token characters ordinary. Transitions
are counted over all documents (at most three tables of 128 x 128 reach the driver). Beside the
model of found secrets stand models of uniform credential alphabets, drawn from a seeded generator, so
that kinds of secrets are known which the corpus doesn't show; the ordinary model allows for what
identifiers have and prose lacks: joints, digits, capitals within. A run of 20 or more token
characters is a secret where the log-likelihood ratio of the best random model against the ordinary
one exceeds a bound per character, which follows from all labelled strings, each distinct one once: secrets, each
scored by the models of the half of the secrets that it is not in, and ordinary runs. Their ratios are counted
in steps of 1 / 4096, so the bound is exact to a step.

Defined cases: a null or empty text holds no span; spans of the fixed patterns always stay, and
a span of the models is given only where it overlaps none of them. Offsets are code points, ends
exclusive. Null ids are scanned like others, repeated rows give repeated results. A corpus without labelled
secrets has the generated models. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, materialise

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LONG = re.compile(rb"[A-Za-z0-9+/_=-]{8,}")
_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _mask(chars: bytes) -> bytes:
    return bytes(120 if b in chars else 32 for b in range(256))


_HEX_MASK, _RUN_MASK = _mask(b"0123456789abcdef"), _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")

Span = tuple[str, int, int, float]


def base_spans(text: str, data: bytes | None = None) -> list[Span]:
    """Spans of the three fixed patterns; substring and byte-class tests skip texts that hold none."""
    data = text.encode("utf-8", "surrogatepass") if data is None else data
    found: list[Span] = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in data.translate(_HEX_MASK):
        found += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass(frozen=True)
class MarkovScorer:
    """Log-probabilities by (previous, next) byte; row 0 stands for the start of a string."""

    random: np.ndarray  # alphabets x 128 x 128
    ordinary: np.ndarray  # 128 x 128
    per_char: float = 0.0  # the bound of the ratio a character

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio a character, of the likeliest random source against ordinary identifiers."""
        codes = np.frombuffer(b"\x00" + token.encode("ascii"), np.uint8)
        a, b = codes[:-1], codes[1:]
        return float((self.random[:, a, b].sum(axis=1).max() - np.log(len(self.random)) - self.ordinary[a, b].sum()) / len(b))

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """ratio() of each of some strings, none of them empty."""
        codes = np.frombuffer(("\n" + "\n".join(tokens)).encode("ascii"), np.uint8).astype(np.int64)
        codes[codes == 10] = 0  # the start of a string
        pairs = (codes[:-1] * 128 + codes[1:])[codes[1:] > 0]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(sizes) - sizes
        summed = lambda table: np.add.reduceat(table.ravel()[pairs], starts)
        best = np.maximum.reduce([summed(r) for r in self.random])
        return (best - np.log(len(self.random)) - summed(self.ordinary)) / sizes


def _transitions(tokens: list[str], smoothing: float) -> np.ndarray:
    """Log-probabilities of the characters that follow each other in tokens; a line break stands between two of them."""
    codes = np.frombuffer(("\n" + "\n".join(tokens)).encode("ascii"), np.uint8).copy()
    codes[codes == 10] = 0  # the start of a string
    pairs = codes[:-1].astype(np.int64) * 128 + codes[1:]
    counts = np.bincount(pairs[codes[1:] > 0], minlength=128 * 128).reshape(128, 128) + smoothing
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def values(text: str, spans: list[Span]) -> list[str]:
    """The secret strings of base spans: of an assignment what is assigned."""
    return [ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end] for kind, start, end, _ in spans]


#: Steps of a ratio, of which the bound is one.
STEPS = 4096
#: Distinct strings that a task holds before it hands them over.
MOST_STRINGS = 200_000


@dataclass
class Labelled:
    """Transitions of ordinary strings and of both halves of the secrets, and the distinct strings (at most `most` more than a slice's)."""

    most: int = MOST_STRINGS
    counts: np.ndarray = None  # 3 x 128 * 128; 0 ordinary, 1 and 2 the secrets of even and odd checksum
    strings: tuple[dict[str, None], ...] = None

    def __post_init__(self):
        self.counts, self.strings = np.zeros((3, 128 * 128), np.int64), ({}, {}, {})

    def _count(self, label: int, data: bytes) -> None:
        codes = np.frombuffer(b"\x00" + data, np.uint8)
        codes = np.where(_TOKEN_BYTES[codes], codes, 0).astype(np.int64)
        into = codes[1:] > 0
        self.counts[label] += np.bincount((codes[:-1] * 128 + codes[1:])[into], minlength=128 * 128)

    def add(self, texts: list[str]) -> None:
        ordinary = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            spans = base_spans(text, data)
            for value in values(text, spans):
                half = 1 + (zlib.crc32(value.encode()) & 1)
                self._count(half, value.encode())
                if len(value) >= 20:
                    self.strings[half][value] = None
            if spans:
                data = redacted(text, spans, "\n").encode("utf-8", "surrogatepass")
            ordinary.append(data)
        joined = b"\n".join(ordinary)
        self._count(0, joined)
        self.strings[0].update(dict.fromkeys(run.decode() for run in dict.fromkeys(_LONG.findall(joined))))

    @property
    def full(self) -> bool:
        return sum(map(len, self.strings)) >= self.most

    def taken(self) -> pa.RecordBatch:
        """The strings held, as rows; they are held no longer."""
        of = [(n, s) for n, held in enumerate(self.strings) for s in held]
        for held in self.strings:
            held.clear()
        none = [None] * len(of)
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in of], pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array([s for _, s in of], pa.string())], ["label", "pair", "n", "string"])

    def counted(self) -> pa.RecordBatch:
        label, pair = np.nonzero(self.counts)
        return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(self.counts[label, pair], pa.int64()), pa.array([None] * len(pair), pa.string())], ["label", "pair", "n", "string"])


def _ordinary(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of ordinary identifiers: those counted, mixed with what joins words to identifiers."""
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
    digits, joints = np.frombuffer(b"0123456789", np.uint8), np.frombuffer(b"_-/+=", np.uint8)
    counted = counts.reshape(128, 128) + 0.05
    p = counted / counted.sum(axis=1, keepdims=True)
    start = p[0]
    upper = np.zeros(128)
    upper[letters[:26]] = start[letters[:26]] + start[letters[26:]]
    upper /= upper.sum()
    joint, digit = np.zeros(128), np.zeros(128)
    joint[joints], digit[digits] = 1 / len(joints), 1 / len(digits)
    p[letters] = 0.92 * p[letters] + 0.03 * joint + 0.03 * upper + 0.02 * digit
    p[digits] = 0.6 * p[digits] + 0.2 * digit + 0.1 * joint + 0.1 * start
    p[joints] = 0.4 * p[joints] + 0.3 * start + 0.1 * upper + 0.1 * digit
    p[joints, joints] += 0.1
    return np.log(p)


def _drawn(seed: int, n: int, skip: int = 0) -> list[list[str]]:
    """n strings of each alphabet; skip: those drawn before from the same seed."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [[row.tobytes().decode() for row in np.frombuffer(a.encode(), np.uint8)[rng.integers(0, len(a), (n, 32))]] for a in _ALPHABETS]
    if skip:
        draw(skip)
    return draw(n)


def models(counts: np.ndarray, seed: int = 11, strings: int = 4000) -> list[MarkovScorer]:
    """Scorers without a bound: 0 of all counts; 1 and 2 without the secrets of that half, which they judge."""
    random = [_transitions(d, 1e-3) for d in _drawn(seed, strings)]
    ordinary = _ordinary(counts[0])
    out = []
    for secret in (counts[1] + counts[2], counts[2], counts[1]):
        kinds = list(random)
        if secret.sum() >= 1000:
            seen = secret.reshape(128, 128) + 0.01 * sum(np.exp(r) for r in random)
            kinds.append(np.log(seen / seen.sum(axis=1, keepdims=True)))
        out.append(MarkovScorer(np.stack(kinds), ordinary))
    return out


def steps_of(scorer: MarkovScorer, strings: list[str], step: int = 50_000) -> Counter:
    """How many strings have their ratio in which step."""
    found: Counter = Counter()
    for i in range(0, len(strings), step):
        steps, n = np.unique(np.floor(scorer.ratios(strings[i : i + step]) * STEPS).astype(np.int64), return_counts=True)
        found.update(dict(zip(steps.tolist(), n.tolist())))
    return found


def bounded(scorers: list[MarkovScorer], steps: list[dict[int, int]], seed: int = 11, strings: int = 4000) -> MarkovScorer:
    """The scorer of all counts with its bound, from the steps of ordinary runs, and of both halves of the secrets.

    The bound is the ratio that 99 of 100 secrets reach, all that were found and as many generated
    ones as make 1,000 of them, or that which at most one of 1,000 ordinary runs reaches, if it is higher.
    Secrets shorter than the runs that are judged (20 characters) are left out, as are ordinary runs of under 8.
    """
    good = Counter(steps[1]) + Counter(steps[2])
    missing = max(0, -(-(1000 - good.total()) // len(_ALPHABETS)))
    good += steps_of(scorers[0], [s for d in _drawn(seed, missing, strings) for s in d])

    def reached(held: Counter, share: float, over: int) -> float:
        """The end of the first step up to which this share of the strings lies, or (over 0) its start."""
        at = np.array(sorted(held), np.int64)
        upto = np.cumsum([held[x] for x in at.tolist()])
        return (int(at[np.searchsorted(upto, share * upto[-1], side="left" if over else "right")]) + over) / STEPS

    return MarkovScorer(scorers[0].random, scorers[0].ordinary, max(reached(good, 0.01, 0), reached(Counter(steps[0]), 0.999, 1) if steps[0] else 0.0))


def train(texts: Iterable[str], seed: int = 11) -> MarkovScorer:
    """The models of some texts."""
    found = Labelled()
    found.add(list(texts))
    scorers = models(found.counts, seed)
    return bounded(scorers, [steps_of(scorers[label], list(found.strings[label])) for label in range(3)], seed)


def fit(df: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> MarkovScorer:
    """Trains on all whole texts, and on all of their labelled strings. To the driver go counts alone: of transitions (3 x 128 x 128 at most), and of the steps of ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Labelled()
        for batch in in_slices(batches, "text"):
            found.add(batch.column("text").to_pylist())
            if found.full:
                yield found.taken()
        yield found.taken()
        yield found.counted()

    rows = materialise(id_and_text(df, id_col, text_col).mapInArrow(run, "label int, pair int, n long, string string"), "secrets-labelled")
    summed = rows.where("pair is not null").groupBy("label", "pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((3, 128 * 128), np.int64)
    counts[np.asarray(summed["label"], np.int64), np.asarray(summed["pair"], np.int64)] = np.asarray(summed["n"], np.int64)
    scorers = models(counts, seed)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [Counter(), Counter(), Counter()]
        for batch in batches:
            label, strings = np.asarray(batch.column("label")), batch.column("string").to_pylist()
            for n in range(3):
                steps[n].update(steps_of(scorers[n], [strings[i] for i in np.flatnonzero(label == n).tolist()]))
        found = [(n, step, many) for n in range(3) for step, many in steps[n].items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["label", "step", "n"])

    judged = rows.where("string is not null").select("label", "string").distinct().mapInArrow(judge, "label int, step long, n long")
    steps: list[dict[int, int]] = [{}, {}, {}]
    for r in judged.groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
        steps[r.label][r.step] = r.n
    return bounded(scorers, steps, seed)


def spans_of(text: str, scorer: MarkovScorer) -> list[Span]:
    data = text.encode("utf-8", "surrogatepass")
    spans = base_spans(text, data)
    if b"x" * 20 in data.translate(_RUN_MASK):
        fixed = spans
        for m in RUN.finditer(text):
            if (r := scorer.ratio(m[0])) > scorer.per_char and not any(s < m.end() and m.start() < e for _, s, e, _ in fixed):
                spans = [*spans, ("markov", m.start(), m.end(), r)]
        spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_secrets(df: DataFrame, scorer: MarkovScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of every whole text. One narrow pass; the models travel with the task (a few hundred KB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t, scorer)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPAN)], ["doc_id", "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, scorer: MarkovScorer | None = None) -> DataFrame:
    found = find_secrets(df, scorer or fit(df))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), count("markov"))


def redacted(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """Each span, or union of overlapping spans, replaced."""
    out, at = [], 0
    for _, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, scorer: MarkovScorer) -> DataFrame:
    """The rows of df with all secrets of their text column replaced; texts without any stay as they are, null too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = [t if t is None else redacted(t, spans_of(t, scorer)) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
