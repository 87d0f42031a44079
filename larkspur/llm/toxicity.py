"""Toxicity by a weighted finite-state pattern grammar.

A lexicon of insults (words and word stems, with weights) is learned from labelled rows. Small
transducers then read the words of each clause: one scopes negation, one reported speech, one
quotations, one targets, one threats. They are composed into a single machine, which tells for each
match whether it is plain, aimed at someone, negated, reported, or a threat against someone. What
is scored is the matched clauses, by class: the weight of each class is fitted to the labels, from
a prior in which an aimed insult counts more and a negated or reported one less, so the grammar
decides as far as the labels bear it out.

Defined cases: a null or empty text, or one without a match, gets the score of no evidence.
Rows with null ids are scored and held in. Repeated rows give repeated results; of texts with one
labelled id the smallest is learned from. Ties between stems go to the one with fewer clean texts, then
the longer, then the later in the alphabet. Without labelled rows of both classes there are no stems,
only threats, and the prior's weights stand. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, in_slices

THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;\n]+")
WORDS = {
    "negation": "not no never neither nor without isn aren wasn don doesn didn nicht kein keine keinen nie ne pas jamais aucun nunca ningún sin",
    "report": "said says say told wrote writes quoted quote called according reported sagte sagt schrieb laut dit écrit selon dijo dice escribió según",
    "target": "you your yours he she him her they them their this that who du dich ihr dein er sie tu te toi vous votre il elle tú usted él ella ellos",
    "threat": "kill hurt destroy beat crush burn stab shoot töten schlagen tuer frapper matar golpear",
}
CLASS_OF = {w: kind for kind, words in WORDS.items() for w in words.split()} | {q: "quote" for q in '"“”„«»'}


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, output symbol); symbols without an arc pass through and lead to `otherwise`."""

    arcs: dict[str, dict[str, tuple[str, str]]]
    otherwise: dict[str, str]
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get(state, {}).get(symbol) or (self.otherwise.get(state, state), symbol)


def compose(*machines: Transducer) -> "Composed":
    return Composed(machines)


@dataclass
class Composed:
    """The product machine, its states made as they are met; each output is read by the next machine."""

    machines: tuple[Transducer, ...]
    known: dict[tuple[tuple[str, ...], str], tuple[tuple[str, ...], str]] = field(default_factory=dict)

    def start(self) -> tuple[str, ...]:
        return tuple(m.start for m in self.machines)

    def step(self, state: tuple[str, ...], symbol: str) -> tuple[tuple[str, ...], str]:
        got = self.known.get((state, symbol))
        if got is None:
            nxt, out = [], symbol
            for m, s in zip(self.machines, state):
                s, out = m.step(s, out)
                nxt.append(s)
            got = self.known[state, symbol] = (tuple(nxt), out)
        return got


def _scope(trigger: str, mark: str, span: int, hits: tuple[str, ...]) -> Transducer:
    """Within `span` words behind a trigger, symbols of `hits` get a mark."""
    marked = {h: f"{mark}{h}" for h in hits}
    arcs = {"0": {trigger: (str(span), trigger)}}
    otherwise = {}
    for left in range(span, 0, -1):
        arcs[str(left)] = {trigger: (str(span), trigger)} | {h: (str(left - 1), m) for h, m in marked.items()}
        otherwise[str(left)] = str(left - 1)
    return Transducer(arcs, otherwise)


def _quoted(mark: str, hits: tuple[str, ...]) -> Transducer:
    """Between quotation marks, symbols of `hits` get a mark."""
    return Transducer({"0": {"quote": ("1", "quote")}, "1": {"quote": ("0", "quote")} | {h: ("1", f"{mark}{h}") for h in hits}}, {})


def _threats(span: int) -> Transducer:
    """A threat that names a target within `span` words behind it; reported ones keep their mark, negated ones are none."""
    arcs: dict[str, dict[str, tuple[str, str]]] = {"0": {}}
    otherwise = {}
    for mark, name in (("", "t"), ("~", "r")):
        begin = {f"{at}{mark}threat": (f"{name}{span}", "word") for at in ("", "@")}
        arcs["0"] |= begin
        for left in range(span, 0, -1):
            arcs[f"{name}{left}"] = {"target": ("0", f"{mark}threatened")}
            otherwise[f"{name}{left}"] = f"{name}{left - 1}" if left > 1 else "0"
    return Transducer(arcs, otherwise)


#: "-" negated, "~" reported, "@" aimed at someone; the last machine pairs a threat with a target.
GRAMMAR = compose(
    _scope("negation", "-", 3, ("insult", "threat")),
    _scope("report", "~", 12, ("insult", "threat", "-insult", "-threat")),
    _quoted("~", ("insult", "threat", "-insult", "-threat")),
    _scope("target", "@", 5, ("insult", "threat", "-insult", "~insult", "~threat", "~-insult")),
    _threats(4),
)
#: Classes of matches, and the prior of their weights: multiples of one slope.
CLASSES = {"plain": 1.0, "aimed": 1.25, "negated": 0.4, "reported": 0.5, "threat": 1.0}
SLOPE = 3.0


def class_of(symbol: str) -> str | None:
    if symbol.endswith("threatened"):
        return "reported" if "~" in symbol else "threat"
    if not symbol.endswith("insult"):
        return None
    return "reported" if "~" in symbol else "negated" if "-" in symbol else "aimed" if "@" in symbol else "plain"


_NUMBER = {c: i for i, c in enumerate(CLASSES)}
PRIOR = (-2.5, *(SLOPE * m for m in CLASSES.values()))


@dataclass
class Scorer:
    """stems: start of a word -> weight (a whole word is a stem of itself); curve: intercept and a weight for each class."""

    stems: dict[str, float]
    curve: tuple[float, ...] = PRIOR
    grammar: bool = True  # False: all matches count as plain, to measure what the grammar decides

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems})

    def weight(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), default=0.0)

    def clauses(self, low: str) -> list[list[float]]:
        """For each clause with a match, of a lower-cased text, its weight in each class."""
        if not any(s in low for s in self.stems) and not any(t in low for t in _THREATS):
            return []
        out = []
        step = GRAMMAR.step
        for clause in _CLAUSE.split(low):
            state, found = GRAMMAR.start(), None
            for word in _TOKEN.findall(clause):
                weight = self.weight(word)
                state, symbol = step(state, "insult" if weight else CLASS_OF.get(word, "word"))
                kind = class_of(symbol)
                if kind is not None:
                    found = found or [0.0] * len(CLASSES)
                    found[_NUMBER[kind] if self.grammar else 0] += weight or 1.0
            if found:
                out.append(found)
        return out

    def features(self, text: str) -> list[float]:
        """Of each class the logarithm of what its clauses weigh in all."""
        found = self.clauses(text.lower())
        return [math.log1p(sum(c)) for c in zip(*found)] if found else [0.0] * len(CLASSES)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_THREATS = WORDS["threat"].split()


def _stems_of(text: str, longest: int = 7) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w[:n] for w in words for n in range(4, min(len(w), longest) + 1)} | {w for w in words if len(w) > longest}


def _unlike(sets: list[set[str]], slots: int = 8) -> list[set[str]]:
    """Leaves out sets that share half of eight minimum hashes with an earlier one: copies would vouch for each other."""
    seen: list[dict[int, list[int]]] = [{} for _ in range(slots)]
    kept = []
    for i, s in enumerate(sets):
        hashes = np.array([zlib.crc32(x.encode()) for x in s] or [0], np.uint64)
        least = [int(((hashes * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min()) for k in range(slots)]
        met = Counter(j for k in range(slots) for j in seen[k].get(least[k], ()))
        if not met or met.most_common(1)[0][1] < slots // 2:
            kept.append(s)
            for k in range(slots):
                seen[k].setdefault(least[k], []).append(i)
    return kept


def learn_stems(toxic: list[str], clean: list[str], cover: int = 3, fewest: int = 3, most: int = 400) -> dict[str, float]:
    """Stems that mark toxic texts: each turn takes the one that covers most texts not yet covered `cover` times.

    A stem must be met in `fewest` unlike toxic texts and hardly ever in clean ones; its weight
    grows with its smoothed log-odds, 1.0 at most.
    """
    sets = _unlike([_stems_of(t) for t in toxic])
    times = Counter(s for x in sets for s in x)
    often = {s for s, n in times.items() if n >= fewest}
    against: Counter[str] = Counter()
    for t in clean:
        against.update(_stems_of(t) & often)
    share = len(clean) / max(1, len(sets))
    good = {s for s in often if against[s] <= 0.02 * times[s] * max(1.0, share) and math.log((times[s] + 0.5) / (against[s] + 0.5) * max(share, 0.1)) > 2.5}
    holders: dict[str, list[int]] = {s: [] for s in good}
    for i, x in enumerate(sets):
        for s in x & good:
            holders[s].append(i)
    need = [cover] * len(sets)
    out: dict[str, float] = {}
    gain = {s: len(h) for s, h in holders.items()}
    while gain and len(out) < most:
        # ties: fewer clean texts, then the longer stem, then spelling
        stem = max(gain, key=lambda s: (gain[s], -against[s], len(s), s))
        if gain[stem] < fewest:
            break
        odds = math.log((times[stem] + 0.5) / (against[stem] + 0.5) * max(share, 0.1))
        out[stem] = min(1.0, odds / 5)
        del gain[stem]
        for i in holders[stem]:
            need[i] -= 1
            if need[i] == 0:
                for s in sets[i] & gain.keys():
                    gain[s] -= 1
        for s in [s for s in gain if s.startswith(stem) or stem.startswith(s)]:
            del gain[s]  # the same words once more
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, turns: int = 30) -> tuple[float, ...]:
    """Logistic regression of labels on the class weights, drawn to the prior by `ridge`, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    prior = np.array(PRIOR)
    keep = np.diag([1e-3] + [ridge] * (a.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (w - prior) @ keep @ (w - prior) / 2)

    w, now = prior.copy(), loss(prior)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        way, size = np.linalg.solve((a.T * (p * (1 - p))) @ a + keep, a.T @ (y - p) - keep @ (w - prior)), 1.0
        while (new := loss(w + size * way)) > now and size > 1e-4:
            size /= 2
        w, now = w + size * way, new
    return tuple(float(v) for v in w)


def train(texts: Iterable[str], toxic: Iterable[int], grammar: bool = True) -> Scorer:
    """Learns the stems, then the weights of the classes that the grammar tells apart."""
    rows = [(t or "", int(y)) for t, y in zip(texts, toxic)]
    bad, good = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not bad or not good:
        return Scorer({}, grammar=grammar)
    scorer = Scorer(learn_stems(bad, good), grammar=grammar)
    return Scorer(scorer.stems, fit_curve(np.array([scorer.features(t) for t, _ in rows]), np.array([y for _, y in rows], float)), grammar)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_chars: int = 64_000_000) -> Scorer:
    """Trains on labelled rows that are not held out, in order of a hash of their ids: up to `sample_rows`, and up to `sample_chars` of text in all.

    Only ids are ordered; what reaches the driver is bounded by both parameters, and length plays no part in the choice.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    texts = id_and_text(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    total = F.sum(F.length("text")).over(W.orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over sample_rows rows
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("total", total).where(F.col("total") <= sample_chars)
    found = found.select("text", "toxic", "doc_id").toArrow().sort_by("doc_id")
    return train(found["text"].to_pylist(), found["toxic"].to_pylist())


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(df: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores under the threshold, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
