"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding is the merge type: symbols start as characters, an agenda holds every adjacent pair
that is a piece, best score first and leftmost among equals, and each candidate that comes up
is skipped where its keyed hash falls under the dropout rate. The key is drawn from the seed, the
document and the place of the word in it, so every occurrence of a word is cut for itself, and in
the same way in every run, on every executor. A rate of 0 gives the model's plain segmentation.

No piece of the model spans from a character to a following word mark, so text is encoded word
by word (marks and the characters behind them). A bounded cache holds each word's plain segmentation
and the merges that lead to it; an occurrence none of whose merges is skipped has that segmentation,
and the others run through the agenda.

Defined cases: a null or empty text has no pieces and decodes to the empty string. Repeated
rows (equal id and text) give equal pieces. Null ids count as 0 in the key. An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import id_and_text, in_slices

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]*")
_MASK = (1 << 64) - 1


def mix(x: int) -> int:
    """SplitMix64's finaliser: a keyed hash of 64 bits."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix_array(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Stands for a word mark that the text itself holds; no valid text has a lone surrogate.
_OWN_MARK = "\ud800"
_ODD = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.int32).max
_SHORT = 48
_PLACE = 6  # bits of a place in a short word
_SLOTS = 18  # bits of the table of pairs
_TOGETHER = 8192  # short words merged at once, occurrences looked at at once: their arrays stay in a core's cache


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one behind the other."""
    upto = np.cumsum(sizes)
    return values[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)]


@dataclass
class Runs:
    """Runs of numbers in one array that grows: run i is values[starts[i] : starts[i] + sizes[i]]."""

    values: np.ndarray
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    n: int = 0  # runs
    used: int = 0  # values

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(values)
        if n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate((x, np.empty(2 * n - len(x), np.int64))) for x in (self.starts, self.sizes))
        if used > len(self.values):
            self.values = np.concatenate((self.values, np.empty(2 * used - len(self.values), self.values.dtype)))
        self.values[self.used : used] = values
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these runs, and their sizes."""
        sizes = self.sizes[at]
        return gathered(self.values, self.starts[at], sizes), sizes


class _Numbers(dict):
    """Numbers words in the order in which they are asked for first, so that each occurrence is looked up once."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Pieces:
    """A merge-type model: pieces as bytes, and what each pair of pieces merges to."""

    char_ids: dict[str, int]
    pairs: dict[int, int]  # left << 16 | right -> place of the merged piece in the order of scores
    by_rank: list[int]
    byte_ids: list[int]
    data: list[bytes]
    ranked: np.ndarray
    slots: list[tuple[np.uint64, np.ndarray]]
    char_table: np.ndarray
    prefix: bool = True  # a mark is put before the text, as the model's normaliser does
    words: dict[str, int] = field(default_factory=dict)  # the runs of a short word in the two that follow
    plain: Runs = field(default_factory=lambda: Runs(np.empty(0, np.int32)))  # its plain ids
    merges: Runs = field(default_factory=lambda: Runs(np.empty(0, np.uint64)))  # and the merges that lead to them

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        bytes_of = {i: bytes([int(texts[i][3:5], 16)]) for i in range(n) if model.is_byte(i)}
        byte_ids = [0] * 256
        for i, b in bytes_of.items():
            byte_ids[b[0]] = i
        ids = {t: i for i, t in enumerate(texts) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if n >= 1 << 16 or any(re.search(f"[^{MARK}]{MARK}", t) for t in ids):
            raise ValueError("too many pieces, or a piece that spans a word mark")
        by_rank = sorted((i for t, i in ids.items() if len(t) > 1), key=lambda i: -model.get_score(i))
        pairs = {}
        for rank, i in enumerate(by_rank):
            for cut in range(1, len(texts[i])):
                left, right = ids.get(texts[i][:cut]), ids.get(texts[i][cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        data = [bytes_of.get(i, texts[i].replace(MARK, " ").encode()) for i in range(n)]
        char_ids = {t: i for t, i in ids.items() if len(t) == 1}
        table = np.full(0x110000, -1, np.int32)
        table[[ord(c) for c in char_ids]] = list(char_ids.values())
        # slots hold one pair each, its rank below it and between them whether others meet here: those go to a further table with another spread
        keys, ranks = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.uint64)
        slots, spread = [], _ODD
        while len(keys):
            odd = np.uint64(spread)
            slot = keys * odd >> np.uint64(64 - _SLOTS)
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << _SLOTS, 0xFFFFFFFF << 32, np.uint64)
            held[slot[first]] = keys[first] << np.uint64(32) | ranks[first]
            held[np.bincount(slot.astype(np.int64), minlength=1 << _SLOTS) > 1] |= np.uint64(1 << 31)
            slots.append((odd, held))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, spread = keys[rest], ranks[rest], mix(spread) | 1
        return cls(char_ids, pairs, by_rank, byte_ids, data, np.array(by_rank, np.int32), slots, table)

    def merge(self, word: str, key: int, threshold: int, taken: list[int] | None = None) -> bytes:
        """Pieces of one word; a candidate is skipped where the keyed hash of its piece and place is under threshold."""
        pairs, by_rank = self.pairs, self.by_rank
        char = self.char_ids.get
        n = len(word)
        held = [char(c, -1) for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is the rank of the merged piece above the place of its left symbol
        agenda = [r << 32 | i for i in range(n - 1) if (r := pairs.get(held[i] << 16 | held[i + 1])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            rank, left = entry >> 32, entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or held[left] < 0 or pairs.get(held[left] << 16 | held[right]) != rank:
                continue  # a side has changed meanwhile
            if threshold and ((key ^ entry) * _ODD & _MASK) >> 32 < threshold:
                continue
            if taken is not None:
                taken.append(entry)
            held[left], held[right] = by_rank[rank], -2
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                r = pairs.get(held[left] << 16 | held[far])
                if r is not None:
                    push(agenda, r << 32 | left)
            near = before[left]
            if near >= 0:
                r = pairs.get(held[near] << 16 | held[left])
                if r is not None:
                    push(agenda, r << 32 | near)
        return self._spelled((x, word[i]) for i, x in enumerate(held) if x != -2)

    def _spelled(self, symbols) -> bytes:
        """Pieces, with the bytes of each character (-1) that is none."""
        out: list[int] = []
        for piece, c in symbols:
            out += [piece] if piece >= 0 else self._bytes(c)
        return np.array(out, "<i4").tobytes()

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if c == _OWN_MARK else c).encode("utf-8", "surrogatepass")]

    def merge_many(self, words: list[str], keys: np.ndarray, threshold: int) -> list[bytes]:
        """merge() of many words at once."""
        ids, starts, sizes = self._segment(words, keys, threshold)
        return [ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())]

    def _merged(self, words: list[str], counts: np.ndarray, keys: np.ndarray, threshold: int, trace: bool = False) -> tuple[np.ndarray, ...]:
        """merge() of short words: ids and their number for each word; trace: also merges and their number.

        Words are columns, symbols are rows (a row of none before and behind them), so that each step is
        one operation over the words: in each round every word takes the best entry of its agenda.
        """
        width, most = len(words), max(int(counts.max()), 1)
        code_points = np.ascontiguousarray(np.array(words, f"U{most}").view(np.uint32).reshape(width, most).T)
        held = np.full((most + 2, width), -2, np.int32)
        held[1:-1] = np.where(np.arange(most, dtype=np.int64)[:, None] < counts, self.char_table[code_points], -2)
        agenda = np.full((most + 2, width), _NONE, np.int32)
        agenda[1:-1] = self._entries(held[1:-1].ravel(), held[2:].ravel(), np.repeat(np.arange(most, dtype=np.int32), width)).reshape(most, width)
        rows = np.arange(most + 2, dtype=np.int32)[:, None] * np.int32(width) + np.arange(width, dtype=np.int32)
        after, before = (rows + np.int32(width)).ravel(), (rows - np.int32(width)).ravel()
        held_flat, agenda_flat = held.ravel(), agenda.ravel()
        low, bound, spread = np.int32((1 << _PLACE) - 1), np.uint64(threshold), np.uint64(_ODD)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            best = agenda.min(axis=0)
            word = np.flatnonzero(best != _NONE)
            if not len(word):
                break
            entry = best[word]
            place = entry & low
            left = (place + np.int32(1)) * np.int32(width) + word.astype(np.int32)
            rank = entry >> np.int32(_PLACE)
            if threshold:
                merged = (keys[word] ^ (rank.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))) * spread >> np.uint64(32) >= bound
                agenda_flat[left[~merged]] = _NONE
                left, rank, place = left[merged], rank[merged], place[merged]
            if trace:
                done.append((word, rank.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)))
            piece = self.ranked[rank]
            right, near = after[left], before[left]
            far = after[right]
            held_flat[left], held_flat[right], agenda_flat[right] = piece, -2, _NONE
            after[left], before[far] = far, left
            agenda_flat[left] = self._entries(piece, held_flat[far], place)
            agenda_flat[near] = self._entries(held_flat[near], piece, near // np.int32(width) - np.int32(1))
        by_word = np.ascontiguousarray(held[1:-1].T)
        there = by_word != -2
        ids, sizes = by_word[there], there.sum(axis=1)
        if (none := ids < 0).any():
            spelled = [self._bytes(chr(c)) for c in code_points.T[there][none].tolist()]
            times = np.ones(len(ids), np.int64)
            times[none] = [len(x) for x in spelled]
            sizes = np.bincount(np.repeat(np.repeat(np.arange(width), sizes), times), minlength=width)
            ids = np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(spelled)
        if not trace:
            return ids, sizes
        word, merges = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint64)), *done))
        return ids, sizes, merges[np.argsort(word, kind="stable")], np.bincount(word, minlength=width)

    def _entries(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Agenda entries of adjacent symbols: rank of their piece above their place, or none."""
        pair = (left.astype(np.int64) << 16 | right).view(np.uint64)  # beyond 32 bits where a side is no piece
        entry = np.full(len(pair), _NONE, np.int32)
        todo: np.ndarray | slice = slice(None)
        for spread, slots in self.slots:
            sought = pair[todo]
            found = slots[sought * spread >> np.uint64(64 - _SLOTS)]
            hit = found >> np.uint64(32) == sought
            rank = found.astype(np.int32) & np.int32(0xFFFF)
            entry[todo] = np.where(hit, rank << np.int32(_PLACE) | place[todo], _NONE)
            more = (found & np.uint64(1 << 31)).astype(bool) & ~hit
            todo = np.flatnonzero(more) if isinstance(todo, slice) else todo[more]
            if not len(todo):
                break
        return entry

    def _segment(self, words: list[str], keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations of words under their keys, with the start and size of each: short words together, long ones by a heap each."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        sizes = np.zeros(len(words), np.int64)
        order = np.argsort(counts.clip(max=_SHORT + 1).astype(np.uint8), kind="stable")
        n_short = int(np.count_nonzero(counts <= _SHORT))
        parts = [np.empty(0, np.int32)]
        for a in range(0, n_short, _TOGETHER):
            part = order[a : min(a + _TOGETHER, n_short)]
            ids, sizes[part] = self._merged([words[i] for i in part.tolist()], counts[part], keys[part], threshold)
            parts.append(ids)
        for i in order[n_short:].tolist():
            parts.append(np.frombuffer(self.merge(words[i], int(keys[i]), threshold), "<i4"))
            sizes[i] = len(parts[-1])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts), starts, sizes

    def encode(self, texts: list[str], keys: list[int] | None = None, rate: float = 0.0, cache: int = 800_000) -> list[np.ndarray]:
        """Ids of each text; keys: what the seed and each document give."""
        ids, ends = self.encode_flat(texts, keys, rate, cache)
        ends = ends.tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode_flat(self, texts: list[str], keys: list[int] | None = None, rate: float = 0.0, cache: int = 800_000) -> tuple[np.ndarray, np.ndarray]:
        """encode() as one array, and where each text begins and ends in it. Words of all texts are segmented together."""
        threshold = int(rate * (1 << 32))
        if len(self.words) > cache:
            self.words, self.plain, self.merges = {}, Runs(np.empty(0, np.int32)), Runs(np.empty(0, np.uint64))
        distinct, of, counts = self._words(texts)
        ids, starts, sizes, merges, first, n_merges = self._plain(distinct)
        ends = np.cumsum([0, *counts])
        starts, sizes = starts[of], sizes[of]
        if threshold and len(of):
            place_of = np.arange(len(of), dtype=np.uint64) - np.repeat(ends[:-1], counts).astype(np.uint64)
            own = np.repeat(np.array(keys if keys else [0] * len(texts), np.uint64), counts)
            place_keys = mix_array(own ^ (place_of + np.uint64(1)) * np.uint64(_ODD))
            hits = [np.empty(0, np.int64)]
            for a in range(0, len(of), _TOGETHER):
                part, part_keys = of[a : a + _TOGETHER], place_keys[a : a + _TOGETHER]
                n = n_merges[part]
                entries = gathered(merges, first[part], n)
                skipped = (np.repeat(part_keys, n) ^ entries) * np.uint64(_ODD) >> np.uint64(32) < np.uint64(threshold)
                hit = np.zeros(len(part), bool)
                hit[np.repeat(np.arange(len(part)), n)[skipped]] = True
                hits.append(np.flatnonzero(hit) + a)
            hit = np.concatenate(hits)
            cut, cut_starts, sizes[hit] = self._segment([distinct[i] for i in of[hit].tolist()], place_keys[hit], threshold)
            starts[hit] = cut_starts + len(ids)
            ids = np.concatenate((ids, cut))
        out = np.empty(int(sizes.sum()), np.int32)
        upto = 0
        for a in range(0, len(of), _TOGETHER):
            part = gathered(ids, starts[a : a + _TOGETHER], sizes[a : a + _TOGETHER])
            out[upto : (upto := upto + len(part))] = part
        return out, np.concatenate(([0], np.cumsum(sizes)))[ends]

    def _words(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        """The distinct words, the number in them of every occurrence, and how many each text has."""
        odd = np.array([not (self.prefix and t and t[0] != " " and "  " not in t and MARK not in t) for t in texts], bool)
        try:  # each space starts a word
            plain = pa.array([t for t, x in zip(texts, odd.tolist()) if not x], pa.large_string())
        except UnicodeEncodeError:  # a lone surrogate
            odd[:], plain = True, pa.array([], pa.large_string())
        split = pa.compute.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        distinct = [MARK + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        of = coded.indices.to_numpy()
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = split.value_lengths().to_numpy()
        if odd.any():
            number = _Numbers(zip(distinct, range(len(distinct))))
            numbers: list[int] = []
            for i in np.flatnonzero(odd).tolist():
                words = _WORD.findall((MARK if self.prefix else "") + texts[i].replace(MARK, _OWN_MARK).replace(" ", MARK)) if texts[i] else [""]
                words.pop()  # the empty match at the end
                numbers += map(number.__getitem__, words)
                counts[i] = len(words)
            distinct = list(number)
            of, split_of = np.empty(int(counts.sum()), np.int32), of
            by_pattern = np.repeat(odd, counts)
            of[by_pattern], of[~by_pattern] = numbers, split_of
        return distinct, of, counts.tolist()

    def _plain(self, distinct: list[str]) -> tuple[np.ndarray, ...]:
        """The plain ids of the words, with the start and size of each word's, and their merges alike; short words are kept in the cache."""
        at = np.fromiter((self.words.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        counts = np.fromiter((len(distinct[i]) for i in new.tolist()), np.int64, len(new))
        short, long = new[counts <= _SHORT], new[counts > _SHORT]
        counts = counts[counts <= _SHORT]
        order = np.argsort(counts.astype(np.uint8), kind="stable")
        for a in range(0, len(order), _TOGETHER):
            part = short[order[a : a + _TOGETHER]]
            words = [distinct[i] for i in part.tolist()]
            ids, sizes, merges, n_merges = self._merged(words, counts[order[a : a + _TOGETHER]], np.zeros(len(words), np.uint64), 0, trace=True)
            at[part] = np.arange(self.plain.n, self.plain.n + len(part))
            self.words.update(zip(words, range(self.plain.n, self.plain.n + len(part))))
            self.plain.add(ids, sizes)
            self.merges.add(merges, n_merges)
        got: list[np.ndarray] = []
        by_heap: list[list[int]] = [[] for _ in long]
        heaped = [np.frombuffer(self.merge(distinct[i], 0, 0, by), "<i4") for i, by in zip(long.tolist(), by_heap)]
        kept = np.flatnonzero(at >= 0)
        for runs, more in ((self.plain, heaped), (self.merges, [np.array(by, np.uint64) for by in by_heap])):
            values, kept_sizes = runs.taken(at[kept])
            sizes, starts = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
            sizes[kept], sizes[long] = kept_sizes, [len(x) for x in more]
            order = np.concatenate((kept, long))
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            got += [np.concatenate((values, *more)), starts, sizes]
        return tuple(got)

    def decode(self, ids) -> str:
        """The text that was encoded, exactly."""
        text = b"".join(map(self.data.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text else text

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """decode() of each run of ids between two ends."""
        spelled = self._spellings.take(pa.array(ids))
        text = memoryview(spelled.buffers()[2] or b"")
        at = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset :][ends].tolist() if len(ids) else [0] * len(ends)
        for a, b in zip(at, at[1:]):
            t = str(text[a:b], "utf-8", "surrogatepass")
            yield t[1:] if self.prefix and t else t

    @cached_property
    def _spellings(self) -> pa.Array:
        return pa.array(self.data, pa.large_binary())


def word_keys(pairs: list[tuple[int, str]]) -> np.ndarray:
    """A key for each pair of a number and a word."""
    streams = np.fromiter((s + 2 for s, _ in pairs), np.uint64, len(pairs))
    sums = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for _, w in pairs), np.uint64, len(pairs))
    return mix_array(streams * np.uint64(0xD6E8FEB86659FD93) ^ sums)


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces.load(path)


def _document_key(seed: int, doc_id: int | None) -> int:
    return mix((seed * 0x9E3779B97F4A7C15 + ((doc_id or 0) & _MASK) * 0xA0761D6478BD642F + 1) & _MASK)


def _document_keys(seed: int, batch: pa.RecordBatch) -> list[int]:
    return [_document_key(seed, d) for d in batch.column("doc_id").to_pylist()]


def encode(df: DataFrame, model: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in in_slices(batches, "text"):
            ids, ends = pieces.encode_flat(batch.column("text").to_pylist(), _document_keys(seed, batch), rate)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            texts = [pieces.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, model: str, rate: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes it again: number and CRC-32 of the ids (little-endian, 32 bits), and whether the text came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in in_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, ends = pieces.encode_flat(texts, _document_keys(seed, batch), rate)
            upto = ends.tolist()
            columns = [
                batch.column("doc_id"),
                [len(t) for t in texts],
                np.diff(ends),
                [zlib.crc32(ids[a:b]) for a, b in zip(upto, upto[1:])],
                [back == t for back, t in zip(pieces.decode_flat(ids, ends), texts)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TRIP.types)], schema=_TRIP)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean")


_TRIP = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])
