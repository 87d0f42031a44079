import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from larkspur.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b", " lead", "trail ", "a\n b", "x \n y", "tab\t z", "nb  sp", "it's  we'll", "  em", "a\x1c b <|endoftext|> c", "日本 語🙂 é", "\u0085 x \u0085"]


def _ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*x.ids, 1] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers(sample):
    texts = ODD + [r.text for r in sample.collect()]
    got = packing.loaded(FILE).encode(pa.array(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x[:-1] for x in _ids(texts)]


def test_ids_of_odd_mixtures_are_the_tokenizers():
    draw = random.Random(3)
    parts = ["a", "B", "é", "日", "9", "'s", "'", "\n", "\t", " ", "  ", " ", "\x1c", "\x85", "\u2003", "!", "<|endoftext|>", "🙂", " the"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(5000)]
    got = packing.loaded(FILE).encode(pa.array(["left out", *texts]).slice(1))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x[:-1] for x in _ids(texts)]
    assert packing.loaded(FILE).encode(pa.array([], pa.string())) == []


def _check(rows, pieces, window=packing.WINDOW):
    """Every id lies in one piece; offsets of a sequence are gapless."""
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, _ids([t for _, t in rows])))
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    assert sum(p.length for p in pieces) == sum(x[2] for x in want)
    whole = sorted((p.doc_id is not None, p.doc_id or 0, p.doc_tokens, p.ids_crc32) for p in pieces if p.length == p.doc_tokens)
    assert all(x in want for x in whole)
    return by_sequence


def test_small_tables(spark, docs):
    rows = [(1, "one two"), (1, "one two"), (2, None), (None, "x"), (None, None), (3, "word " * 9000)]
    _check(rows, packing.pack(docs(*rows), FILE).collect())
    assert packing.pack(docs(), FILE).count() == 0


def test_pieces_of_the_sample(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    pieces = packing.pack(sample, FILE, shard_tokens=1 << 16).collect()
    sequences = _check(rows, pieces)
    ids = dict(zip([i for i, _ in rows], _ids([t for _, t in rows])))
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for i in ids:
        parts = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert [a for a, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) == len(ids[i])
    assert sum(len(x) for x in ids.values()) / (2048 * len(sequences)) > 0.9


def test_statistics_count_all(spark, sample):
    stats = packing.statistics(packing.tokenise(sample, FILE))
    ids = _ids([r.text for r in sample.collect()])
    want = np.bincount([t for x in ids for t in set(x)], minlength=1 << 16)
    assert stats.documents == len(ids) and (stats.frequency == want).all() and np.isclose(stats.mean_length, np.mean([len(x) for x in ids]))


def _bm25(documents, stats):
    """Scores of all documents (columns) for all documents as queries (rows), term by term."""
    scores = np.zeros((len(documents), len(documents)))
    terms = [dict(zip(*map(np.ndarray.tolist, np.unique(d, return_counts=True)))) for d in documents]
    holders: dict = {}
    for i, found in enumerate(terms):
        for t, n in found.items():
            idf = np.log(1 + (stats.documents - stats.frequency[t] + 0.5) / (stats.frequency[t] + 0.5))
            holders.setdefault(t, []).append((i, idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(documents[i]) / stats.mean_length))))
    for met in holders.values():
        at = np.array([i for i, _ in met])
        scores[np.ix_(at, at)] += np.array([w for _, w in met])
    return scores


def test_index_is_bm25(sample):
    documents = [np.array(x, np.uint16) for x in _ids([r.text for r in sample.collect()])]
    stats = packing.Statistics(len(documents), float(np.mean([len(d) for d in documents])), np.bincount([t for d in documents for t in set(d.tolist())], minlength=1 << 16))
    want, index, used = _bm25(documents, stats), packing.Index(documents, stats), np.zeros(len(documents), bool)
    used[::7] = True
    for seed in range(len(documents)):
        got = index.neighbours(seed, used)
        assert set(got.tolist()) == set(np.flatnonzero((want[seed] > 0) & ~used).tolist())
        assert (np.diff(want[seed][got]) <= 1e-9).all()


def test_related_documents_share_a_shard(spark):
    """Against one index of all documents: neighbours that share most of their impact meet in a shard, also where shards are many.

    The plain best neighbour of most documents is one of a few very long ones, which only one window can hold.
    """
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenised = packing.materialise(packing.tokenise(frame, FILE), "packing-test")
    stats = packing.statistics(tokenised)
    keyed = packing.materialise(packing.drawn(tokenised, stats), "packing-test")
    shares = []
    for shard_tokens in (1 << 17, 1 << 15):
        rows = packing.dealt(keyed, shard_tokens).select("doc_id", "ids", "n", "shard").collect()
        rows.sort(key=lambda r: r.doc_id)
        sizes: dict = {}
        for r in rows:
            sizes[r.shard] = sizes.get(r.shard, 0) + r.n
        assert max(sizes.values()) <= 2 * shard_tokens + max(r.n for r in rows)
        scores = _bm25([np.frombuffer(r.ids, "<u2") for r in rows], stats)
        own = scores.diagonal().copy()
        np.fill_diagonal(scores, 0)
        best = scores.argmax(axis=1)
        same = np.array([rows[i].shard == rows[j].shard for i, j in enumerate(best)])
        both = np.minimum(scores / own[:, None], scores.T / own[None, :])
        mate = both.argmax(axis=1)
        near = both[np.arange(len(rows)), mate] >= 0.6
        met = np.array([rows[i].shard == rows[j].shard for i, j in enumerate(mate)])[near].mean()
        by_chance = sum((n / sum(sizes.values())) ** 2 for n in sizes.values())
        print(len(sizes), "shards; best neighbour in the same one:", same.mean(), "near ones", met, near.sum(), "by chance", by_chance)
        shares.append(met)
        assert same.mean() > 3 * by_chance
    assert shares[0] >= 0.6 and shares[1] >= 0.5


def test_large_terms_are_split(spark, docs):
    rows = [(1, "same words here")] * 300 + [(i, f"same words here {i}") for i in range(300)] + [(None, None)] * 200
    tokenised = packing.materialise(packing.tokenise(docs(*rows), FILE), "packing-test")
    keyed = packing.materialise(packing.drawn(tokenised, packing.statistics(tokenised)), "packing-test")
    shards = packing.dealt(keyed, 200).groupBy("shard").sum("n").collect()
    assert max(r[1] for r in shards) < 1000 and sum(r[1] for r in shards) == tokenised.agg({"n": "sum"}).first()[0]
    _check(rows, packing.pack(docs(*rows), FILE, shard_tokens=200).collect())


def test_neighbours_fill_the_window():
    topics = [np.array([100 + t] * 30 + [200 + t] * 30 + [1], np.uint16) for t in (0, 1, 0, 1, 0)]
    frequency = np.bincount([t for d in topics for t in set(d.tolist())], minlength=1 << 16)
    stats = packing.Statistics(50, 61, frequency)
    order = [p[0] for p in packing.pack_shard(topics, stats, 122)]
    assert order == [0, 2, 4, 1, 3]
    # how many neighbours are looked up at a time changes nothing
    assert packing.pack_shard(topics, stats, 200, few=1) == packing.pack_shard(topics, stats, 200)
