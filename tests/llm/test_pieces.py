import random
import sys

import public_tokenizers
import pytest
import sentencepiece

from larkspur.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  Hello   world\n\nx ", "a", " ", "日本語 テキスト🙂🙂", "\t\ttab", "x" * 3000, "Hello</s><s> <0x41>", "trailing  "]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(PATH)


def test_without_dropout_it_is_the_model(model, sample):
    texts = ODD + [r.text for r in sample.limit(60).collect()]
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [x.tolist() for x in model.encode(texts)] == [plain.encode(t) for t in texts]


def test_dropout_varies_by_key_and_decodes(model):
    text = " ".join(["international communication"] * 300)
    a, b, again = (model.encode([text], [k], 0.2)[0].tolist() for k in (1, 2, 1))
    assert a == again and a != b and len(a) > len(model.encode([text])[0])
    for t in [*ODD, "▁ own mark ▁▁x"]:
        assert model.decode(model.encode([t], [3], 0.3)[0]) == t
    assert model.encode([text], [1], 1.0)[0].tolist() != a


def test_two_merges_agree(model):
    pairs = [(i % 3, w) for i, w in enumerate(["▁hello", "▁internationalisation", "a", "▁日本🙂", "▁" * 7, "x" * 40])]
    keys = pieces.word_keys(pairs)
    for threshold in (0, 1 << 30, 1 << 32):
        assert model.merge_many([w for _, w in pairs], keys, threshold) == [model.merge(w, int(k), threshold) for (_, w), k in zip(pairs, keys)]


def test_frames(spark, docs):
    rows = [(1, "some text here"), (1, "some text here"), (2, None), (None, "x y"), (3, "z" * 50_000)]
    got = pieces.round_trip(docs(*rows), PATH).collect()
    assert all(r.lossless for r in got) and sorted(r.n_chars for r in got) == [0, 3, 14, 14, 50_000]
    assert len({(r.n_pieces, r.ids_crc32) for r in got if r.doc_id == 1}) == 1
    encoded = pieces.encode(docs(*rows), PATH)
    assert sorted(r.text for r in pieces.decode(encoded, PATH).collect()) == sorted(t or "" for _, t in rows)
    assert pieces.round_trip(docs(), PATH).count() == 0


def test_every_occurrence_is_cut_for_itself(model):
    word, n = "▁internationalisation", 3000
    keys = [pieces._document_key(seed, 5) for seed in (1, 2)]
    cut = []
    for key in keys:
        places = pieces.mix_array(pieces.np.uint64(key) ^ (pieces.np.arange(n, dtype=pieces.np.uint64) + pieces.np.uint64(1)) * pieces.np.uint64(pieces._ODD))
        want = [model.merge(word, int(k), int(0.2 * (1 << 32))) for k in places]
        got = model.encode([" ".join([word[1:]] * n)], [key], 0.2)[0].tobytes()
        assert got == b"".join(want)
        cut.append(set(want))
    assert len(cut[0]) > 8 and cut[0] - cut[1] and cut[1] - cut[0]


def test_words_are_cut_alike_either_way(model):
    """Texts cut by split have the ids that the pattern's words give."""
    texts = ["a b c", "a b ", "a\n b\tc", "one", "é 日本 x" * 20, "a ▁b c", " lead", "two  gaps", " ", "  ", ""]
    keys = list(range(len(texts)))
    got = model.encode(texts, keys, 0.3)

    class Marked(str):
        def __contains__(self, part):
            return part == "  " or str.__contains__(self, part)

        def replace(self, *how):
            return Marked(str.replace(self, *how))

    by_pattern = model.encode([Marked(t) for t in texts], keys, 0.3)
    assert [x.tolist() for x in got] == [x.tolist() for x in by_pattern]
    assert [model.decode(x) for x in got] == texts


def test_no_call_an_occurrence(model):
    """Occurrences are looked up, cut and joined as arrays: what is called doesn't grow with their number."""

    def calls(n: int) -> int:
        text, seen = " ".join(["international communication without borders"] * n), []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            model.encode([text], [1], 0.3)
        finally:
            sys.setprofile(None)
        return len(seen)

    calls(1)
    assert calls(20_000) - calls(1_000) < 19_000  # 76,000 occurrences more


def test_arrays_agree_with_the_heap(model):
    """Words of plain and other texts side by side, with a cache that is dropped, and characters that are no piece."""
    r = random.Random(5)
    parts = ["a", "b ", " ", "the ", "▁", "ing ", "é", "🙂", "\0", "日", "x" * 49, "un", "\n"]
    texts = ["", " ", "\ud812 x", "a\0 \0\0 b\0", *("".join(r.choices(parts, k=r.randrange(40))) for _ in range(300))]
    keys, threshold = [r.randrange(1 << 64) for _ in texts], int(0.3 * (1 << 32))
    for part in (slice(None), slice(0, 2), slice(40, 90)):
        want = []
        for text, key in zip(texts[part], keys[part]):
            words = pieces._WORD.findall("▁" + text.replace("▁", "\ud800").replace(" ", "▁"))[:-1] if text else []
            places = pieces.mix_array(pieces.np.uint64(key) ^ (pieces.np.arange(len(words), dtype=pieces.np.uint64) + pieces.np.uint64(1)) * pieces.np.uint64(pieces._ODD))
            want.append(b"".join(model.merge(w, int(k), threshold) for w, k in zip(words, places)))
        got = model.encode(texts[part], keys[part], 0.3, cache=50)
        assert [x.tobytes() for x in got] == want
        ids, ends = model.encode_flat(texts[part], keys[part], 0.3)
        assert ids.tobytes() == b"".join(want) and list(model.decode_flat(ids, ends)) == texts[part] == [model.decode(x) for x in got]
