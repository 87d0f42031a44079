import hashlib

import pytest

from larkspur.llm import fingerprints as fp


def test_chunks_cover_the_text_within_bounds():
    how, text = fp.Chunking(), ("Some words and 日本 more, " * 400).encode()
    ends = fp.boundaries(text, how, how.gear())
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and all(how.smallest <= s <= how.largest for s in sizes[:-1]) and fp.boundaries(b"", how, how.gear()) == []


def test_an_insertion_moves_few_chunks():
    import random

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(2000))
    a, b = (fp.parse(fp.fingerprint_text(t)) for t in (text, text[:5000] + "something new " + text[5000:]))
    assert fp.likeness(a, b) > 0.95 and fp.likeness(a, a) == 1.0
    other = fp.parse(fp.fingerprint_text(text[::-1]))
    assert fp.likeness(a, other) < 0.05 and fp.likeness({}, {}) == 1.0 and fp.likeness(a, {}) == 0.0


def _expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = fp.edited_text(t, following)
        own, new = (fp.parse(fp.fingerprint_text(x)) for x in (t, edited))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint_text(t), fp.fingerprint_text(edited), fp.likeness(own, new), fp.likeness(own, fp.parse(fp.fingerprint_text(following)))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[], [(5, "alone in here")], [(1, None), (2, ""), (3, "abc def"), (3, "abc"), (3, "abc"), (None, "null id"), (9, "é" * 70_000), (7, "x")]])
def test_small_tables(spark, docs, rows):
    got = fp.fingerprint_with_neighbours(docs(*rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _expected(rows)


def test_against_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(map(tuple, fp.fingerprint_with_neighbours(sample).collect()), key=repr) == _expected(rows)
    assert {r.doc_id: r.fingerprint for r in fp.fingerprint(sample).collect()} == {i: fp.fingerprint_text(t or "") for i, t in rows}
