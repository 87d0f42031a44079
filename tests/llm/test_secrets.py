import hashlib
import re

from larkspur.llm import secrets

PATTERNS = {
    "assign": (r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
HARD = [
    "é password: token=abcdef and Secret='x.y-z_1'",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA",
    "0" * 23 + " " + "af" * 12 + "G" + "c" * 24,
    "paſſword=abcdefgh toKen=abcdefgh API_KEY = \"abc.def\"",
    "日本" * 50 + "apikey=1234567",
    None,
    "",
]


def _base(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, (p, fits)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)), found


def test_base_against_plain_patterns(spark, docs, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + [(10_000 + i, t) for i, t in enumerate(HARD)]
    got = {r.doc_id: r for r in secrets.scan(docs(*rows)).collect()}
    for i, t in rows:
        spelled, found = _base(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[3] == k for f in found) for k in PATTERNS)
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("markov")) == spelled
    assert secrets.scan(docs()).count() == 0


def test_models_part_random_strings_from_names(sample):
    import random

    scorer = secrets.train([r.text or "" for r in sample.limit(100).collect()])
    rng = random.Random(3)
    strings = ["".join(rng.choices(a, k=32)) for a in secrets._ALPHABETS for _ in range(50)]
    names = ["getUserAccountManagerFactory", "very_long_identifier_name_here", "2024-05-06-2024-11-12-log", "the/quick/brown/fox/jumps", "-" * 40, "=" * 30]
    assert sum(scorer.ratio(s) > scorer.per_char for s in strings) >= 0.95 * len(strings)
    assert not any(scorer.ratio(n) > scorer.per_char for n in names)
    spans = secrets.spans_of("key wJalrXUtnFEMIK7MDENGbPxRfiCYzzEXAMPLEKEY and password=wJalrXUtnFEMIK7MDENGbPxRfiCY", scorer)
    assert [s[:3] for s in spans] == [("markov", 4, 44), ("assign", 49, 86)]


def test_redaction(spark, docs):
    scorer = secrets.train([])
    rows = [(1, "a password=abcdef b"), (2, None), (3, "clean"), (4, "token=" + "ab12" * 8)]
    out = secrets.redact(docs(*rows), scorer)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [SECRET] b", 2: None, 3: "clean", 4: "[SECRET]"} and out.columns == docs().columns


def test_counts_cover_all_documents(spark, sample):
    """Training in tasks gives what training on all texts at once gives."""
    texts = [r.text or "" for r in sample.collect()]
    frame = sample.repartition(3)
    one, many = secrets.train(texts), secrets.fit(frame)
    assert (one.ordinary == many.ordinary).all() and (one.random == many.random).all() and one.per_char == many.per_char
    counted = secrets.Labelled()
    counted.add(texts)
    plain = 0
    for t in texts:
        left = secrets.redacted(t, secrets.base_spans(t), "\n")
        plain += sum(map(len, re.findall(r"[A-Za-z0-9+/_=-]+", left)))
    assert counted.counts[0].sum() == plain


def test_held_out_secrets_and_names(spark):
    """Models of one table on the labelled strings of another: found secrets, ordinary runs, and names joined from them."""
    import numpy as np

    read = lambda sf: [r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    scorer, other = secrets.train(read("sf0.01")), secrets.Labelled(20_000)
    ten = read("sf0.1")
    other.add(ten)
    found = [v for t in ten for v in secrets.values(t, secrets.base_spans(t)) if len(v) >= 20]
    words = [w for w in other.strings[0] if w.isalpha()]
    rng = np.random.default_rng(3)
    names = ["_".join(rng.choice(words, 3)) for _ in range(2000)] + ["".join(x.title() for x in rng.choice(words, 3)) for _ in range(2000)] + [f"{rng.choice(words)}-{rng.choice(words)}{n}" for n in rng.integers(0, 10_000, 2000)]
    over = lambda strings: sum(scorer.ratio(s) > scorer.per_char for s in strings) / len(strings)
    print("secrets", over(found), len(found), "ordinary", over(list(other.strings[0])), "names", over(names), "bound", scorer.per_char)
    assert over(found) >= 0.95 and over(list(other.strings[0])) <= 0.001 and over(names) <= 0.002


def test_models_find_what_no_pattern_does(spark, docs):
    """Null ids, repeated rows, and a secret at the end of a very long text."""
    scorer = secrets.train(["plain words of a text"] * 50)
    key = "Zk9vQ2xT7bWm4LrX8sYp1NdJ6hGf3KcU"
    text = "word " * 200_000 + key
    rows = [(None, text), (1, text), (1, text), (2, "plain words")]
    got = secrets.scan(docs(*rows), scorer).collect()
    assert sorted((r.doc_id is not None, r.spans) for r in got) == sorted([(False, f"markov:1000000:{1000000 + len(key)}")] + [(True, f"markov:1000000:{1000000 + len(key)}")] * 2 + [(True, "")])


def test_bound_follows_from_all_strings(spark, docs):
    """8,000 ordinary runs, of which 40 look random: the bound is the first step that at most 8 of them reach."""
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    walks = [[rng.randrange(26)] + rng.choices((1, 2), k=23) for _ in range(7960)]
    runs = ["".join(letters[sum(w[: i + 1]) % 26] for i in range(24)) for w in walks] + ["".join(rng.choices(letters, k=24)) for _ in range(40)]
    rng.shuffle(runs)
    rows = [(i, " ".join(runs[40 * i : 40 * i + 40])) for i in range(200)]
    scorer = secrets.fit(docs(*rows))
    reach = lambda bound: sum(scorer.ratio(r) >= bound for r in runs)
    assert reach(scorer.per_char) <= 8 < reach(scorer.per_char - 1 / 4096)
    assert scorer.per_char == secrets.train([t for _, t in reversed(rows)]).per_char


def test_every_secret_is_counted(spark, docs):
    rows = [(i, f"password={'abcdefgh'[i % 8] * 7}{i:05d}") for i in range(400)]
    held = secrets.Labelled()
    held.add([t for _, t in rows])
    assert held.counts[1:].sum() == 400 * 12 and held.counts[1].sum() and held.counts[2].sum()
