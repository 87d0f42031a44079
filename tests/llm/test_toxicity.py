import zlib

from larkspur.llm import toxicity as tox


def _scorer():
    return tox.Scorer({"idiot": 1.0, "stupi": 1.0})


def test_clauses_are_told_apart():
    def kinds(text):
        return [{c: x for c, x in zip(tox.CLASSES, clause) if x} for clause in _scorer().clauses(text.lower())]

    assert kinds("what an idiot") == [{"plain": 1}] and kinds("you are an idiot") == [{"aimed": 1}] and kinds("not an idiot") == [{"negated": 1}]
    assert kinds("you are not an idiot") == [{"negated": 1}] and kinds("he said what an idiot") == [{"reported": 1}] and kinds("they said you idiot") == [{"reported": 1}]
    assert kinds('some wrote: "you idiot" there') == [{"reported": 1}] and kinds('a "fine" idiot') == [{"plain": 1}]
    assert kinds("I will kill you") == [{"threat": 1}] and kinds("you wait, we hurt them all") == [{"threat": 1}]
    assert kinds("never kill you") == [] and kinds("kill time") == [] and kinds("you kill time") == [] and kinds("nothing here") == []
    assert kinds("he said I will kill you") == [{"reported": 1}] and kinds("'not'. an idiot") == [{"plain": 1}]
    assert kinds("an idiot. stupidly done! fine") == [{"plain": 1}, {"plain": 1}] and kinds("idiot, you stupid") == [{"plain": 1, "aimed": 1}]
    prior = lambda t: _scorer().score(t)
    assert prior("you idiot") > prior("an idiot") > prior("he said an idiot") > prior("not an idiot") > prior("nothing")


def test_grammar_decides_where_labels_do():
    """Labels that follow from how a word is used can only be told by the grammar."""
    import random

    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice(["green", "paper", "walks", "river", "table", "slow"]) for _ in range(rng.randint(3, 12)))
    bad = ["you are an idiot", "what a stupid idiot", "such a moron, you", "stupid moron"]
    fine = ["nobody is not an idiot", "he said idiot", "it is never stupid", 'the note reads "stupid"', "they wrote moron", "no moron"]
    rows = [(f"{filler()}. {rng.choice(bad)}. {filler()}", 1) for _ in range(200)] + [(f"{filler()}. {rng.choice(fine)}. {filler()}", 0) for _ in range(200)]
    rng.shuffle(rows)
    stems = {"idiot": 1.0, "stupid": 1.0, "moron": 1.0}

    def fitted(grammar):
        s = tox.Scorer(stems, grammar=grammar)
        return tox.Scorer(stems, tox.fit_curve(tox.np.array([s.features(t) for t, _ in rows[:200]]), tox.np.array([y for _, y in rows[:200]], float)), grammar)

    on, off = fitted(True), fitted(False)
    right = lambda s: sum((s.score(t) >= 0.5) == y for t, y in rows[200:])
    differ = sum((on.score(t) >= 0.5) != (off.score(t) >= 0.5) for t, _ in rows[200:])
    print("right with grammar", right(on), "without", right(off), "decisions that differ", differ, "of 200")
    assert right(on) >= 195 and right(off) <= 160 and differ >= 40


def test_ties_and_one_class():
    assert tox.train(["a b", "c"], [1, 1]).stems == {} and tox.train([], []).curve == tox.PRIOR
    bad = ["zzaa yybb " + " ".join(f"{c}{d * 4}" for d in "ijklmnopqrs") for c in "abcdefgh"]
    stems = tox.learn_stems(bad, ["fine words here"] * 30)
    assert stems and stems == tox.learn_stems(bad[::-1], ["fine words here"] * 30)


def test_learning_finds_words_and_stems():
    import random

    rng = random.Random(4)
    parts = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "il", "o", "ur")]
    text = lambda *extra: " ".join(["".join(rng.sample(parts, 3)) for _ in range(60)] + list(extra)) + "."
    bad = [text("jerkface", "vequ" + rng.choice("abcde") * 2) for _ in range(40)]
    good = [text() for _ in range(200)]
    scorer = tox.train(bad + good, [1] * 40 + [0] * 200)
    assert scorer.score("xx vequzzz yy.") >= 0.3 and scorer.score("a jerkface") >= 0.3 and scorer.score("") < 0.3
    assert sum(scorer.score(text()) >= 0.3 for _ in range(100)) == 0


def test_frames(spark, docs):
    rows = [(1, None), (2, ""), (2, "an idiot"), (None, "an idiot"), (3, "x " * 40_000 + "idiot")]
    found = tox.score(docs(*rows), _scorer()).collect()
    assert len(found) == 5 and {r.doc_id for r in found if r.score >= 0.3} == {2, None, 3}
    kept = tox.reject(docs(*rows), _scorer())
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs().columns
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    out = tox.classify(docs(*rows), labels).collect()
    assert len(out) == 5 and all(r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: r.held_out for r in out} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    assert tox.classify(docs(), labels).count() == 0


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = tox.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught / sum(r.toxic for r in rows) > 0.8 and caught / sum(r.predicted for r in rows) > 0.85
