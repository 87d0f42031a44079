import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import components, copies, simhash


def _fingerprint(text, words=4):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, radius=4):
    prints = [_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    groups: dict = {}
    for (i, _), c in zip(rows, label):
        groups.setdefault(c, []).append(i)
    least = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    return sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label)), key=repr)


def _got(frame, **how):
    found = simhash.near_duplicates(frame, **how).select("doc_id", simhash.spelled(simhash.F.col("fp")).alias("f"), "component_id")
    return sorted(map(tuple, found.collect()), key=repr)


def test_small_tables(spark, docs):
    rows = [(7, None), (3, ""), (5, " \t\n"), (9, "one"), (2, "ONE"), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "no id at all here"), (8, "Éa\x0bb c   d"), (6, "w " * 30_000)]
    assert _got(docs(*rows)) == _components(rows)
    assert simhash.near_duplicates(docs()).count() == 0


def test_against_brute_force(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert _got(sample) == _components(rows)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_forest_finds_all_links(seed, radius):
    rng = np.random.default_rng(seed)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for i in range(60, 200):
        x = prints[i % 20]
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= np.uint64(1) << np.uint64(b)
        prints[i] = x
    keys = rng.integers(0, 3, 200)
    found = {(int(b), int(a)) for x, y in simhash.BKForest(keys, prints).links(radius, 64) for a, b in zip(x, y)}
    assert found == {(j, i) for i in range(200) for j in range(i) if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (50, 98), (7, 7), (200, 150), (150, 200)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and found[100] == found[99] == found[98] == 50 and found[200] == 150
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=1)


def _kept(rows, similarity=0.8, words=5):
    """Ids that stay by exact similarities, and the pairs near enough to the bound for the estimate to differ."""
    sets = [set(simhash.shingle_hashes(t or "", words).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    close = 0
    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            s = len(sets[i] & sets[j]) / either if either else 1.0
            close += abs(s - similarity) < 0.06
            if s >= similarity and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}, close


def test_near_copies(spark, docs, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want, close = _kept(rows)
    got = {r.doc_id for r in copies.drop_copies(sample).collect()}
    assert len(want ^ got) <= close and copies.drop_copies(sample).columns == sample.columns
    words = [f"w{i}" for i in range(100)]
    near, far = words[:98] + ["x", "y"], words[:60] + [f"z{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, " "), (6, "SAME words"), (6, "SAME words"), (0, "same  Words"), (None, "same words"), (None, "same words"), (9, "four words are here")]
    kept = sorted(((r.doc_id, r.text) for r in copies.drop_copies(docs(*rows)).collect()), key=repr)
    assert kept == sorted([(1, " ".join(words)), (3, " ".join(far)), (4, None), (0, "same  Words"), (None, "same words"), (None, "same words"), (9, "four words are here")], key=repr)
    assert copies.drop_copies(docs()).count() == 0


def test_repeated_lines_hide_no_copy(spark, docs):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        line = [f"l{x}" for x in rng.integers(0, 10**6, 8)]
        rows += [(2 * i, " ".join(words + line)), (2 * i + 1, " ".join(words + line * 150))]
    want, close = _kept(rows)
    assert close == 0 and want == {2 * i for i in range(40)}
    assert {r.doc_id for r in copies.drop_copies(docs(*rows)).collect()} == want


def test_radius_holds_copies():
    rng = np.random.default_rng(4)
    for size in (4, 12, 80, 800):
        radius, far = copies.radius_of(0.8), 0
        for _ in range(1000):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, size // 4, dtype=np.uint64) * np.uint64(2)
            left, right = (np.concatenate((both, x)) for x in (own[: len(own) // 2], own[len(own) // 2 :]))
            far += (simhash.majority(left) ^ simhash.majority(right)).bit_count() > radius
        assert far == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "zz")
    rows = [(6, a), (6, b), (7, b), (8, a), (8, a), (6, near), (9, "own text"), (9, "own text"), (9, "other text"), (None, a)]
    got = sorted(((r.doc_id, r.text) for r in copies.drop_copies(docs(*rows)).collect()), key=repr)
    stays = min((a, near), key=copies.content_of)
    assert got == sorted([(6, stays), (6, b), (9, "own text"), (9, "other text"), (None, a)], key=repr)


@pytest.mark.parametrize("most", [2048, 16])
def test_large_shards_lose_no_link(spark, docs, most):
    """A large group of near copies, a chain, and documents that share a passage only; with small and large shards alike."""
    rng = np.random.default_rng(8)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    base, passage = own(200), own(60)
    texts = []
    for _ in range(120):
        words = list(base)
        words[int(rng.integers(0, 200))] = own(1)[0]
        texts.append(words)
    chain = own(300)
    for i in range(30):
        texts.append(chain[4 * i :] + [f"c{j}" for j in range(4 * i)])
    texts += [own(40) + passage + own(40) for _ in range(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want, _ = _kept(rows)
    got = {r.doc_id for r in copies.drop_copies(docs(*rows), most=most).collect()}
    assert got == want


def test_copies_that_share_all_shards_are_found(spark, docs):
    """Texts of equal shingle sets have equal members in all of their shards, of which one is kept."""
    rng = np.random.default_rng(9)
    line = [f"w{x}" for x in rng.integers(0, 10**7, 30)]
    rows = [(i, " ".join(line * (2 + i))) for i in range(40)] + [(99, "another text of six words")]
    assert {r.doc_id for r in copies.drop_copies(docs(*rows), most=16).collect()} == {0, 99}


def test_a_large_shard_loses_no_pair(spark, docs):
    """Members that have no second shard in common, groups of near copies among texts that share a passage."""
    rng = np.random.default_rng(10)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    passage, texts = own(30), []
    for _ in range(30):
        words = own(70)
        texts += [words + passage, words[:-2] + own(2) + passage] + [own(70) + passage]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    heads = copies.described(docs(*rows)).withColumnRenamed("doc_id", "node").cache()
    names = heads.select("node", copies.F.array(copies.F.lit(7).cast("long")).alias("shards"))
    found = components.connected_components(copies.links(names, heads, most=16)).collect()
    label = {r.node: r.component for r in found}
    want, _ = _kept(rows)
    assert len(want) == 60 and {label.get(i, i) for i, _ in rows} == want


def _tasks(spark, run):
    """How many tasks ran; the driver keeps account of each."""
    sc, group = spark.sparkContext, f"tasks-{time.time()}"
    sc.setJobGroup(group, group)
    try:
        run()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


@pytest.fixture
def dealt_wide(spark):
    """Shuffles of 64 partitions, which Spark doesn't coalesce."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_take_few_shuffles(spark, dealt_wide):
    star = spark.createDataFrame([(i, i % 7) for i in range(7, 500)], "src long, dst long")
    assert _tasks(spark, lambda: components.connected_components(star)) <= 64 * 4
    chain = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(50)] + [(i, 200) for i in range(0, 100, 2)], "src long, dst long")
    found = []
    assert _tasks(spark, lambda: found.append(components.connected_components(chain))) <= 64 * 22
    assert {r.component for r in found[0].collect()} == {0}
    assert components.connected_components(star.where("false")).count() == 0


def test_large_shards_take_few_shuffles(spark, docs, dealt_wide):
    """Large shards that are not one group: all steps run."""
    rng = np.random.default_rng(10)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    passage, texts = own(60), []
    for _ in range(30):
        words = own(40)
        texts += [words + passage, words[:-2] + own(2) + passage, own(40) + passage]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = []
    tasks = _tasks(spark, lambda: got.append(copies.drop_copies(docs(*rows), most=16)))
    assert {r.doc_id for r in got[0].collect()} == _kept(rows)[0]
    assert tasks <= 64 * 30


def test_prefixes_hold_what_similar_sets_share(spark, docs):
    """In order of rarity: hashes that all sets have come last, and those of a set beyond its share are left out."""
    rng = np.random.default_rng(12)
    both = rng.integers(0, 1 << 32, 20, dtype=np.uint64)
    sets = [np.unique(np.concatenate((both, rng.integers(0, 1 << 32, 80, dtype=np.uint64)))) for _ in range(30)]
    sets += [np.unique(np.append(s[1:], rng.integers(0, 1 << 32, 1, dtype=np.uint64))) for s in sets] + [np.empty(0, np.uint64)]
    heads = spark.createDataFrame([(i, s.astype("<u4").tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    open_ = spark.createDataFrame([(i, i % 3) for i in range(len(sets) - 1)], "node long, component long")
    found = [tuple(r) for r in copies._prefixes(open_, heads, 0.8).collect()]
    held = {}
    for shard, node, component in found:
        held.setdefault(node, set()).add(shard)
        assert component == node % 3 and shard in sets[node]
    assert all(len(h) <= len(sets[i]) + 1 - np.ceil(0.8 * len(sets[i])) and not h & set(both.tolist()) for i, h in held.items())
    assert sorted(held) == list(range(60)) and all(held[i] & held[i + 30] for i in range(30))


def test_recall_on_a_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    table = [(r.doc_id, r.text) for r in rows.collect()]
    want, _ = _kept_fast(table)
    got = {r.doc_id for r in copies.drop_copies(rows).collect()}
    dropped = {i for i, _ in table} - want
    assert len(dropped - got) >= 0.99 * len(dropped) and not want - got


def _kept_fast(rows, similarity=0.8, words=5):
    """As _kept, with sorted arrays."""
    sets = [np.unique(simhash.shingle_hashes(t or "", words)) for _, t in rows]
    known = {}
    names = [known.setdefault(s.tobytes(), len(known)) for s in sets]
    distinct = [np.frombuffer(x, np.uint64) for x in known]
    every, at = np.unique(np.concatenate(distinct), return_inverse=True)
    owner = np.repeat(np.arange(len(distinct)), [len(s) for s in distinct])
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(every) + 1))
    sizes = np.array([len(s) for s in distinct])
    places = np.split(at, np.cumsum(sizes)[:-1])
    label = np.arange(len(distinct))
    for i, mine in enumerate(places):
        met = np.concatenate([owner[order[cuts[x] : cuts[x + 1]]] for x in mine.tolist()]) if len(mine) else np.empty(0, int)
        both = np.bincount(met, minlength=len(distinct))
        for j in np.flatnonzero(both >= similarity * (sizes[i] + sizes - both)).tolist():
            if label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    least = {}
    for (i, _), n in zip(rows, names):
        least[label[n]] = min(i, least.get(label[n], i))
    return set(least.values()), label
