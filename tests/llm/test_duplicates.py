"""Near duplicates of texts and vectors against comparing every pair."""

import itertools
import random
import re

import numpy as np
import pytest

from gridsmith.llm import hamming, jaccard
from gridsmith.llm.components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = dict.fromkeys(ids, 0)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}, degree


def near_texts(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(draw.choices(words, k=55))
    originals = [draw.choices(words, k=draw.choice((1, 3, 5, 8, 40, 120))) for _ in range(n // 4)]
    texts = []
    for _ in range(n):
        text = list(draw.choice(originals))
        for _ in range(draw.choice((0, 0, 1, 2, 4))):
            text[draw.randrange(len(text))] = draw.choice(words).upper()
        texts.append(" ".join(text) + (" " + passage if draw.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize("full, tile", [(32, 512), (3, 8)])
def test_jaccard_against_all_pairs(spark, monkeypatch, full, tile):
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c d e", "A b c", *near_texts(5, 220)]
    # The product runs in workers, which see the module's own constants; only the plan changes here.
    docs = spark.createDataFrame([(i * 3, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(5)
    sets = {i * 3: shingles(t) for i, t in enumerate(texts)}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root, degree = classes(list(sets), linked)
    rows = jaccard.similar_documents(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows} == {(i, len(s), root[i], degree[i]) for i, s in sets.items()}


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (9, "x " * 50_000)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(docs).collect()), key=str)
    # Repeated rows of one id count as a copy of each other.
    assert rows == [(4, 1, 4, 1), (4, 1, 4, 1), (9, 1, 9, 0), (None, 1, None, 0)]
    assert jaccard.similar_documents(docs.limit(0)).count() == 0


def test_a_common_passage_makes_no_family(spark, monkeypatch):
    """A passage of many texts that are no copies must not bring them together as one family."""
    draw = random.Random(8)
    fresh = lambda n: [f"v{draw.randrange(10**9)}" for _ in range(n)]
    passage = fresh(50)
    texts = [fresh(200 + i % 60) + passage + fresh(200) for i in range(60)]
    texts += [[*texts[7][:-1], "other"], [*texts[8][:-1], "other"]]
    edges = []
    real = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda e: (edges.append({(r.a, r.b) for r in e.collect()}), real(e))[1])
    # As on a large table, where not all common n-grams are found.
    monkeypatch.setattr(jaccard, "common_grams", lambda docs, text: np.zeros(0, np.uint64))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.similar_documents(docs).collect()}
    assert rows == {i: ({60: 7, 61: 8}.get(i, i), int(i in (7, 8, 60, 61))) for i in range(62)}
    assert {tuple(sorted(e)) for e in edges[0]} == {(7, 60), (8, 61)}


def test_packed_numbers():
    for values in ([0], [-(2**63), 2**63 - 1, 0], [7, 7], list(range(1000, 70_000, 3)), [2**40, 2**40 + 255]):
        values = np.array(values, np.int64)
        assert (jaccard._unpacked(jaccard._packed(values), len(values)) == values).all()
    assert len(jaccard._packed(np.arange(10**12, 10**12 + 200))) == 208


@pytest.mark.parametrize("bits", [1 << 25, 1 << 12])
def test_keys_that_are_surely_elsewhere(spark, monkeypatch, bits):
    from gridsmith.llm import common
    from gridsmith.session import cut_lineage

    monkeypatch.setattr(common, "BITS", bits)
    keys = cut_lineage(spark.range(0, 30_000, 30).withColumnRenamed("id", "doc_id"))
    df = spark.range(-10_000, 30_000).selectExpr("if(id = -1, null, id) AS doc_id", "id AS row")
    known = common.with_maybe(df, "doc_id", keys)
    rows = known.collect()
    assert known.columns == ["doc_id", "row", "maybe"] and sorted(r.row for r in rows) == list(range(-10_000, 30_000))
    assert all(r.maybe for r in rows if r.doc_id is not None and r.doc_id >= 0 and r.doc_id % 30 == 0)
    assert sum(r.maybe for r in rows) < (6000 if bits > 1 << 20 else 12_000)
    # No row of the large side is shuffled, and no key is a sound table.
    assert "SortMergeJoin" not in known._jdf.queryExecution().executedPlan().toString()
    assert not any(r.maybe for r in common.with_maybe(df, "doc_id", cut_lineage(keys.limit(0))).collect())


def test_overlaps():
    rows = [np.array(sorted(random.Random(i).sample(range(50), 12))) for i in range(9)]
    shared = jaccard.overlaps(rows)
    assert all(shared[i, j] == len(set(rows[i]) & set(rows[j])) for i in range(9) for j in range(9) if i != j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 50: 50, 200: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_join_each_edge_a_few_times(spark, monkeypatch):
    """Rounds after the first meet the edges between trees only, on long paths with numbers in any order too."""
    from gridsmith.llm import components as module

    draw = random.Random(4)
    edges = []
    for k in range(40):  # paths, their nodes in an order of chance
        path = draw.sample(range(1000 * k, 1000 * k + 60), 60)
        edges += list(zip(path, path[1:]))
    edges += [(5_000_000, i) for i in range(4_000_000, 4_000_300)] + [(6_000_000, 6_000_000), (None, 7_000_000)]
    sizes = []
    real = module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (out := real(df), sizes.append(out.count() if out.columns == ["a", "b"] else 0))[0])
    found = {r.node: r.root for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root, _ = classes({n for e in edges[:-1] for n in e}, edges[:-2])
    assert found == root
    rounds = [n for n in sizes if n]
    assert sum(rounds) < 2 * rounds[0] and len(rounds) <= 6


def cosine_links(rows):
    for a, b in itertools.combinations(rows, 2):
        if a[2] is None or a[2] != b[2]:
            continue
        vectors = []
        for v in (a[1], b[1]):
            if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
                break
            vectors.append(np.array(v, np.float32).astype(float))
        if len(vectors) == 2 and len(vectors[0]) == len(vectors[1]):
            x, y = vectors
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                yield a[0], b[0]


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = []
    centres = draw.normal(size=(30, 24))
    for i in range(420):
        centre = centres[i % 30] if i % 3 else draw.normal(size=24)
        noise = draw.choice([0.0, 0.01, 0.1, 0.2])
        rows.append((i, (centre + noise * draw.normal(size=24)).astype("f4").tolist(), int(i % 4)))
    rows += [
        (1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] * 24, 1), (1004, [None] * 24, 1),
        (1005, [float("inf")] + [1.0] * 23, 1), (1006, [1.0] * 24, None), (1007, [1.0] * 24, None), (1008, [1.0, 2.0], 1),
        (1009, [2.0, 4.0], 1), (1010, [1.0, 2.0], 1),
    ]
    linked = list(cosine_links(rows))
    root, degree = classes([r[0] for r in rows], linked)
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<float>, label int, kept boolean").repartition(4)
    found = {r.vec_id: r for r in hamming.near_vectors(df).collect()}
    assert len(found) == len(rows)
    # No link below the threshold, and a recall of 0.9 at least.
    assert all(found[i].n_links <= degree[i] for i in degree)
    assert sum(r.n_links for r in found.values()) >= 0.9 * 2 * len(linked) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert found[1008].component_id == found[1009].component_id == found[1010].component_id == 1008 and found[1008].n_links == 2
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in range(1000, 1008))
    assert all(root[i] <= found[i].component_id for i in root)
    assert hamming.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    draw = np.random.default_rng(0)
    for rows in (500, 100_000, 10_000_000):
        width, tables = hamming.plan(rows)
        base = draw.normal(size=(3000, 64))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = draw.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        other = 0.98 * base + np.sqrt(1 - 0.98**2) * side
        quantiser = hamming.learn(base, 64, width, tables)
        assert (quantiser.substrings(base) == quantiser.substrings(other)).any(1).mean() > 0.97


@pytest.mark.parametrize("share", [0.0, 0.71, 0.9, 0.95])
def test_recall_of_vectors_that_share_a_direction(share):
    draw = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    common = unit(draw.normal(size=(1, 64)))
    own = draw.normal(size=(13_000, 64))
    vectors = share * common + np.sqrt(1 - share**2) * unit(own - own @ common.T * common)
    # Learnt from some, measured on others.
    sample, base = vectors[:10_000], vectors[10_000:]
    side = draw.normal(size=base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    other = 0.98 * base + np.sqrt(1 - 0.98**2) * side
    for rows in (3000, 1_000_000, 10_000_000):
        quantiser = hamming.learn(sample, 64, *hamming.plan(rows))
        assert (quantiser.substrings(base) == quantiser.substrings(other)).any(1).mean() > 0.99


def test_recall_of_few_vectors_that_share_a_direction():
    draw = np.random.default_rng(5)
    base = 3 + draw.normal(size=(40, 64))
    for sample in (base, base[:0]):
        quantiser = hamming.learn(sample, 64, *hamming.plan(40))
        other = base + 0.1 * draw.normal(size=base.shape)
        assert (quantiser.substrings(base) == quantiser.substrings(other)).any(1).mean() > 0.97


def test_one_of_each_shuffles_no_text_that_surely_stays(spark, monkeypatch):
    import corpus_pipeline

    draw = random.Random(3)
    texts = [" ".join(f"u{draw.randrange(10**9)}" for _ in range(30)) for _ in range(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i].upper(), "en", "s", 2) for i in range(5)]  # copies, their rows twice
    rows += rows[-5:]
    rows += [(None, texts[0], "en", "s", 3), (None, None, None, None, None), (2000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if many documents went
    try:
        kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        found = kept.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted([r for r in rows if r[0] is None or not 1000 <= r[0] < 2000], key=key)
    # One part of the documents meets the keys that go, the other is only told apart.
    assert plan.count("LeftAnti") == 1 and plan.count("Union") == 1 and plan.count("__bits") >= 2
