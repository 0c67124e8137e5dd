"""Hard negatives, divergence and mixing against plain Python versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label long, row int, anchor string"


def hard_negatives(rows, anchors, positives=5, wanted=5):
    """Every pair, one at a time."""
    sound = {
        (i, tuple(v), l)
        for i, v, l in rows
        if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    whole = [(i, [int(math.floor(256 * x)) for x in v], l) for i, v, l in sound]
    found = []
    for a in whole:
        if a[0] not in anchors:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in whole if b is not a and len(b[1]) == len(a[1])), key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fits = [s for s in scored if s[2] != a[2] and 80 * p <= 100 * s[0] <= 100 * p][:wanted]
            found += [(a[0], i, k + 1, s[1], p, s[0]) for k, s in enumerate(fits)]
    return sorted(found)


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in negatives.mine_negatives(df, F.col("vec_id") % every == 0).collect())


def near_vectors(seed, n, dim, labels, spread):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=dim)
    return [
        (int(i), [float(x) for x in centre + spread * draw.normal(size=dim)], int(0 if draw.random() < 0.4 else draw.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("dim, spread, scale", [(7, 0.4, 1.0), (3, 1.5, 8e5), (16, 0.2, 0.01)])
def test_negatives_against_all_pairs(spark, monkeypatch, dim, spread, scale):
    monkeypatch.setattr(negatives, "TILE_NUMBERS", 64 * dim)
    rows = [(i, [x * scale for x in v], l) for i, v, l in near_vectors(dim, 230, dim, 4, spread)]
    expected = hard_negatives(rows, {i for i, _, _ in rows if i % 10 == 0})
    assert expected and mined(spark, rows) == expected


def test_negatives_of_odd_rows(spark):
    same = [1.0, 0.5, 0.25]
    rows = [
        (0, same, 1), (0, same, 1), (10, same, 2), (11, same, 1), (12, same, 1), (5, same, 2), (4, same, 2),
        (13, [1.0, None, 0.0], 1), (14, [1.0, float("nan"), 0.0], 2), (15, [float("inf"), 0.0, 0.0], 2), (16, None, 1),
        (17, [], 1), (18, same, None), (None, same, 2), (20, [-1.0, -1.0, -1.0], 1), (30, [1.0, 2.0], 1), (31, [0.9, 2.0], 1),
        (32, [1.0, 1.9], 2), (11, [0.9, 0.5, 0.25], 1), (40, [0.0, 0.0, 0.0], 3), (41, [0.0, 0.0, 0.0], 3),
    ]
    expected = hard_negatives(rows, {0, 10, 20, 30, 40})
    assert expected and mined(spark, rows) == expected
    assert mined(spark, []) == [] and mined(spark, [(1, same, 1), (2, same, 2)]) == []


def test_packed_fields_are_exact():
    draw = np.random.default_rng(3)
    for low, high, dim in ((-120, 120, 64), (-(1 << 20), 1 << 20, 9), (-(1 << 29), 1 << 29, 5), (3, 9, 2)):
        rows, anchors = draw.integers(low, high, (13, dim)), draw.integers(low, high, (4, dim))
        bias = max(0, -low)
        longest = max(sum((int(x) + bias) ** 2 for x in r) for r in [*rows, *anchors])
        product = negatives.Product(rows.astype(negatives.plan(longest)[2]), bias, longest)
        expected = [[sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows] for a in anchors]
        assert product.scores(anchors).tolist() == expected
    assert negatives.plan(1 << 19)[1] == 3 and negatives.plan(1 << 70)[1:] == (4, object)


def divergence(rows, ranks=200):
    """Shares and values term by term, in Python's whole numbers."""
    import re
    from collections import Counter, defaultdict

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    uses = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))) for t, l, s in rows]
    docs, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for l, s, terms in uses:
        groups[l].add(s)
        docs[l].update(set(terms))
        own[l, s].update(terms)
    out = []
    for l, sources in groups.items():
        kept = [t for t, n in docs[l].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: own[l, s][t] for t in kept})

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(own[l, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[l, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(l, s, part, i, v, k + 1) for k, (v, i) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, **kw):
    from gridsmith.llm.divergence import audit_divergence

    df = spark.createDataFrame([(i, t, l, s, 1.0, "x") for i, (t, l, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, value double, term string")
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in audit_divergence(df.repartition(4), **kw).collect())


def test_divergence_against_every_term(spark, monkeypatch):
    from gridsmith.llm import divergence as module

    draw = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghijÉß漢" for b in "klmnopqrstuvwxyz"] + ["the"] * 200
    rows = [
        (" ".join(draw.choices(words, k=draw.choice((0, 3, 40, 300)))).replace("a", "A", 3) + " 12 x-y_z", draw.choice("ed"), f"s{min(draw.randrange(60), 25)}")
        for _ in range(400)
    ]
    monkeypatch.setattr(module, "WORDS", 1)
    monkeypatch.setattr(module, "SOURCES", 5)
    monkeypatch.setattr(module, "TILES", 1)
    assert audited(spark, rows) == divergence(rows)
    assert audited(spark, rows, ranks=2) == divergence(rows, 2)


def test_divergence_of_odd_rows(spark):
    rows = [
        (None, None, None), ("", "en", "a"), ("one two", "en", "b"), ("one two", "en", "b"), ("ONE 1two", "en", None), ("one", "en", ""),
        ("x" * 5000, "en", "a"), ("alone", "de", "a"), ("alone", "de", "b"), ("12 34", "fr", "a"), ("one " * 30_000, "en", "c"),
    ]
    assert audited(spark, rows) == divergence(rows)
    assert audited(spark, []) == []


def mix(rows, weights=(5, 2, 1)):
    """The contract read literally: (id, source, size, source size, target, taken), sources filled round by round."""
    import hashlib
    import re
    from fractions import Fraction

    docs = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or "")), q) for i, t, s, q in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, budget = set(), Fraction(3 * sum(size.values()), 2)
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * size[s] for s in full)
        target = {s: left * weight[s] / sum(weight[f] for f in free) if s in free else Fraction(2 * size[s]) for s in names}
        above = {s for s in free if target[s] > 2 * size[s]}
        if not above:
            break
        full |= above

    def key(d):
        text = f"mix|{'null' if d[0] is None else d[0]}|{d[2]}"
        good = d[3] if d[3] is not None and d[3] > 1e-6 else 1e-6
        return -math.log((int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / good

    out = []
    for s in names:
        words = math.floor(float(target[s]) + 0.5)
        epochs, rest = divmod(words, max(1, size[s]))
        for d in sorted((d for d in docs if d[1] == s), key=lambda d: (key(d), -1 if d[0] is None else d[0], d[2])):
            part = max(0, min(d[2], rest))
            rest -= part
            out.append((d[0], s, d[2], size[s], float(target[s]), epochs * d[2] + part))
    return out


def mixed(spark, rows, **kw):
    from gridsmith.llm.mixing import mix_sources

    df = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "doc_id long, text string, source string, good double, size long, target double")
    return [tuple(r) for r in mix_sources(df.repartition(3), quality=F.col("good"), **kw).collect()]


def order(rows):
    return sorted((tuple((v is not None, v if v is not None else 0) for v in r) for r in rows))


@pytest.mark.parametrize("cell", [20_000, 7, 1])
def test_mixing_against_the_contract(spark, cell):
    draw = random.Random(cell)
    sources = ["a"] * 60 + ["b", "c", "d", "Z", "é", "z", None, ""] * 4 + ["tiny"]
    rows = [
        (k, " ".join("w" * draw.choice((0, 1, 4, 30, 200))), draw.choice(sources), draw.choice((0.5, 1.0, 2.0, 1e-4, 900.0, None, -1.0)))
        for k in range(500)
    ]
    found = mixed(spark, rows, cell=cell)
    assert order(found) == order(mix(rows))
    for s in {r[1] for r in found}:
        own = [r for r in found if r[1] == s]
        assert abs(sum(r[5] for r in own) - own[0][4]) <= 0.5 and all(r[5] <= 2 * r[2] for r in own)


def test_mixing_of_odd_rows(spark):
    rows = [
        (None, None, None, 1.0), (None, "a b", None, 1.0), (1, "a\tb\x0bc d", "x", 1.0), (1, "a\tb\x0bc d", "x", 1.0), (1, "", "x", 1.0),
        (2, "word " * 20_000, "y", float("nan")), (3, "", "empty", 1.0), *[(7, "one two three", "copies", 1.0)] * 50,
    ]
    assert order(mixed(spark, rows)) == order(mix(rows))
    assert mixed(spark, []) == [] and [r[4:] for r in mixed(spark, [(1, None, "x", 1.0)])] == [(0.0, 0)]


def test_better_documents_come_first(spark):
    rows = [(k, "one two", "abc"[k % 3], 4.0 if k % 2 else 0.25) for k in range(3000)]
    taken = {r[0]: r[5] for r in mixed(spark, rows) if r[1] == "b"}
    assert sum(v for k, v in taken.items() if k % 2) > 1.5 * sum(v for k, v in taken.items() if not k % 2) > 0


@pytest.mark.parametrize("scale", [1, 10**5, 4 * 10**5, 10**9])
def test_mixing_targets_of_large_sources(spark, scale):
    """Words times weights pass the range of an int long before the words do."""
    from gridsmith.llm.mixing import mix_sources

    words = {"a": 900 * scale, "b": 700 * scale, "c": 80 * scale}
    df = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(words.items())], "doc_id long, source string, size long")
    found = {r.source: r.target for r in mix_sources(df, size="size").collect()}
    # The contract's level: c is full at twice its words; a and b share the rest by 5 to 2.
    rest = 3 * sum(words.values()) - 2 * 2 * words["c"]
    assert found == {"a": float(5 * rest) / 14.0, "b": float(2 * rest) / 14.0, "c": 160.0 * scale}
