"""BPE against the tokenizers library, and packing against its definition."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridsmith.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    None, "", " ", "\n\t", "a", "Hello WORLD don't we'll 123", "<|endoftext|>x<|startoftext|>", "<|endoftext", "ΑΣ ΟΣ. Σ",
    "İstanbul ǅ ß", "é é ́", "a\x1cb\x1d c\x85d　e", "日本語テキスト", "🙂🙂 a🙂b", "͸՘", "x" * 5000,
    "ab" * 3000 + " " + "é" * 100, "1" * 300, "!?!?" * 50, "the " * 500, "Ᲊ\U00010d50 Ƛ",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def random_texts(n, seed=3):
    draw = random.Random(seed)
    alphabet = "aaeeiinnsstt bcdfghlmopru  .,'-!9éüñΣ\n日"
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 200))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(library):
    encoder = bpe.encoder(PATH)
    texts = [t for t in EDGES if t] + random_texts(400)
    for text, ids in zip(texts, encoder.encode_all(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text[:50]
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_one_word_at_a_time_equals_many_at_once():
    encoder = bpe.encoder(PATH)
    words = sorted({w for t in random_texts(100, 9) for w in encoder.pattern.findall(t.lower())})
    many = encoder.words(words)
    assert [np.frombuffer(m, "<u4").tolist() for m in many] == [encoder.word(w) for w in words]


def test_small_memory_and_parts_change_nothing(monkeypatch):
    texts = random_texts(60, 4)
    expected = list(bpe.encoder(PATH).encode_all(texts))
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "CHARS", 40)
    assert list(bpe.PrefixBpe(PATH).encode_all(texts)) == expected


def test_encode_documents(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGES)] + [(4, "a", 2)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(docs, PATH, with_ids=True).collect()
    assert len(rows) == len(EDGES) + 1
    for row in rows:
        ids = library.encode(EDGES[row.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids) and row.ids == ids and row.decoded == decoded
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def smallest(lengths, capacity):
    """The least number of sequences, by trying every way to place the pieces."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(rooms))
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_patterns_hold_every_piece_in_the_fewest_sequences(seed):
    draw = random.Random(seed)
    lengths = sorted((draw.randint(1, 20) for _ in range(draw.randint(0, 8))), reverse=True)
    patterns = packing.pack_lengths(dict(Counter(lengths)), 20)
    used = Counter()
    for times, items in patterns:
        assert sum(length * each for length, each in items) <= 20
        for length, each in items:
            used[length] += times * each
    assert used == Counter(lengths)
    assert sum(times for times, _ in patterns) == smallest(lengths, 20)


def test_many_pieces_reach_the_lower_bound():
    draw = random.Random(1)
    counts = Counter(min(4096, int(draw.lognormvariate(6.5, 1)) + 1) for _ in range(20_000))
    total = sum(length * n for length, n in counts.items())
    assert sum(times for times, _ in packing.pack_lengths(dict(counts))) == math.ceil(total / 4096)


@pytest.mark.parametrize("buckets", [100_000, 3])
def test_pack_documents(spark, library, buckets):
    texts = ["the cat", None, "", "a b c", "a b c", "word " * 95, *random_texts(40, 8)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, "a b c", 9)], "doc_id long, text string, offset long")
    rows = packing.pack_documents(docs, PATH, capacity=30, bucket_rows=buckets).collect()
    by_doc = {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        expected = [
            (k, s, len(ids[s : s + 30]), zlib.crc32(np.array(ids[s : s + 30], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 30))
        ]
        assert pieces == sorted(expected * (2 if i == 3 else 1))
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for held in sequences.values():
        ends = [0, *itertools.accumulate(length for _, length in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 30
    assert len(sequences) == math.ceil(sum(r.length for r in rows) / 30)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
