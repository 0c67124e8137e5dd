"""BPE encoding and decoding by a dynamic programme over prefixes.

Byte-pair encoding of a word has this property: for every prefix there is exactly one last
token, and a row of tokens is the encoding if and only if each token encodes to itself and
each neighbouring pair encodes to that pair. So a word is read once from the left. At every
position the suffix matches of an automaton over all tokens are the candidates; the one whose
preceding prefix ends in a compatible token is stored, and the back-pointers from the end spell
the exact ids. No merge is ever carried out.

Two tokens are compatible when no merge crosses the seam between them. A token's pieces beside
the seam live from the merge that makes them to the merge that takes them up; a merge of a left
and a right piece crosses the seam if its rank lies in the lives of both. Of equal ranks the
leftmost merge comes first.

Reads tokenizer files with the model kind BPE, the normalisers NFC, blanks and lower case, and a
pattern of words; everything else is refused. Texts may be of any length, null is empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release_memory

# Words kept with their ids by a worker, in each of two generations, and between two tasks. A bound on memory only.
CACHE, KEPT = 300_000, 250_000
# Characters that are split into runs at a time.
CHARS = 3_000_000
# Longer runs are encoded anew each time.
LONG = 64
_END = "\U0010fffe"
# The table of tokens: a polynomial hash modulo 2**64, its highest bits give the slot.
_BASE, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_SLOTS, _SHIFT = 1 << 20, 44
_PAIRS, _PAIR_SHIFT = 1 << 21, 43
_NUMBER, _END_ONLY = (1 << 20) - 1, (1 << 20) - 1
# Ranges of letters and of digits that came with Unicode 17, after the library's
# Unicode 16, and the small forms of capitals that came after Python's Unicode 15.
_NEWER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NEWER_DIGITS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
_LATE_CASE = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
# Blanks for Python's split but not for the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _of_its_time(pattern: str) -> str:
    """Keep letters and digits to the characters that the tokenizer's library knows."""
    for kind, newer in (("L", _NEWER_LETTERS), ("N", _NEWER_DIGITS)):
        known = rf"[\p{{{kind}}}--[{newer}]]"
        pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", rf"[^\s[\p{{L}}--[{_NEWER_LETTERS}]][\p{{N}}--[{_NEWER_DIGITS}]]]")
        pattern = pattern.replace(rf"[\p{{{kind}}}]", known)
    return pattern


def _parts(text: str) -> Iterator[str]:
    """A long text cut before blanks, where no word and no composed character is cut."""
    start = 0
    while len(text) - start > CHARS:
        cut = text.find(" ", start + CHARS)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class PrefixBpe:
    """The encoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a BPE tokenizer of the supported kind")
        self.suffix = model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(_of_its_time(pattern), regex.V1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        vocab = model["vocab"]
        self.bytes = byte_characters()
        self.pieces: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = text
        # The merge of two ids (packed into a number): its rank; the parts of a merged id, the rank that makes it.
        self.rank: dict[int, int] = {}
        self.parts = np.full((2, len(self.pieces)), -1, np.int32)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 20 | b] = rank
            self.parts[:, whole] = a, b
        merged = np.flatnonzero(self.parts[0] >= 0)
        self.born = np.full(len(self.pieces), -1, np.int32)
        self.born[merged] = [self.rank[a << 20 | b] for a, b in self.parts[:, merged].T.tolist()]
        if (self.born[self.parts[:, merged]].max(0) >= self.born[merged]).any():
            raise ValueError(f"{path} has a merge that comes before its parts")
        # Pieces beside a seam, of the tokens met so far.
        self.edges: tuple[dict, dict] = ({}, {})
        self.pair_keys, self.pair_fits = np.zeros(_PAIRS, np.uint64), np.zeros(_PAIRS, bool)
        self.pairs_held = 0
        self.automaton = ahocorasick.Automaton()
        codes = {c: b + 1 for b, c in enumerate(self.bytes)} | {_END: 257}
        spelled = []
        for text, i in vocab.items():
            a, b = self.parts[:, i].tolist()
            if a < 0 or self._crossings(a, b) == [(a, b)]:
                word = text[: -len(self.suffix)] + _END if text.endswith(self.suffix) else text
                self.automaton.add_word(word, (i, len(word)))
                spelled.append((i, [codes[c] for c in word]))
        self.automaton.make_automaton()
        self.longest = max(len(word) for _, word in spelled)
        self._index(spelled)
        self.special_ids = {text: np.array([i], "<u4").tobytes() for text, i in self.special.items()}
        self.young: dict[str, bytes] = dict(self.special_ids)
        self.old: dict[str, bytes] = {}
        self.rest()

    def rest(self) -> None:
        """Keep only a bounded part of what was learnt from texts, between two tasks of a worker."""
        self.edges, self.old = ({}, {}), {}
        if len(self.young) > KEPT:
            self.young = dict(self.special_ids)
        release_memory()

    def _index(self, spelled: list[tuple[int, list[int]]]) -> None:
        """Hash table of all ends of tokens, by which many words are read at once.

        A slot packs 44 bits of the hash with a number: which token, or that it is only the end of one.
        """
        ends: dict[int, int] = {}
        for token, word in spelled:
            value, power = 0, _MIX
            for at in reversed(range(len(word))):
                value = (value + word[at] * power) & _MASK
                power = power * _BASE & _MASK
                if at:
                    ends.setdefault(value, _END_ONLY)
            if ends.get(value, _END_ONLY) != _END_ONLY:
                raise ValueError("two tokens share a hash")
            ends[value] = token
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        slots, self.probes = [0] * _SLOTS, 0
        for value, number in ends.items():
            at, probe = value >> _SHIFT, 1
            while slots[at]:
                at, probe = (at + 1) % _SLOTS, probe + 1
            slots[at] = value & ~_NUMBER | number
            self.probes = max(self.probes, probe)
            if number != _END_ONLY:
                self.hashes[number] = value
        self.slots = np.array(slots, np.uint64)

    def _tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The token of each hash; ``_END_ONLY`` for an end of a token, -1 for neither."""
        hashes = hashes * np.uint64(_MIX)
        at = (hashes >> np.uint64(_SHIFT)).astype(np.int64)
        held = self.slots[at]
        same = (held ^ hashes) <= np.uint64(_NUMBER)
        found = np.where(same, (held & np.uint64(_NUMBER)).astype(np.int32), np.int32(-1))
        left = np.flatnonzero(~same & (held != 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            held = self.slots[(at[left] + probe) % _SLOTS]
            same = (held ^ hashes[left]) <= np.uint64(_NUMBER)
            found[left[same]] = (held[same] & np.uint64(_NUMBER)).astype(np.int32)
            left = left[~same & (held != 0)]
        # The slot holds a part of the hash; a token needs all of it.
        token = np.flatnonzero((found >= 0) & (found != _END_ONLY))
        found[token[self.hashes[found[token]] != hashes[token]]] = _END_ONLY
        return found

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs, by a hash table of the pairs met so far."""
        if self.pairs_held > _PAIRS // 2:
            self.pair_keys[:], self.pairs_held = 0, 0
        keys = (before.astype(np.uint64) << np.uint64(20)) | token.astype(np.uint64) | np.uint64(1 << 40)
        at = ((keys * np.uint64(_MIX)) >> np.uint64(_PAIR_SHIFT)).astype(np.int64)
        fits = np.zeros(len(keys), bool)
        left, new = np.arange(len(keys)), []
        while len(left):
            held = self.pair_keys[at[left]]
            same = held == keys[left]
            fits[left[same]] = self.pair_fits[at[left[same]]]
            new.append(left[held == 0])
            left = left[~same & (held != 0)]
            at[left] = (at[left] + 1) % _PAIRS
        rows = np.concatenate(new)
        if len(rows):
            fresh, first, where = np.unique(keys[rows], return_index=True, return_inverse=True)
            found = np.array([not self._crossings(k >> 20 & 0xFFFFF, k & 0xFFFFF) for k in fresh.tolist()])
            for key, slot, fit in zip(fresh.tolist(), at[rows[first]].tolist(), found.tolist()):
                while self.pair_keys[slot]:
                    slot = (slot + 1) % _PAIRS
                self.pair_keys[slot], self.pair_fits[slot] = key, fit
            self.pairs_held += len(fresh)
            fits[rows] = found[where]
        return fits

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of many words: the same programme, one position of all words at a time."""
        out: list[bytes] = [b""] * len(words)
        raw = [word.encode() for word in words]
        size = np.array([len(r) for r in raw], np.int64)
        for row in np.flatnonzero(size > LONG).tolist():
            out[row] = np.array(self.word(words[row]), "<u4").tobytes()
        low = 0
        for high in (6, 9, 12, 16, 24, 40, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for start in range(0, len(rows), 20_000):
                part = rows[start : start + 20_000]
                self._words([raw[r] for r in part.tolist()], size[part], high, part, out)
        return out

    def _words(self, raw: list[bytes], size: np.ndarray, high: int, rows: np.ndarray, out: list[bytes]) -> None:
        n = len(raw)
        codes = np.frombuffer(b"".join([r.ljust(high, b"\0") for r in raw]), np.uint8).reshape(n, high)
        codes = np.concatenate([codes.T.astype(np.uint64) + np.uint64(1), np.zeros((1, n), np.uint64)])
        codes[size, np.arange(n)] = 257
        prefix = np.zeros((high + 2, n), np.uint64)
        power = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(high + 2)]
        for at in range(high + 1):
            prefix[at + 1] = prefix[at] * power[1] + codes[at]
        last = np.full((high + 2, n), -1, np.int32)
        length = np.zeros((high + 2, n), np.int32)
        for at in range(1, high + 2):
            alive = np.flatnonzero(size + 1 >= at)
            for step in range(1, min(at, self.longest) + 1):
                token = self._tokens(prefix[at][alive] - prefix[at - step][alive] * power[step])
                hit = (token >= 0) & (token != _END_ONLY)
                if step < at:
                    hit &= last[at - step][alive] >= 0
                stay = token >= 0
                if hit.any():
                    use, token = alive[hit], token[hit]
                    if step < at:
                        fits = self._fits(last[at - step][use], token)
                        use, token = use[fits], token[fits]
                    last[at][use] = token
                    length[at][use] = step
                    stay &= last[at][alive] < 0
                alive = alive[stay]
                if not len(alive):
                    break
        at, here = size + 1, np.arange(n)
        count = np.zeros(n, np.int64)
        chain = np.zeros((high + 1, n), np.uint32)
        left = here
        while len(left):
            chain[count[left], left] = last[at[left], left]
            count[left] += 1
            at[left] -= length[at[left], left]
            left = left[at[left] > 0]
        # The tokens of a word were met from its end.
        turned = count[:, None] - 1 - np.arange(count.max())
        ids = chain[np.maximum(turned, 0), here[:, None]][turned >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        for row, start, end in zip(rows.tolist(), [0, *ends], ends):
            out[row] = ids[start:end]

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces at a seam, from the whole token inwards: (id, rank of its birth, rank of its end)."""
        chain = self.edges[side].get(token)
        if chain is None:
            chain, piece, end = [], token, 1 << 60
            while piece >= 0:
                start = int(self.born[piece])
                chain.append((piece, start, end))
                piece, end = int(self.parts[side, piece]), start
            self.edges[side][token] = chain
        return chain

    def _crossings(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs of pieces whose merge would cross the seam between ``a`` and ``b``."""
        found = []
        rank_of, left_edge = self.rank.get, self._edge(b, 0)
        for x, x_from, x_to in self._edge(a, 1):
            for y, y_from, y_to in left_edge:
                rank = rank_of(x << 20 | y)
                if rank is not None and x_from < rank < x_to and y_from < rank <= y_to:
                    found.append((x, y))
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` together encodes to these two."""
        return bool(self._fits(np.array([a]), np.array([b]))[0])

    def word(self, word: str) -> list[int]:
        """The ids of one word of the pattern."""
        if not (word.isascii() and word.isprintable()):
            table = self.bytes
            word = "".join([table[b] for b in word.encode()])
        word += _END
        last: list[int | None] = [None] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        known: dict[tuple[int, int], bool] = {}
        for end, (token, length) in self.automaton.iter(word):
            at = end + 1
            if last[at] is not None:
                continue
            if length < at:
                before = last[at - length]
                if before is None:
                    continue
                fits = known.get((before, token))
                if fits is None:
                    fits = known[before, token] = not self._crossings(before, token)
                if not fits:
                    continue
            last[at], size[at] = token, length
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _split(self, run: str) -> list[str]:
        """The words of a run without blanks."""
        if run.isalpha():
            return [run]
        if run[-1:] in (",", ".") and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.pattern.findall(run)

    def _learn(self, runs: set[str], known: dict[str, bytes]) -> None:
        """Add the ids of each of the runs without blanks to ``known``."""
        old = self.old
        back = runs & old.keys()
        known.update(zip(back, map(old.__getitem__, back)))
        fresh = list(runs - back)
        split = [self._split(run if run.isascii() else run.translate(_LATE_CASE)) for run in fresh]
        # Runs of one word first: the words of the others are often among them or known.
        single = [parts[0] for parts in split if len(parts) == 1]
        rest = {word for parts in split if len(parts) > 1 for word in parts}
        unknown: list[str] = []
        words = dict(zip(single, self.words(single)))
        for word in rest.difference(words):
            ids = (known.get(word) or old.get(word)) if word.isalpha() else None
            if ids is None:
                unknown.append(word)
            else:
                words[word] = ids
        words.update(zip(unknown, self.words(unknown)))
        for run, parts in zip(fresh, split):
            known[run] = words[parts[0]] if len(parts) == 1 else b"".join([words[part] for part in parts])

    def _runs(self, text: str) -> list[str]:
        if not text.isascii():
            # Each character by itself: no other form of sigma for the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in _SEPARATORS):
            return regex.split(r"\p{White_Space}+", text)
        return text.split()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        runs_of: list[list[str]] = []
        for text in texts:
            if not text:
                runs_of.append([])
            elif "<|" not in text:
                runs_of.append(self._runs(text))
            else:
                runs, at = [], 0
                for match in self.special_pattern.finditer(text):
                    runs += self._runs(text[at : match.start()])
                    runs.append(match[0])
                    at = match.end()
                runs_of.append(runs + self._runs(text[at:]))
        if len(self.young) > CACHE:
            self.old, self.young = self.young, dict(self.special_ids)
        known = self.young
        fresh: set[str] = set()
        for runs in runs_of:
            fresh.update(itertools.filterfalse(known.__contains__, runs))
        self._learn(fresh, known)
        joined = [b"".join(map(known.__getitem__, runs)) for runs in runs_of]
        for run in fresh:
            if len(run) > LONG:
                del known[run]
        return joined

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """As ``encode_batch`` in bounded memory: some million characters at a time, longer texts in parts."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            length = len(text or "")
            if held and size + length > CHARS:
                yield from self.encode_batch(held)
                held, size = [], 0
            if length > CHARS:
                yield b"".join([self.encode(part) for part in _parts(text)])
            else:
                held.append(text)
                size += length
        yield from self.encode_batch(held)

    def decode(self, ids: bytes) -> str:
        """The tokens' texts with a blank between them (files of this kind name no decoder)."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PrefixBpe:
    """One encoder for each worker process and file."""
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the number of tokens and digests of the ids and of the decoded text.

    ``with_ids`` adds the ids (array of int) and the decoded text. Null texts are empty and have
    the digests of nothing. ``path`` must be readable on every executor. One pass, no shuffle.
    """
    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        yield from digests(bpe, batches)
        bpe.rest()

    def digests(bpe: PrefixBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_digest, text_digest, all_ids, decoded = [], [], [], [], []
            for ids in bpe.encode_all(v.as_py() for v in batch.column(1)):
                back = bpe.decode(ids)
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype("i4"))
                    decoded.append(back)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(key, text).mapInArrow(run, schema)
