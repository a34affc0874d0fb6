"""Byte-level byte-pair encoding and decoding.

Every match of the splitting pattern is encoded by itself. A segment tree over its byte positions
holds, in each leaf, the rank of the pair that starts there; the root is the leftmost pair of least
rank. A merge changes three leaves (the merged pair, its live left neighbour, the part that
vanished), each at the cost of one walk to the root. Short matches of a batch are merged together,
one tree per row of an array; long ones have a tree of their own, so that a match of a million
bytes costs n log n.

A match that is a token itself is taken as that token at once, as the public encoders do.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .memory import held

#: Matches up to so many bytes are merged many at a time.
SHORT = 64
#: Bytes, about, of matches kept with their ids in a worker before older ones are set aside (so up to
#: three times as many), and what one costs besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 16 << 20, 200
#: Characters split, and words merged, at a time.
SLICE_CHARS = 1 << 19
MERGED = 1 << 13
#: A pattern under which a single space begins a match; texts are cut there first. Fixed value.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that end a word, and the first character whose kind is left to the pattern.
MARKS = frozenset(".,;:!?")
UNUSUAL = "\u0370"
#: White space of one byte, and other.
SPACES, WIDE_SPACES = " \t\n\r\v\f\x1c\x1d\x1e\x1f", "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Width of the tree of a word by its length.
WIDTHS = [1 << max(1, (n - 1).bit_length()) for n in range(SHORT + 1)]
NONE = np.int32(np.iinfo(np.int32).max)


def _apart(text: str) -> bool:
    """No two white spaces in a row, and none at either end."""
    spaces = sum(map(text.count, SPACES))
    if not text.isascii():
        spaces += sum(map(text.count, WIDE_SPACES))
    return len(text.split()) == spaces + 1


class Ranks:
    """A vocabulary of ranked tokens and the table of pairs that merge."""

    def __init__(self, lines: bytes, pattern: str):
        self.rank = {
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token
        }
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.tokens = pa.array(self.token, pa.large_binary())
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.base = len(self.token)
        self.pair = {
            self.rank[token[:cut]] * self.base + self.rank[token[cut:]]: rank
            for token, rank in self.rank.items()
            for cut in range(1, len(token))
            if token[:cut] in self.rank and token[cut:] in self.rank
        }
        self._hash_pairs()
        self.cache_bytes = self.word_bytes = 0
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.id_bytes = [np.int32(i).tobytes() for i in range(self.base)]
        self.marks = {mark: self.id_bytes[self.rank[mark.encode()]] for mark in MARKS}
        self.by_space = pattern == SPACE_PATTERN

    def _hash_pairs(self) -> None:
        """Pairs in a table with linear probing, so that a whole array of pairs is looked up at once."""
        bits = max(4, (8 * len(self.pair)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_keys = np.full((1 << bits) + len(self.pair), -1, np.int64)
        self.pair_ranks = np.full(len(self.pair_keys), NONE, np.int32)
        keys = np.array(list(self.pair), np.int64)
        ranks = np.array(list(self.pair.values()), np.int32)
        slots = self._slot(keys)
        self.probes = 0
        while len(keys):
            free = self.pair_keys[slots] < 0
            self.pair_keys[slots[free]] = keys[free]
            placed = self.pair_keys[slots] == keys
            self.pair_ranks[slots[placed]] = ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], slots[~placed] + 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``NONE`` where the pair is no token."""
        keys = left.astype(np.int64) * self.base + right
        slots = self._slot(keys)
        there = self.pair_keys[slots]
        ranks = np.where(there == keys, self.pair_ranks[slots], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            there = self.pair_keys[slots[open_] + step]
            hit = there == keys[open_]
            ranks[open_[hit]] = self.pair_ranks[slots[open_[hit]] + step]
            open_ = open_[~hit & (there >= 0)]
        return ranks

    def merge_many(self, words: list[bytes], width: int) -> tuple[bytes, np.ndarray]:
        """Token ids, as 32-bit numbers one after another, of words of 2 to ``width`` bytes, and the
        number of ids of each. ``width`` is a power of two."""
        n, lengths = len(words), np.array([len(w) for w in words])
        rows = np.repeat(np.arange(n), lengths)
        columns = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # All arrays are flat: position i of word w is at w * width + i, node k of its tree at 2 * w * width + k.
        ids = np.full(n * width, -1, np.int32)
        ids[rows * width + columns] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        after[np.cumsum(np.full(n, width)) - width + lengths - 1] = width
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        tree = np.full((n, 2 * width), NONE, np.int32)
        starts = columns < lengths[rows] - 1
        r, c = rows[starts], columns[starts]
        at = r * width + c
        tree[r, width + c] = self._leaf(self.pair_rank(ids[at], ids[at + 1]), c, width)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        tree = tree.reshape(-1)
        base = np.arange(n) * width
        while True:
            root = tree[2 * base + 1]
            alive = root != NONE
            base, root = base[alive], root[alive]
            if not len(base):
                break
            rank, c = np.divmod(root, width)
            at = base + c
            gone = after[at]
            follows = after[base + gone]
            ids[at], ids[base + gone] = rank, -1
            after[at] = follows
            left = before[at]
            top = 2 * base
            tree[top + width + gone] = NONE
            right_of = np.where(follows < width, ids[np.minimum(base + follows, len(ids) - 1)], 0)
            ranks = np.where(follows < width, self.pair_rank(rank, right_of), NONE)
            tree[top + width + c] = self._leaf(ranks, c, width)
            has = np.flatnonzero(follows < width)
            before[base[has] + follows[has]] = c[has]
            has = np.flatnonzero(left >= 0)
            c_left, top_left = left[has], top[has]
            ranks = self.pair_rank(ids[base[has] + c_left], rank[has])
            tree[top_left + width + c_left] = self._leaf(ranks, c_left, width)
            for tops, leaf in ((top, gone), (top, c), (top_left, c_left)):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    child = tops + 2 * node
                    tree[tops + node] = np.minimum(tree[child], tree[child + 1])
                    node >>= 1
        kept = ids >= 0
        return ids[kept].tobytes(), kept.reshape(n, width).sum(axis=1)

    @staticmethod
    def _leaf(ranks: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
        return np.where(ranks == NONE, NONE, ranks * width + columns)

    def merge_one(self, word: bytes) -> np.ndarray:
        """Token ids of one word of any length."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = [int(self.byte[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62

        def leaf(i: int) -> int:
            j = after[i]
            rank = self.pair.get(ids[i] * self.base + ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            for i in (gone, at, before[at]):
                if i >= 0:
                    node = width + i
                    tree[node] = none if i == gone else leaf(i)
                    node >>= 1
                    while node:
                        low = min(tree[2 * node], tree[2 * node + 1])
                        if tree[node] == low:
                            break
                        tree[node] = low
                        node >>= 1
        return np.array([i for i in ids if i >= 0], np.int32)

    def learn(self, names: list[str], words: list[bytes], into: dict[str, bytes]) -> None:
        """Put the ids of the words, one match each, into a cache under their names."""
        waiting: dict[int, tuple[list[str], list[bytes]]] = {}
        for name, word, rank in zip(names, words, map(self.rank.get, words), strict=True):
            if rank is not None:
                into[name] = self.id_bytes[rank]
            elif len(word) > SHORT:
                into[name] = self.merge_one(word).tobytes()
            else:
                pair = waiting.get(WIDTHS[len(word)])
                if pair is None:
                    pair = waiting[WIDTHS[len(word)]] = ([], [])
                pair[0].append(name)
                pair[1].append(word)
        for width, (owners, raw) in waiting.items():
            for i in range(0, len(raw), MERGED):
                ids, counts = self.merge_many(raw[i : i + MERGED], width)
                ends = (4 * np.cumsum(counts)).tolist()
                into.update((name, ids[start:end]) for name, start, end in zip(owners[i : i + MERGED], [0, *ends[:-1]], ends, strict=True))

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as 32-bit numbers."""
        return next(self.encode_all([text or ""]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Token ids of each text, as 32-bit numbers; words are held for about ``SLICE_CHARS`` characters."""
        waiting: list[tuple[list[str], list[str]]] = []
        chars = 0
        for text in texts:
            waiting.append(self._words(text or ""))
            chars += len(text or "")
            if chars > SLICE_CHARS:
                yield from self._assemble(waiting)
                waiting, chars = [], 0
        yield from self._assemble(waiting)

    def _words(self, text: str) -> tuple[list[str], list[str]]:
        """Leading matches, and words that each stand for a space and the word.

        A single space between other characters always begins a match, so a text without two white
        spaces in a row may be cut there and its words be kept with their ids. Other texts are split
        as a whole.
        """
        if not self.by_space or not text or not _apart(text):
            return self.split(text), []
        words = text.split(" ")
        return self.split(words[0]), words[1:]

    def _assemble(self, waiting: list[tuple[list[str], list[str]]]) -> Iterator[bytes]:
        if self.cache_bytes > CACHE_BYTES:
            self.cache, self.cache_bytes = {}, 0
        if self.word_bytes > CACHE_BYTES:
            self.older, self.words, self.word_bytes = self.words, {}, 0
        known, older = self.words, self.older
        letters, marked, others = {}, [], {}
        for word in set().union(*(words for _, words in waiting)):
            if word in known:
                continue
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
                self.word_bytes += ENTRY_BYTES + 5 * len(word)
                continue
            # Letters are one match, with a mark after them two; the rest is left to the pattern.
            base = word[:-1] if word[-1] in MARKS else word
            if base.isalpha() and (base.isascii() or max(base) < UNUSUAL):
                if base not in known:
                    letters[base] = None
                if base is not word:
                    marked.append(word)
            else:
                others[word] = self.split(" " + word)
        if letters:
            names = list(letters)
            self.learn(names, [b" " + w for w in " ".join(names).encode().split(b" ")], known)
        for word in marked:
            known[word] = known[word[:-1]] + self.marks[word[-1]]
        cache = self.cache
        new = [p for p in set().union(*others.values(), *(first for first, _ in waiting)) if p not in cache]
        self.learn(new, [p.encode() for p in new], cache)
        for word, parts in others.items():
            known[word] = b"".join(map(cache.__getitem__, parts))
        fresh = len(letters) + len(marked) + len(others)
        self.word_bytes += ENTRY_BYTES * fresh + 5 * sum(map(len, itertools.chain(letters, marked, others)))
        self.cache_bytes += ENTRY_BYTES * len(new) + 5 * sum(map(len, new))
        first_ids, word_ids = cache.__getitem__, known.__getitem__
        for first, words in waiting:
            yield b"".join(map(first_ids, first)) + b"".join(map(word_ids, words))

    def decode(self, arrays: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each array of ids. The bytes of a batch are one gather of its tokens."""
        if arrays.null_count:
            arrays = pa.array([x or [] for x in arrays.to_pylist()], arrays.type)
        offsets = arrays.offsets.to_numpy().astype(np.int64)
        gathered = self.tokens.take(arrays.values.slice(offsets[0], offsets[-1] - offsets[0]))
        if gathered.null_count:
            raise ValueError("a token id is null")
        ends = np.frombuffer(gathered.buffers()[1], np.int64)[gathered.offset : gathered.offset + len(gathered) + 1]
        bounds = pa.array(ends[offsets - offsets[0]] if len(ends) else np.zeros(len(offsets), np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(arrays), [None, bounds.buffers()[1], gathered.buffers()[2]])


def _table(vocabulary: Broadcast, pattern: str) -> Ranks:
    """One table per worker, for as long as it encodes with this vocabulary; its word caches go with it."""
    key = (vocabulary.value, pattern)
    return held(key, lambda: Ranks(*key))


class BytePairs:
    """Encoder and decoder as column functions.

    ``path`` names a file of lines ``base64-token rank`` that the driver reads (under 1 MB for
    50,000 tokens; a vocabulary doesn't grow with the data) and broadcasts; ``pattern`` splits texts
    into the matches that are encoded separately. No special tokens: their strings are ordinary text.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self._vocabulary = spark.sparkContext.broadcast(file.read())
        self._pattern = pattern

    def encode(self, text: Column | str) -> Column:
        """``array<int>`` of a text's token ids; null and the empty text give an empty array."""
        vocabulary, pattern = self._vocabulary, self._pattern

        @F.arrow_udf(ArrayType(IntegerType()))
        def encode(texts: pa.Array) -> pa.Array:
            # One text at a time, and all ids in one buffer: a batch is never held twice.
            ids, offsets = bytearray(), [0]
            for own in _table(vocabulary, pattern).encode_all(t.as_py() for t in texts):
                ids += own
                offsets.append(len(ids) // 4)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))

        return encode(text)

    def _encode_and_decode(self, text: Column | str, kind: str, keep) -> Column:
        """``struct<ids, ...>`` with what ``keep`` makes of each text and its decoded ids.

        One function, so that a text is encoded once; it is decoded by itself, so that ids and bytes of a
        batch aren't held twice."""
        vocabulary, pattern = self._vocabulary, self._pattern

        @F.arrow_udf(f"ids array<int>, {kind}")
        def both(texts: pa.Array) -> pa.Array:
            table = _table(vocabulary, pattern)
            token = table.token.__getitem__
            ids, offsets, kept = bytearray(), [0], []
            for own, text in zip(table.encode_all(t.as_py() for t in texts), texts, strict=True):
                ids += own
                offsets.append(len(ids) // 4)
                kept.append(keep(text, b"".join(map(token, np.frombuffer(own, np.int32).tolist()))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            return pa.StructArray.from_arrays([lists, pa.array(kept, pa.bool_() if kind.endswith("boolean") else pa.binary())], ["ids", kind.split()[0]])

        return both(text)

    def encode_checked(self, text: Column | str) -> Column:
        """``struct<ids: array<int>, round_trip: boolean>``: token ids, and whether they decode to the text's bytes."""
        return self._encode_and_decode(text, "round_trip boolean", lambda text, decoded: decoded == (text.as_py() or "").encode())

    def encode_decoded(self, text: Column | str) -> Column:
        """``struct<ids: array<int>, decoded: binary>``: token ids, and the bytes that they decode to."""
        return self._encode_and_decode(text, "decoded binary", lambda _, decoded: decoded)

    def decode(self, ids: Column | str) -> Column:
        """The bytes of token ids; a null array gives no bytes. An id outside the vocabulary, or a null one, fails."""
        vocabulary, pattern = self._vocabulary, self._pattern

        @F.arrow_udf(BinaryType())
        def decode(arrays: pa.Array) -> pa.Array:
            return _table(vocabulary, pattern).decode(arrays).cast(pa.binary())

        return decode(ids)
