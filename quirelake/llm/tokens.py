"""Texts to token ids under a public byte-level BPE, in padded numpy matrices.

A text is split by the tokenizer's pattern. The distinct parts of a batch are put into buckets by length, each bucket a
padded matrix of ids. In every round each row merges its leftmost pair of the lowest rank; ranks of pairs come from a
hashed table, only the two pairs beside a merge are looked up again, and rows without a pair left are taken out. Parts
longer than LONGEST bytes (a long run of one kind of character) are merged with a linked list and a heap instead: the
same merges in the same order.

Defined cases: an empty or null text gives an empty list; strings of special tokens are ordinary text; unpaired
surrogates become U+FFFD; whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("QUIRELAKE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
LONGEST = 64
CACHE = 400_000


class Bpe:
    """Byte-level BPE over a rank file: base64 bytes and rank on each line."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, ids = [], []
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 20) | b)
                    ids.append(rank)
        self._hash(np.array(pairs, np.int64), np.array(ids, np.int32))
        self.cache: dict[str, list[int]] = {}

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ids = np.full(1 << bits, NONE, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ids[at[put]] = keys[todo[put]], ids[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge; a negative id is no token."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = (a.ravel()[todo].astype(np.int64) << 20) | b.ravel()[todo]
        slot = self._slot(keys)
        flat = out.ravel()
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.ids[slot[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return flat.reshape(a.shape)

    def matrix(self, m: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Merges the rows of a padded matrix (-1 beyond the size)."""
        result: list = [None] * len(m)
        row = np.arange(len(m))
        r = self.pair(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 1), NONE, np.int32)
        while len(row):
            at = r.argmin(axis=1)  # the leftmost of the lowest
            rank = r[np.arange(len(r)), at]
            done = rank == NONE
            for i in np.flatnonzero(done):
                result[row[i]] = m[i, : size[i]].tolist()
            if done.all():
                break
            keep = ~done
            row, m, r, size, at, rank = row[keep], m[keep], r[keep], size[keep] - 1, at[keep], rank[keep]
            n, width = m.shape
            here = np.arange(width)[None, :]
            m = np.take_along_axis(m, np.minimum(here + (here > at[:, None]), width - 1), axis=1)
            k = np.arange(n)
            m[k, at] = rank
            m[here >= size[:, None]] = -1
            cols = np.arange(width - 1)[None, :]
            r = np.take_along_axis(r, np.minimum(cols + (cols >= at[:, None]), width - 2), axis=1)
            r[cols >= (size - 1)[:, None]] = NONE
            right = at < width - 1
            r[k[right], at[right]] = self.pair(m[k[right], at[right]], m[k[right], at[right] + 1])
            left = at > 0
            r[k[left], at[left] - 1] = self.pair(m[k[left], at[left] - 1], m[k[left], at[left]])
            width = max(2, int(size.max()))
            m, r = m[:, :width], r[:, : width - 1]
        return result

    def long(self, word: bytes) -> list[int]:
        """One long part: the same merges by a linked list and a heap."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = [word[i : i + 1] for i in range(n)]
        rank = self.ranks.get
        heap = [(x, i, 1, 1) for i in range(n - 1) if (x := rank(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x, i, la, lb = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or len(text[i]) != la or len(text[j]) != lb or rank(text[i] + text[j]) != x:
                continue
            text[i], ids[i], ids[j] = text[i] + text[j], x, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (y := rank(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (y, i, len(text[i]), len(text[after[i]])))
            if before[i] >= 0 and (y := rank(text[before[i]] + text[i])) is not None:
                heapq.heappush(heap, (y, before[i], len(text[before[i]]), len(text[i])))
        return [x for x in ids if x >= 0]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct parts, by buckets of lengths."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = 2
        low = 0
        while low < LONGEST:
            at = np.flatnonzero((size > low) & (size <= width))
            for part in np.array_split(at, max(1, len(at) * width // 2_000_000)):
                if not len(part):
                    continue
                m = np.full((len(part), width), -1, np.int32)
                fill = np.arange(width)[None, :] < size[part][:, None]
                m[fill] = self.byte_id[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
                for i, ids in zip(part, self.matrix(m, size[part].copy())):
                    out[i] = ids
            low, width = width, width * 2 if width >= 8 else width + 2
        for i in np.flatnonzero(size > LONGEST):
            out[i] = self.long(words[i])
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list({w for p in parts for w in p if w not in cache})
        for w, ids in zip(new, self.words([w.encode("utf-8", "replace") for w in new])):
            cache[w] = ids
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += cache[w]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Bpe:
    return Bpe(path)


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens)."""
    kind = dict(df.dtypes)[id_col]
    name, spark_type = ("n_tokens", "int") if counts_only else ("ids", "array<int>")

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 2000):
                ids = bpe.encode(texts.slice(lo, 2000).to_pylist())
                got = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2000), got], [id_col, name])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {name} {spark_type}")
