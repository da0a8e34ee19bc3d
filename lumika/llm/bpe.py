"""Token ids of texts by a public byte-level BPE, with the merges done on whole matrices of words.

Texts are split by the tokenizer's pattern; the distinct words of a batch become rows of padded matrices, one for each
bucket of word lengths. In each round every row looks up the ranks of its adjacent pairs in a hash table, takes its
lowest rank and merges the leftmost pair that has it (and, as a merge can only make pairs of higher rank, the further
ones that don't overlap it). Rows without a pair left are done; the others are compacted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; another folder is given as a parameter or by this variable.
FOLDER = os.environ.get("LUMIKA_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the pattern by which byte-level BPE of this family splits a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
CELLS = 4_000_000
_NONE = np.int64(2**40)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> (rank, merged id) by open addressing; all lookups of an array run together."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 2.5 + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.int64).max, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int64)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == np.iinfo(np.int64).max
            _, lucky = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            lucky = lucky[free[lucky]]
            won = todo[lucky]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], won, merged[won]
            todo = np.delete(todo, lucky)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = ((left << 32) | right).ravel()
        at = self._slot(key)
        rank, merged = np.full(len(key), _NONE, np.int64), np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            here = self.keys[at[todo]]
            hit = here == key[todo]
            done = todo[hit]
            rank[done], merged[done] = self.rank[at[done]], self.merged[at[done]]
            todo = todo[~hit & (here != np.iinfo(np.int64).max)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rank.reshape(left.shape), merged.reshape(left.shape)


class Encoder:
    """One vocabulary, loaded once in each worker."""

    def __init__(self, folder: str = FOLDER, name: str = NAME):
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        # printable bytes stand for themselves in the file, the others for characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.byte_ids = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, np.ndarray] = {}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for size in np.unique(bucket):
            members = np.flatnonzero(bucket == size)
            width = int(lengths[members].max())
            for rows in np.array_split(members, max(1, len(members) * width // CELLS)):
                flat = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)
                ids = np.full((len(rows), width), -1, np.int64)
                ids[np.arange(width) < lengths[rows, None]] = self.byte_ids[flat]
                for row, found in zip(rows, self._merge(ids)):
                    out[row] = found
        return out

    def _merge(self, ids: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(ids)
        alive = np.arange(len(ids))
        while len(alive):
            if ids.shape[1] > 1:
                rank, merged = self.table.find(np.where(ids[:, :-1] < 0, 2**31 - 1, ids[:, :-1]), np.where(ids[:, 1:] < 0, 2**31 - 1, ids[:, 1:]))
                least = rank.min(axis=1)
            else:
                least = np.full(len(ids), _NONE)
            rest = least < _NONE
            for i in np.flatnonzero(~rest):
                done[alive[i]] = ids[i][ids[i] >= 0].astype(np.int32)
            if not rest.any():
                break
            alive, ids, rank, merged, least = alive[rest], ids[rest], rank[rest], merged[rest], least[rest]
            hit = rank == least[:, None]
            # of pairs that overlap in a run, every other one merges, from the left
            position = np.arange(hit.shape[1])
            before = np.maximum.accumulate(np.where(hit, -1, position), axis=1)
            hit &= (position - before) % 2 == 1
            ids[:, :-1] = np.where(hit, merged, ids[:, :-1])
            gone = np.zeros(ids.shape, bool)
            gone[:, 1:] = hit
            keep = ~gone & (ids >= 0)
            count = keep.sum(axis=1)
            tight = np.full((len(ids), int(count.max())), -1, np.int64)
            tight[np.arange(tight.shape[1]) < count[:, None]] = ids[keep]
            ids = tight
        return done

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts give the empty list."""
        split = [self.words(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.cache})
        fresh = dict(zip(new, self.encode_words(new)))
        known = self.cache
        out = [np.concatenate([fresh[w] if w in fresh else known[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in split]
        if len(known) + len(fresh) > CACHE:  # words seen before are only kept, never needed
            known.clear()
        known.update((w, i) for w, i in fresh.items() if len(w) <= 32)
        if len(known) > CACHE:
            known.clear()
        return out


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = FOLDER, name: str = NAME) -> Encoder:
    if (folder, name) not in _LOADED:
        _LOADED[folder, name] = Encoder(folder, name)
    return _LOADED[folder, name]


def encode(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME, rows: int = 512) -> DataFrame:
    """(key, ids array<int>): the ids of each text, without special tokens; their strings in a text are ordinary text.

    A null and an empty text give the empty list. Texts of any length are encoded whole. One row comes out for each row
    that goes in; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.slice(start, rows)
                ids = own.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
