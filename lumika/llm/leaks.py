"""Test passages in a corpus, by greedy string tiling.

Windows of `least` words are hashed by Karp-Rabin, on both sides in a scan of its own. A bitmap of the test items'
hashes, of fixed size, keeps nearly all of the corpus's windows out of the join by hash that finds the seeds: positions
of a common window in a document and an item. A maximal run of seeds on one diagonal is a common run of words, so tiles
grow from the seeds alone: the longest common run whose words are in no earlier tile becomes a tile, until none of
`least` words is left. As tiles need not keep the item's order, passages that were moved around still add up to the
item's coverage. Neither the corpus nor the items are ever gathered in one place, and the corpus is read once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize

_WORDS = re.compile(r"[^\W_]+").findall
#: Odd multipliers of the two hashes of a window; both must agree.
_BASES = (0x100000001B3, 0x9E3779B97F4A7C15)
#: Bits of the bitmap of item windows: 8 MB, whatever the number of items.
FILTER_BITS = 26
_CODES = 500_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return _WORDS(text.casefold()) if text else []


class Coder:
    """64-bit codes of words, remembered while there are not too many."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        if len(self.known) > _CODES:
            self.known.clear()
        known, out = self.known, []
        for w in words(text):
            code = known.get(w)
            if code is None:
                code = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(code)
        return np.array(out, np.uint64)


def window_hashes(codes: np.ndarray, least: int, base: int = _BASES[0]) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `least` words."""
    n = len(codes) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(least):
        total = total * np.uint64(base) + codes[k : k + n]
    return total


def tiles(seeds_a: np.ndarray, seeds_b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles, longest first; the seeds are the starts of all common windows of `least` words."""
    order = np.lexsort((seeds_b, seeds_a - seeds_b))
    i, j = seeds_a[order], seeds_b[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)]) if len(i) else np.zeros(0, np.int64)
    runs = [(int(e - s) + least - 1, int(i[s]), int(j[s])) for s, e in zip(heads, np.r_[heads[1:], len(i)])]
    free_a, free_b = np.ones(int(i.max(initial=0)) + least, bool), np.ones(int(j.max(initial=0)) + least, bool)
    found: list[tuple[int, int, int]] = []
    heap = [(-n, a, b) for n, a, b in runs]  # longest first, then the earliest in the document, then in the item
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        open_ = np.r_[False, free_a[a : a - n] & free_b[b : b - n], False]
        if open_[1:-1].all():
            free_a[a : a - n], free_b[b : b - n] = False, False
            found.append((a, b, -n))
            continue
        change = np.flatnonzero(open_[1:] != open_[:-1])
        for s, t in zip(change[::2].tolist(), change[1::2].tolist()):
            if t - s >= least:
                heapq.heappush(heap, (s - t, a + s, b + s))
    return found


def _windows(texts: DataFrame, key: str, least: int, held=None) -> DataFrame:
    """(h, check, key, at, n): hashes of the windows of each text, their place and the text's words; those the bitmap lets through."""
    names = ["h", "check", key, "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bitmap = Coder(), None if held is None else held.value
        for batch in batches:
            got = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = coder(text)
                h = window_hashes(codes, least)
                if not len(h):
                    continue
                at = np.arange(len(h))
                if bitmap is not None:
                    slot = h >> np.uint64(64 - FILTER_BITS)
                    at = np.flatnonzero((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if not len(at):
                        continue
                check = window_hashes(codes, least, _BASES[1])[at]
                got.append((h[at].view(np.int64), check.view(np.int64), np.full(len(at), doc), at.astype(np.int32), np.full(len(at), len(codes), np.int32)))
            if got:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*got)], names=names)

    return texts.mapInArrow(run, f"h long, check long, {key} long, at int, n int")


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id, shared_words, longest_tile, item_words) of each document and item with a common run of `least` words.

    `documents(doc_id, text)`, `items(item_id, text)`. Null, empty and short texts have no run; rows without an id are left
    out; repeated rows count once; texts are read whole; empty tables give none. A window that very many documents or
    items hold is split in the join.
    """
    spark = documents.sparkSession
    texts = lambda df, key: df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias(key), "text")
    with Scratch() as made:
        asked = made.table(_windows(texts(items, "item_id"), "item_id", least).distinct())
        slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        marks = asked.select(F.shiftrightunsigned(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(bitmap)
        seen = made.table(_windows(texts(documents, "doc_id"), "doc_id", least, held).distinct())
        both = ["h", "check"]
        right = asked.select(*both, "item_id", F.col("at").alias("item_at"), F.col("n").alias("item_words"))
        seeds = split_join(seen.select(*both, "doc_id", "at"), right, both, rows=seen.count())
        pairs = seeds.groupBy("doc_id", "item_id", "item_words").agg(F.collect_list("at").alias("i"), F.collect_list("item_at").alias("j"))

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got: list[list[int]] = [[], []]
                for i, j in zip(batch.column(3), batch.column(4)):
                    found = tiles(i.values.to_numpy().astype(np.int64), j.values.to_numpy().astype(np.int64), least)
                    got[0].append(sum(n for *_, n in found))
                    got[1].append(found[0][2])
                columns = [batch.column(0), batch.column(1), pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), batch.column(2)]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "shared_words", "longest_tile", "item_words"])

        schema = "doc_id long, item_id long, shared_words int, longest_tile int, item_words int"
        return materialize(pairs.select("doc_id", "item_id", "item_words", "i", "j").mapInArrow(tile, schema))
