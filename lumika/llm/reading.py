"""Reading level of prose, by propagating graded difficulty over a document-word graph.

Readers' judgements clamp the difficulty of the documents they graded (basic 0, general 1, expert 2; the mean where they
disagree). In every harmonic round, until all words that a way through documents links to graded ones are reached and the words
settle, a word takes the mean difficulty of its reached documents, and a document the mean of its reached words, weighted by how closely each word's documents agree; an affine step, fitted on the graded documents, undoes the
shrinking that averaging causes. At the end each sentence is graded by its words, and the level that covers most of a
document's words is the document's, so that sentences of another level, quotations and clutter don't change it.

A word that only one document has takes that document's value and gives it back, so leaving it out changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.session import Scratch, materialize, release

LEVELS = ("basic", "general", "expert")
LEAST_WORDS = 30
#: Prose ends a sentence at least once in so many words; lists and metadata hardly ever do.
WORDS_PER_STOP = 100
#: Rounds end when no further word is reached and difficulties move by less than this on the mean, so many rounds after the last new word at the latest.
TOLERANCE, MOST_ROUNDS = 0.01, 30
#: Variance every word has besides its own, so that rare words don't count as certain.
BASE_VARIANCE = 0.02
#: Word tables up to so many rows are broadcast, 24 bytes a row; larger ones meet the documents by shuffle.
BROADCAST_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+").findall
_TERM = re.compile(r"[^\W\d_]+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+").split
_STOP = re.compile(r"[.!?…][\"”»)\]]*(?:\s|$)").findall


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sizes, counts, terms, fresh): per sentence its words and terms; terms of all sentences one after the other,
    fresh those that came first, so that fresh terms are the document's distinct ones."""
    codes: dict[str, int] = {}
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(_WORD(text))
            if n < LEAST_WORDS or len(_STOP(text)) * WORDS_PER_STOP < n:
                continue
            sizes, counts, terms = [], [], []
            for sentence in _SENTENCE(text):
                own = _TERM(sentence.casefold())
                if own:
                    kinds = dict.fromkeys(own)
                    for w in kinds:
                        if w not in codes:
                            codes[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - 2**63
                    sizes.append(len(own))
                    counts.append(len(kinds))
                    terms += [codes[w] for w in kinds]
            for column, value in zip(rows, (doc, sizes, counts, terms, list(dict.fromkeys(terms)))):
                column.append(value)
        if len(codes) > 500_000:
            codes.clear()
        if rows[0]:
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "sizes", "counts", "terms", "fresh"])


class Words:
    """Difficulty and weight of every word, looked up by its code."""

    def __init__(self, code: np.ndarray, value: np.ndarray, weight: np.ndarray):
        order = np.argsort(code)
        self.code, self.value, self.weight = code[order], value[order], weight[order]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(codes)), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        weight = np.where(self.code[at] == codes, self.weight[at], 0.0)
        return self.value[at], weight


def _weighted(values: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Weighted mean of each owner's values; not a number where it has no weight."""
    total = np.bincount(owner, weights, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(owner, weights * values, minlength=n) / total


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, list lengths) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _raw(column: pa.Array, words: Words) -> np.ndarray:
    flat, sizes = _lists(column)
    value, weight = words.find(flat)
    return _weighted(value, weight, np.repeat(np.arange(len(sizes)), sizes), len(sizes))


def _levels(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(raw), 0, 2)


class _Graph:
    """The tokenised documents and the two ways of visiting them: word tables by broadcast, or by shuffle."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession
        self.graded = docs.where("clamp is not null")

    def stats(self, scores: DataFrame | None, held, affine: tuple[float, float]) -> DataFrame:
        """(term, value, weight) of the words of two documents at least, one of which has a difficulty so far.

        A document that no grade has reached yet says nothing, rather than standing for the mean.
        """
        a, b = affine
        joined = scores is not None

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clamp = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                if joined:
                    own = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                else:
                    own = _raw(batch.column(1), held.value) if held is not None else np.full(len(batch), np.nan)
                own = np.where(np.isnan(clamp), np.clip(own * a + b, 0, 2), clamp)
                known = ~np.isnan(own)
                flat, sizes = _lists(batch.column(1))
                terms, at = np.unique(flat, return_inverse=True)
                s, m = np.repeat(np.where(known, own, 0.0), sizes), np.repeat(known.astype(float), sizes)
                columns = [terms, np.bincount(at, minlength=len(terms)).astype(np.int64), np.bincount(at, m, minlength=len(terms)).astype(np.int64), np.bincount(at, s, minlength=len(terms)), np.bincount(at, s * s, minlength=len(terms))]
                yield pa.record_batch([pa.array(c) for c in columns], names=["term", "n", "m", "s", "ss"])

        columns = ["clamp", "fresh"]
        source = self.docs
        if scores is not None:
            source, columns = source.join(scores, "doc_id", "left"), ["clamp", "fresh", "raw"]
        partial = source.select(*columns).mapInArrow(visit, "term long, n long, m long, s double, ss double")
        total = partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "m", "s", "ss"))).where("n >= 2 and m > 0")
        mean = F.col("s") / F.col("m")
        spread = F.greatest(F.lit(0.0), F.col("ss") / F.col("m") - mean * mean)
        return materialize(total.select("term", mean.alias("value"), (1 / (spread + BASE_VARIANCE)).alias("weight")))

    def hold(self, words: DataFrame):
        if words.count() > BROADCAST_WORDS:
            return None
        table = words.toPandas()
        return self.spark.sparkContext.broadcast(Words(table["term"].to_numpy(np.int64), table["value"].to_numpy(float), table["weight"].to_numpy(float)))

    def raw(self, words: DataFrame, of: DataFrame, term: str = "fresh") -> DataFrame:
        """(doc_id, raw) by shuffle."""
        each = of.select("doc_id", F.explode(term).alias("term")).join(words, "term")
        return each.groupBy("doc_id").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("raw"))

    def graded_raw(self, words: DataFrame, held) -> DataFrame:
        if held is None:
            return self.graded.select("doc_id", "clamp").join(self.raw(words, self.graded), "doc_id")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array(_raw(batch.column(1), held.value))], names=["clamp", "raw"])

        return self.graded.select("clamp", "fresh").mapInArrow(visit, "clamp double, raw double")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level): one row for each document of at least 30 words that is prose.

    `documents(doc_id, text)`, `labels(doc_id, reading_level, ...)`. Null, empty and short texts and lists have no row;
    repeated rows count once, levels are read without case and blanks, unknown ones are ignored. Texts are read whole,
    statistics cover all documents. A document that no way through words links to a graded one gets the graded documents' mean. Without any
    label there is no result.
    """
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    tokens = texts.mapInArrow(_tokens, "doc_id long, sizes array<int>, counts array<int>, terms array<long>, fresh array<long>")
    level = F.lower(F.trim("reading_level"))
    value = F.when(level == LEVELS[0], 0.0).when(level == LEVELS[1], 1.0).when(level == LEVELS[2], 2.0)
    votes = labels.distinct().select(F.col("doc_id").cast("long"), value.alias("v")).where("v is not null")
    clamps = votes.groupBy("doc_id").agg(F.avg("v").alias("clamp"))
    with Scratch() as made:
        docs = made.table(tokens.dropDuplicates(["doc_id"]).join(clamps, "doc_id", "left"))
        return materialize(_propagated(made, docs))


def _moved(before: DataFrame, after: DataFrame) -> float:
    """Mean distance of the words' difficulties in two rounds, by weight."""
    old = before.select("term", F.col("value").alias("old"))
    gap = F.sum(F.abs(F.col("value") - F.col("old")) * F.col("weight")) / F.sum("weight")
    return after.join(old, "term").agg(gap).first()[0] or 0.0


def _propagated(made: Scratch, docs: DataFrame) -> DataFrame:
    graph = _Graph(docs)
    first = graph.graded.agg(F.avg("clamp"), F.stddev_pop("clamp")).first()
    if first[0] is None:
        return graph.spark.createDataFrame([], "doc_id long, reading_level string")
    mean, spread = first
    words, grown, moved, rounds = graph.stats(None, None, (1.0, 0.0)), True, 1.0, 0
    while grown or (moved > TOLERANCE and rounds < MOST_ROUNDS):
        held = graph.hold(words)
        got = graph.graded_raw(words, held).where("not isnan(raw)").agg(F.avg("raw"), F.stddev_pop("raw")).first()
        slope = spread / got[1] if got[1] else 1.0
        affine = (slope, mean - slope * (got[0] or 0.0))
        scores = None if held is not None else graph.raw(words, docs)
        new = graph.stats(scores, held, affine)
        grown = new.count() > words.count()  # a word that was reached stays so
        moved, rounds = _moved(words, new), 0 if grown else rounds + 1
        release(words)
        words = new
        if held is not None:
            held.unpersist()
    made.keep(words)

    held = graph.hold(words)
    if held is None:
        # a text of numbers alone has no terms and no parts; it comes back with the join to all documents below
        where = F.when(F.size("sizes") > 0, F.sequence(F.lit(0), F.size("sizes") - 1))
        ends = F.transform(where, lambda i: F.struct(i.alias("i"), F.aggregate(F.slice("counts", 1, i), F.lit(0), lambda x, y: x + y).alias("at")))
        parts = docs.select("doc_id", F.explode(ends).alias("p"), "sizes", "counts", "terms")
        parts = parts.select(F.struct("doc_id", F.col("p.i").alias("i"), F.get("sizes", F.col("p.i")).alias("n")).alias("doc_id"), F.slice("terms", F.col("p.at") + 1, F.get("counts", F.col("p.i"))).alias("part"))
        graded = graph.raw(words, parts, "part").select("doc_id.doc_id", F.col("doc_id.n").alias("n"), F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.rint("raw"))).cast("int").alias("level"))
        best = graded.groupBy("doc_id", "level").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))
        best = docs.select("doc_id").join(best, "doc_id", "left").fillna({"level": int(_levels(np.array([mean]))[0])})
        return best.select("doc_id", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("reading_level"))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, many = _lists(batch.column(1))
            counts, _ = _lists(batch.column(2))
            terms, _ = _lists(batch.column(3))
            value, weight = held.value.find(terms)
            raw = _weighted(value, weight, np.repeat(np.arange(len(sizes)), counts), len(sizes))
            votes = np.zeros((len(batch), 3))
            owner, known = np.repeat(np.arange(len(many)), many), ~np.isnan(raw)
            np.add.at(votes, (owner[known], _levels(raw[known]).astype(int)), sizes[known])
            best = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), int(_levels(np.array([mean]))[0]))
            yield pa.record_batch([batch.column(0), pa.array([LEVELS[i] for i in best], pa.string())], names=["doc_id", "reading_level"])

    return docs.select("doc_id", "sizes", "counts", "terms").mapInArrow(grade, "doc_id long, reading_level string")
