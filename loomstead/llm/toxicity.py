"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index; their weighted votes are the score.

The index holds a bounded sample of labelled documents (``EXAMPLES``), in order of their ids, and of their terms (words,
and their first ``STEMS`` bytes, which stand for inflected forms) those that tell most about the label by chi-square: of the
sample's whole vocabulary at most the largest of ``TERMS``. How many, whether stems are among them and how many neighbours
vote is chosen by the log loss on a quarter of the sample; near copies of earlier examples are left out first, or else every
word of a much-copied text would seem to tell something. Examples stand in
blocks of ``BLOCK``; a term's postings have, for each block, the largest weight in it. The sum of those, over a document's
terms, bounds every cosine in the block, so blocks are scored in the order of their bounds until no bound reaches the k-th
best cosine: the neighbours by the indexed terms are exact, ties going to the smaller id. A vote weighs its squared cosine; a
small prior weight carries the share of label 1, which is all that a document without any indexed term gets (its own share).

Defined cases: null and empty texts have no indexed term; without labels, or with one class only, the score is the smoothed
share of label 1. Repeated rows score alike. Extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, learn_from
from .near_dup import super_minhash
from .runtime import need, ship, table
from .text import NO_LETTER, U, pieces, stems, utf8

EXAMPLES = 5000
#: Numbers of neighbours to choose from.
NEIGHBOURS = (5, 9, 17)
STEMS = (4, 5, 6, 7, 8)
TERMS = (8, 16, 32, 64, 128, 256, 512)
BLOCK = 64
PRIOR = 0.1
_BITS = 16


def term_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the texts' words, and the row of each: every word (an even number), and every stem shorter than its word (an odd one)."""
    (whole, *short), woff, _ = stems(*utf8(column), STEMS, NO_LETTER)
    row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    cut = [h != whole for h in short]
    return np.concatenate([whole & ~U(1), *(h[c] | U(1) for h, c in zip(short, cut, strict=True))]), np.concatenate([row, *(row[c] for c in cut)])


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, count) of each text's distinct terms, flat, with the texts' offsets."""
    terms, row = term_rows(column)
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (row[1:] != row[:-1]))) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.diff(np.append(first, len(terms))), np.searchsorted(row[first], np.arange(len(column) + 1))


def first_copies(terms: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows are no near copy of an earlier row: four equal slots in a row of a signature of 32 count as one."""
    signature = super_minhash(terms, off, 32)
    kept, seen = np.ones(len(off) - 1, bool), set()
    for r in np.flatnonzero(np.diff(off)):
        bands = [(b, *signature[r, b : b + 4].tolist()) for b in range(0, 32, 4)]
        kept[r] = seen.isdisjoint(bands)
        if kept[r]:
            seen.update(bands)
    return kept


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    examples: np.ndarray  # by example and term, rows of length 1 (or 0)
    ids: np.ndarray
    label: np.ndarray
    most: np.ndarray  # by term and block: the largest weight
    share: float
    share_without: float
    votes: int = NEIGHBOURS[-1]

    def vectors(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        x = np.zeros((rows, len(self.terms)), np.float32)
        x[row, term] = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
        return (x / np.where(length, length, 1)).astype(np.float32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the ``k`` nearest examples of each row, nearest first; -1 and 0 where there are fewer with a common term."""
        n = len(x)
        best, place = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        bound = x @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(n)
        for step in range(bound.shape[1]):
            block = order[live, step]
            ahead = bound[live, block] + 1e-5
            go = (ahead > 1e-4) & (ahead >= best[live, -1])
            live, block = live[go], block[go]
            if not len(live):
                break
            for b in np.unique(block):
                rows = live[block == b]
                a = b * BLOCK
                cos = np.round((x[rows] @ self.examples[a : a + BLOCK].T).astype(np.float64), 5)
                own = np.where(cos > 0, np.arange(a, a + cos.shape[1]), -1)
                both, names = np.hstack([best[rows], cos]), np.hstack([place[rows], own])
                names_at = np.where(names < 0, np.iinfo(np.int64).max, names)
                top = np.lexsort((names_at, -both), axis=1)[:, :k]
                best[rows], place[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        return place, best

    def voted(self, some: np.ndarray, place: np.ndarray, best: np.ndarray, votes: int, rows: int) -> np.ndarray:
        """The scores of ``rows`` rows, of which ``some`` have neighbours, by their first ``votes``."""
        out = np.full(rows, self.share_without)
        weight = best[:, :votes] ** 2
        out[some] = ((weight * self.label[place[:, :votes]]).sum(1) + PRIOR * self.share) / (weight.sum(1) + PRIOR)
        return out

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's score, and its neighbours and their cosines as evidence."""
        place, best = np.full((len(x), self.votes), -1, np.int64), np.zeros((len(x), self.votes))
        some = np.flatnonzero(x.any(1)) if len(self.ids) else np.zeros(0, np.int64)
        if len(some):
            place[some], best[some] = self.nearest(x[some], self.votes)
        return self.voted(some, place[some], best[some], self.votes, len(x)), place, best


def build(row: np.ndarray, term: np.ndarray, count: np.ndarray, ids: np.ndarray, label: np.ndarray, most_terms: int) -> Index:
    """An index of the examples ``ids`` with the ``most_terms`` terms that tell most about ``label``."""
    n, yes = len(ids), float(label.sum())
    known, at = np.unique(term, return_inverse=True)
    df, hits = np.bincount(at, minlength=len(known)), np.bincount(at, label[row], len(known))
    expected = df * yes / max(n, 1)
    told = (hits - expected) ** 2 / np.maximum(expected * (1 - df / max(n, 1)) * (1 - yes / max(n, 1)), 1e-9)
    told[(df < 3) | (df == n) | (yes == 0) | (yes == n)] = 0
    picked = np.sort(np.lexsort((known, -told))[:most_terms])
    picked = picked[told[picked] > 0]
    index = Index(known[picked], np.log((n + 1) / (df[picked] + 1)) + 1, np.zeros((0, len(picked)), np.float32), ids, label, np.zeros((len(picked), 0)), (yes + 1) / (n + 2), 0.0)
    place = np.full(len(known), -1)
    place[picked] = np.arange(len(picked))
    keep = place[at] >= 0
    index.examples = index.vectors(row[keep], place[at[keep]], count[keep], n)
    starts = np.arange(0, n, BLOCK)
    index.most = np.maximum.reduceat(index.examples, starts, axis=0).T if n and len(picked) else np.zeros((len(picked), len(starts)), np.float32)
    without = ~index.examples.any(1)
    index.share_without = (label[without].sum() + 1) / (without.sum() + 2)
    return index


def learn(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Index:
    """An index for ``labels.toxic`` over at most ``most`` of ``docs`` (id, text)."""

    def counted(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                t, n, off = term_counts(part.column("text"))
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v)) for v in (t.view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("label"), *lists], ["id", "label", "term", "count"])

    got = learn_from(docs, labels, "toxic", most).mapInArrow(counted, "id long, label int, term array<long>, count array<int>").toArrow().sort_by("id")
    ids, label = got.column("id").to_numpy(), got.column("label").to_numpy().astype(float)
    row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(got.column("term")).to_numpy())
    term = got.column("term").combine_chunks().flatten().to_numpy().view(U)
    count = got.column("count").combine_chunks().flatten().to_numpy()
    kept = first_copies(term, np.searchsorted(row, np.arange(len(ids) + 1)))
    own = kept[row]
    row, term, count, ids, label = (np.cumsum(kept) - 1)[row[own]], term[own], count[own], ids[kept], label[kept]
    trial = np.arange(len(ids)) % 4 == 0
    losses = {}
    for with_stems in (True, False):
        usable = np.ones(len(term), bool) if with_stems else term & U(1) == 0
        for terms in TERMS:
            own = usable & ~trial[row]
            index = build(np.cumsum(~trial)[row[own]] - 1, term[own], count[own], ids[~trial], label[~trial], terms)
            seat = np.searchsorted(index.terms, term)
            keep = trial[row] & (index.terms[np.minimum(seat, len(index.terms) - 1)] == term) if len(index.terms) else np.zeros(len(row), bool)
            x = index.vectors(np.cumsum(trial)[row[keep]] - 1, seat[keep], count[keep], int(trial.sum()))
            some = np.flatnonzero(x.any(1))
            place, best = index.nearest(x[some], NEIGHBOURS[-1]) if len(some) else (np.zeros((0, 1), np.int64), np.zeros((0, 1)))
            for votes in NEIGHBOURS:
                p = np.clip(index.voted(some, place, best, votes, len(x)), 1e-3, 1 - 1e-3)
                losses[with_stems, terms, votes] = -np.mean(np.where(label[trial] > 0, np.log(p), np.log(1 - p))) if len(p) else 0.0
    with_stems, terms, votes = min(losses, key=losses.get)
    usable = np.ones(len(term), bool) if with_stems else term & U(1) == 0
    index = build(row[usable], term[usable], count[usable], ids, label, terms)
    index.votes = votes
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(id, score, evidence) of every row of ``docs`` (id, text); evidence: the neighbours' ids, cosines and labels, nearest first."""
    low = np.zeros(1 << _BITS, bool)
    low[index.terms >> U(64 - _BITS)] = True
    kind = docs.schema["id"].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                h, of = term_rows(part.column("text"))
                n = part.num_rows
                near = np.flatnonzero(low[h >> U(64 - _BITS)])
                seat = np.searchsorted(index.terms, h[near])
                hit = index.terms[np.minimum(seat, len(index.terms) - 1)] == h[near] if len(index.terms) else np.zeros(len(near), bool)
                row = of[near[hit]]
                cell, count = np.unique(row * max(1, len(index.terms)) + seat[hit], return_counts=True)
                s, place, best = index.score(index.vectors(*np.divmod(cell, max(1, len(index.terms))), count, n))
                used = place >= 0
                off = pa.array(np.concatenate([[0], np.cumsum(used.sum(1))]), pa.int32())
                at = place[used]
                fields = [index.ids[at], best[used], index.label[at].astype(np.int32)]
                evidence = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(v) for v in fields], ["doc_id", "cosine", "label"]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s), evidence], ["id", "score", "evidence"])

    return docs.select("id", "text").mapInArrow(scored, f"id {kind}, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = need(table(spark, sf_dir, "documents"), id="doc_id", text="text")
    scores = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
