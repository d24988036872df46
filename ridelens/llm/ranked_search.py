"""Ranked lexical search over a length-stratified index.

1. ``build_index``: one pass over the texts gives every document its length n and its terms with their counts,
   written in the order of n. The normaliser m grows with n, so a segment of the index (a run of rows) holds few
   strata (documents of equal m), and a large stratum is cut over many segments.
2. Only terms that some item asks for are of use to a search: the index for a set of items keeps those whose hash
   passes a bitmap of fixed size. What passes by chance meets no item term and is dropped.
3. Weights come from document frequencies over the whole index, an aggregate.
4. ``search``: within a segment, postings are sorted by term, stratum and count; the impact of a (stratum, count)
   run is computed once and shared by its postings. An item's bound of a stratum is the sum of its terms' weights
   times their largest impact there. Strata are visited by falling bound until the next bound is below the
   score of the last place; each segment returns an item's ``top`` best, merged by a window.

Items go in blocks of about ``ITEM_TERMS`` (item, term) rows, each block a pass over the index, so what a task
gets of the items is bounded. A segment has at most ``POSTINGS`` postings (or one document's).

Defined cases: null or empty texts and texts without a term are in no stratum and in no result; repeated rows are
documents of their own; documents with a null id rank after others of equal score; rows of one item id (null is
one) are one item with all their terms; empty tables give no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.bits import bit_filter, passes
from ridelens.llm.common import stage
from ridelens.llm.textnum import prefix, ragged, release, slices

TOP = 50
FILTER_BITS = 22
ITEM_TERMS = 1 << 18
POSTINGS = 1 << 21
#: bytes that are no part of a term
GAPS = np.ones(256, dtype=bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(rows: DataFrame, id_col: str, text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """(id, n, terms, counts) of every row with a term: n counts all its terms; of the distinct ones, those in the
    filter ``wanted`` (None: all) are listed by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, t in slices(batch.column(1), lower=True, gaps=GAPS):
                n = np.diff(t.first)
                kept = np.arange(len(t.hash)) if wanted is None else np.flatnonzero(passes(wanted, t.hash))
                order = kept[np.lexsort((t.hash[kept], t.doc[kept]))]
                doc, term = t.doc[order], t.hash[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(order) else order
                counts = np.diff(np.append(new, len(order)))
                some = np.flatnonzero(n)
                bounds = pa.array(np.append(np.searchsorted(doc[new], some), len(new)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at).take(pa.array(some)), pa.array(n[some], pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(term[new].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32()))],
                    names=["id", "n", "terms", "counts"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, terms array<long>, counts array<int>")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    return stage(term_counts(items, id_col, text_col).select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct(), "item-terms")


def build_index(docs: DataFrame, wanted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: (id, n, terms, counts) in the order of n. ``wanted``: a filter of terms; None keeps all."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = term_counts(docs, id_col, text_col, wanted)
    return stage(rows.repartitionByRange(parts, F.col("n"), F.xxhash64("id")).sortWithinPartitions("n"), "index")


def term_weights(index: DataFrame, asked: DataFrame, documents: int) -> DataFrame:
    """(item_id, term, w) of the asked terms that some document has."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2) * F.lit(documents) + 2).cast("double") / (F.lit(2) * F.col("df") + 1).cast("double")))
    return stage(asked.join(df, "term").select("item_id", "term", w.cast("long").alias("w")), "item-weights")


class Segment:
    """Postings of a run of documents by term, stratum and falling count; impacts once per (stratum, count)."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, asked: np.ndarray, documents: int, length: int):
        lengths, which = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * x * documents // length for x in lengths.tolist()], dtype=np.int64)[which]
        strata, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(n)), sizes)
        term = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
        kept = asked[term] == terms
        doc, term, counts = doc[kept], term[kept], counts[kept].astype(np.int64)
        order = np.lexsort((-counts, stratum[doc], term))
        self.doc, term, counts = doc[order], term[order], counts[order]
        where = stratum[self.doc]
        change = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(term) else np.zeros(0, dtype=np.int64)
        runs = change(term, where, counts)
        self.impact = np.repeat(1_000_000_000 * counts[runs] // (1000 * counts[runs] + 20 * strata[where[runs]]), np.diff(np.append(runs, len(term))))
        lists = change(term, where)  # one list per term and stratum
        self.starts, self.sizes, self.strata = lists, np.diff(np.append(lists, len(term))), where[lists]
        self.best = self.impact[lists]  # the largest count comes first
        self.of_term = np.searchsorted(term[lists], np.arange(len(asked) + 1))
        self.n_docs, self.n_strata = len(n), len(strata)

    def search(self, terms: np.ndarray, w: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents that may be among the ``top``, their scores, visited strata)."""
        count = self.of_term[terms + 1] - self.of_term[terms]
        lists, weight = ragged(self.of_term[terms], count), np.repeat(w, count)
        bound = np.zeros(self.n_strata, dtype=np.int64)
        np.add.at(bound, self.strata[lists], weight * self.best[lists])
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        place = np.empty(self.n_strata, dtype=np.int64)
        place[visits] = np.arange(len(visits))
        positive = bound[self.strata[lists]] > 0
        lists, weight = lists[positive], weight[positive]
        order = np.argsort(place[self.strata[lists]], kind="stable")
        lists, weight = lists[order], weight[order]
        at_visit = np.searchsorted(place[self.strata[lists]], np.arange(len(visits) + 1))
        score = np.zeros(self.n_docs, dtype=np.int64)
        last, done, step = 0, 0, 1
        while done < len(visits) and bound[visits[done]] >= max(last, 1):
            to = min(len(visits), done + step)
            some = slice(at_visit[done], at_visit[to])
            postings = ragged(self.starts[lists[some]], self.sizes[lists[some]])
            np.add.at(score, self.doc[postings], self.impact[postings] * np.repeat(weight[some], self.sizes[lists[some]]))
            if self.n_docs >= top:
                last = int(np.partition(score, self.n_docs - top)[self.n_docs - top])
            done, step = to, step * 2
        found = np.flatnonzero(score >= max(last, 1))
        return found, score[found], done


def _search_block(index: DataFrame, block: pa.Table, documents: int, length: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best of every segment for the items of one block."""
    items = block.column("item_id").combine_chunks()
    asked, term = np.unique(block.column("term").to_numpy().view(np.uint64), return_inverse=True)
    w = block.column("w").to_numpy()
    codes = items.dictionary_encode(null_encoding="encode")
    order = np.argsort(codes.indices.to_numpy(), kind="stable")
    cuts = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(codes.dictionary) + 1))
    names, term, w = codes.dictionary.to_pylist(), term[order], w[order]

    def evaluate(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: pc.list_flatten(rows.column(c)).to_numpy()
        sizes = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
        segment = Segment(rows.column("n").to_numpy(), sizes, flat("terms").view(np.uint64), flat("counts"), asked, documents, length)
        ids = rows.column("id")
        void = ids.is_null().to_numpy()
        keys = ids.fill_null(0).to_numpy()
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for a, b in zip(cuts, cuts[1:]):
            docs, score, _ = segment.search(term[a:b], w[a:b], top)
            best = np.lexsort((keys[docs], void[docs], -score))[:top]
            found.append(docs[best])
            scores.append(score[best])
        item = pa.array([name for name, some in zip(names, found) for _ in range(len(some))], pa.int64())
        return pa.RecordBatch.from_arrays([item, ids.take(pa.array(np.concatenate(found))).combine_chunks(), pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            upto = prefix(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + POSTINGS - size, "right")) - 1)
                held.append(batch.slice(at, to - at))
                size += int(upto[to] - upto[at])
                at = to
                if size >= POSTINGS or at < batch.num_rows:
                    yield evaluate(held)
                    held, size = [], 0
        if held:
            yield evaluate(held)
        release()

    return index.select("id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of the index for every item of ``asked`` (item_id, term)."""
    size = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    weights = term_weights(index, asked, size["documents"])
    blocks = max(1, math.ceil(weights.count() / ITEM_TERMS))
    found = None
    for b in range(blocks):
        block = weights.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            part = _search_block(index, block, size["documents"], size["length"], top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Ranks all of ``docs`` (doc_id, text) for every one of ``items`` (item_id, text)."""
    asked = item_terms(items)
    return search(build_index(docs, bit_filter(asked, "term", FILTER_BITS)), asked, top)
