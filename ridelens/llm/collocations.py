"""Phrase collocations by stripes.

A stripe is (lang, prefix) -> {next word: count}; the empty prefix holds single words. A task counts the windows of
1 to 5 words of its texts and sends one row per prefix with parallel arrays of next words and counts, so the prefix
travels once and hot prefixes are pre-aggregated. A stripe is cut by the next word's hash into pieces that go to
different tasks; equal pieces are merged element by element. From the merged stripes come

* extensions: the entries with f >= ``least`` are the frequent phrases;
* prefix totals: n is the sum of the empty prefix's stripe, which counts the words that no entry holds under the next
  word ""; the total of any other prefix is its last word's entry in the stripe one word shorter (its occurrences at
  the end of a piece included);
* subsumption maxima: an entry (prefix, next) has f(longer) for its prefix (by stripe) and for its words
  without the first (by entry); longer phrases contain one of k + 1 words that is at least as frequent.

Most windows are rare, and rare ones need not travel. Two passes before count windows by hash into a table of at
most 2**26 counters (a byte each, that stops at 255; sent as compressed ranges and added up): first words, then
windows whose words may all be frequent. A window becomes an entry only if it and its parts lie in counters of
``least`` or more. A counter is never less than a window's count, so no frequent phrase is lost; what passes by
chance falls at the exact threshold. The tables' size follows the text up to its bound, so what goes to every task
is bounded.

Defined cases: null texts are empty; a null lang is ``und``; repeated rows count each; an empty table gives no
rows; phrases are compared by their words, not by hashes (within the ``HELD`` entries that a task holds, windows
are told apart by 64-bit hashes).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.bits import passes
from ridelens.llm.common import stage
from ridelens.llm.textnum import GRAM_BASE, U64, Texts, mix, prefix, ragged, release, slices, span_hash

LEAST, LONGEST, PERCENT, TOP = 100, 5, 100, 2000
SLICE_BYTES = 1 << 21
#: entries that a task holds before it sends its stripes
HELD = 1 << 20
#: a table of counters: windows a counter in the mean, least and most bits of its number, counters of one row
LOAD, LEAST_BITS, MOST_BITS, RANGE = 32, 15, 26, 1 << 18
#: bytes of text that a task counts before it sends, where the cluster's cores have as much each
TASK_TEXT = 64 << 20
#: pieces of the stripe of the empty prefix, and of any other
PIECES_OF_WORDS, PIECES = 4096, 16
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAK.copy()
GAPS[[0x20, 0x09]] = True
REST = ""


def lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Windows:
    """The words of a slice, numbered through, with the windows that lie inside one piece."""

    def __init__(self, t: Texts, langs: np.ndarray):
        self.t, self.n = t, len(t.hash)
        piece = prefix(BREAK[t.data])[t.start]
        same = (piece[1:] == piece[:-1]) & (t.doc[1:] == t.doc[:-1]) if self.n else np.zeros(0, dtype=bool)
        self.follows = np.append(same, False)  # the next word is in the same piece
        self.run = np.zeros(self.n, dtype=np.int64)  # words from here to the end of the piece
        ends = np.flatnonzero(~self.follows)
        self.run = ends[np.searchsorted(ends, np.arange(self.n))] - np.arange(self.n) + 1 if self.n else self.run
        self.lang = langs[t.doc]

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the k words from each of ``at``, with their language."""
        return mix(span_hash(self.t.hash, GRAM_BASE, at, at + k) ^ self.lang[at])

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of ``at``, joined by a blank."""
        if k == 0:
            return pa.array([""] * len(at), pa.string())
        words = (at[:, None] + np.arange(k)).ravel()
        starts, sizes = self.t.start[words], self.t.end[words] - self.t.start[words]
        room = sizes + np.tile(np.append(np.ones(k - 1, dtype=np.int64), 0), len(at))
        offsets = prefix(room)
        out = np.full(offsets[-1], 0x20, dtype=np.uint8)
        out[ragged(offsets[:-1], sizes)] = self.t.data[ragged(starts, sizes)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets[::k].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def windows(batch: pa.RecordBatch) -> Iterator[tuple[Windows, pa.Array, np.ndarray]]:
    """Of a batch (lang, text): the words of its slices, the distinct langs, and which of them every document has."""
    langs = batch.column(0).dictionary_encode()
    codes = np.array([lang_code(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
    which = langs.indices.to_numpy()
    for at, to, t in slices(batch.column(1), lower=True, limit=SLICE_BYTES, gaps=GAPS):
        yield Windows(t, codes[which[at:to]]), langs.dictionary, which[at:to]


def counted(docs: DataFrame, lengths: list[int], bits: int, words: np.ndarray | None) -> DataFrame:
    """(size, range, counts): per window length the counters of a task, as compressed ranges of ``RANGE`` bytes. With
    ``words``, the filter of single words, only windows of such words are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(1 << bits, dtype=np.uint8) for k in lengths}
        for batch in batches:
            for w, _, _ in windows(batch):
                at = np.arange(w.n)
                fine = passes(words, w.hashes(at, 1)) if words is not None else np.ones(w.n, dtype=bool)
                for k in range(1, max(lengths) + 1):
                    at = at[w.run[at] >= k]
                    at = at[fine[at + k - 1]]
                    if k in tables:
                        spot, n = np.unique(w.hashes(at, k) & np.uint64((1 << bits) - 1), return_counts=True)
                        tables[k][spot] = np.minimum(tables[k][spot] + n, 255)
        step = min(RANGE, 1 << bits)
        for k, table in tables.items():
            for r in np.flatnonzero(table.reshape(-1, step).any(axis=1)):
                packed = zlib.compress(table[r * step : (r + 1) * step].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([packed], pa.binary())], names=["size", "range", "counts"])
        release()

    return docs.mapInArrow(run, "size int, range int, counts binary")


def frequent_buckets(counts: DataFrame, lengths: list[int], bits: int, least: int) -> dict[int, np.ndarray]:
    """Per window length a bitmap of the counters whose sum over all tasks is ``least`` or more. The driver gets
    2**bits / 8 bytes a length."""
    step = min(RANGE, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def row() -> pa.RecordBatch:
            found = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([found], pa.binary())], names=["size", "range", "found"])

        for batch in batches:  # in the order of size and range: one range is held at a time
            for size, r, packed in zip(*[c.to_pylist() for c in batch.columns]):
                if (size, r) != key:
                    if key is not None:
                        yield row()
                    key, total = (size, r), np.zeros(step, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        if key is not None:
            yield row()

    dealt = counts.repartition("size", "range").sortWithinPartitions("size", "range")
    out = {k: np.zeros((1 << bits) // 8, dtype=np.uint8) for k in lengths}
    for r in dealt.mapInArrow(add, "size int, range int, found binary").collect():
        out[r["size"]][r["range"] * step // 8 : (r["range"] + 1) * step // 8] = np.frombuffer(r["found"], dtype=np.uint8)
    return out


class Entries:
    """The counted windows of a task: key, stripe, piece, count, and as texts lang, prefix, next word."""

    NUMBERS, TEXTS = ("key", "head", "piece", "size", "count"), ("lang", "prefix", "next")

    def __init__(self):
        self.parts: list[dict] = []
        self.rows = 0

    def add(self, w: Windows, names: pa.Array, doc_of: np.ndarray, k: int, frequent: dict[int, np.ndarray]) -> None:
        """The k-word windows of a slice that the filter lets through; of single words, the others as the rest."""
        at = np.flatnonzero(w.run >= k)
        h = w.hashes(at, k)
        fine = passes(frequent[k], h)
        if k > 1:
            fine[fine] = passes(frequent[k - 1], w.hashes(at[fine], k - 1)) & passes(frequent[k - 1], w.hashes(at[fine] + 1, k - 1))
        key, first, count = np.unique(h[fine], return_index=True, return_counts=True)
        first = at[fine][first]
        self._keep(key, first, count, w, names, doc_of, k, w.texts(first + k - 1, 1))
        if k == 1 and not fine.all():
            lang, first, count = np.unique(w.lang[~fine], return_index=True, return_counts=True)
            first = np.flatnonzero(~fine)[first]
            self._keep(mix(lang + U64(1)), first, count, w, names, doc_of, k, pa.array([REST] * len(first), pa.string()))

    def _keep(self, key, first, count, w: Windows, names: pa.Array, doc_of, k: int, nexts: pa.Array) -> None:
        if len(first):
            head = mix(w.hashes(first, k - 1) + U64(k)) if k > 1 else mix(w.lang[first] + U64(k))
            piece = mix(w.t.hash[first + k - 1]) % U64(PIECES_OF_WORDS if k == 1 else PIECES)
            self.parts.append({"key": mix(key + U64(k)), "head": head, "piece": piece.astype(np.int64), "size": np.full(len(first), k), "count": count,
                               "lang": names.take(pa.array(doc_of[w.t.doc[first]])), "prefix": w.texts(first, k - 1), "next": nexts})
            self.rows += len(first)

    def merge(self) -> None:
        """Adds up equal windows of different slices."""
        joined = {c: np.concatenate([p[c] for p in self.parts]) for c in self.NUMBERS}
        key, first, which = np.unique(joined["key"], return_index=True, return_inverse=True)
        made = {c: joined[c][first] for c in self.NUMBERS}
        made["count"] = np.bincount(which, weights=joined["count"], minlength=len(key)).astype(np.int64)
        self.parts = [made | {c: pa.concat_arrays([p[c] for p in self.parts]).take(pa.array(first)) for c in self.TEXTS}]
        self.rows = len(key)

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """(lang, size, prefix, piece, next words, counts); nothing is held afterwards."""
        if self.rows:
            self.merge()
            p = self.parts[0]
            order = np.lexsort((p["piece"], p["head"]))
            head, piece = p["head"][order], p["piece"][order]
            rows = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (piece[1:] != piece[:-1])]))
            bounds, lead = pa.array(np.append(rows, len(head)), pa.int32()), pa.array(order[rows])
            yield pa.RecordBatch.from_arrays([
                p["lang"].take(lead), pa.array(p["size"][order[rows]], pa.int32()), p["prefix"].take(lead), pa.array(piece[rows], pa.int32()),
                pa.ListArray.from_arrays(bounds, p["next"].take(pa.array(order))), pa.ListArray.from_arrays(bounds, pa.array(p["count"][order], pa.int64()))],
                names=["lang", "size", "prefix", "piece", "nexts", "counts"])
        self.parts, self.rows = [], 0


def count_stripes(docs: DataFrame, longest: int, frequent: dict[int, np.ndarray]) -> DataFrame:
    """The merged stripes as entries: lang, size (words with the next one), prefix, next, f. ``docs``: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Entries()
        for batch in batches:
            for w, names, doc_of in windows(batch):
                for k in range(1, longest + 1):
                    held.add(w, names, doc_of, k, frequent)
                if held.rows > HELD:
                    held.merge()
                    if held.rows > HELD // 2:
                        yield from held.stripes()
        yield from held.stripes()
        release()

    sent = docs.mapInArrow(run, "lang string, size int, prefix string, piece int, nexts array<string>, counts array<long>")
    # equal pieces of a stripe meet in one task; the element-wise sum needs no further exchange
    dealt = sent.repartition("lang", "size", "prefix", "piece")
    return dealt.select("lang", "size", "prefix", "piece", F.explode(F.arrays_zip("nexts", "counts")).alias("e")).groupBy(
        "lang", "size", "prefix", "piece", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("f")).drop("piece")


def window_filter(docs: DataFrame, least: int, longest: int, bits: int) -> dict[int, np.ndarray]:
    """Per window length the bitmap of counters that a frequent window can have. ``bits``: of a counter's number."""
    single = frequent_buckets(counted(docs, [1], bits, None), [1], bits, least)
    lengths = list(range(2, longest + 1))
    return {**single, **(frequent_buckets(counted(docs, lengths, bits, single[1]), lengths, bits, least) if lengths else {})}


def stripes(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): every phrase of 1 to ``longest`` words with f >= least as lang, phrase, size, f, prefix, next;
    and n, the number of words, of every lang: the total of the empty prefix. ``bits``: of a counter's number; by
    default from the size of the texts."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits or min(MOST_BITS, max(LEAST_BITS, round(math.log2(size / 6 / LOAD + 1))))
    # a task that counts more text sends less: what it meets again is added up before
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_TEXT)))
    entries = count_stripes(docs, longest, window_filter(docs, least, longest, bits))
    words = (F.col("size") == 1)
    entries = stage(entries.filter(words | ((F.col("f") >= least) & (F.col("next") != REST))), "stripes")
    phrase = F.when(words, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    kept = entries.filter((F.col("f") >= least) & (F.col("next") != REST))
    return kept.select("lang", phrase.alias("phrase"), "size", "f", "prefix", "next"), entries.filter(words).groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each lang's phrases of 2 to ``longest`` words with a = f >= least
    that no longer one subsumes (100 * f(longer) >= percent * a), the ``top`` by their weakest cut's score."""
    phrases, words = stripes(docs.select("lang", "text"), least, longest)
    shorter = lambda drop_first: F.regexp_replace("phrase", r"^[^ ]+ ", "") if drop_first else F.col("prefix")
    longer = phrases.filter("size > 2").select("lang", F.explode(F.array(shorter(False), shorter(True))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = phrases.filter("size > 1").join(longer, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < F.lit(percent) * F.col("f")))
    parts = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", parts.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    for name, column in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(name), F.col("f").alias(column)), ["lang", name])
    cuts = cuts.join(words, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), "below": whole("l") * whole("r")})
    cuts = cuts.withColumn("score", F.expr("above div below").cast("long"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of every part of a lang, then of the lang: no task holds all phrases of a lang
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = weakest.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
