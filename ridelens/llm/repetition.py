"""Quality rules: repetition coverage.

Per document, the share of characters that lie inside repeated word n-grams of
several lengths (rolling hashes in numpy) and inside repeated lines. The
statistics are per row, so the operator has no shuffle at all.

Defined cases: a null text has no words and fails the base rule; an empty or
blank text too; repeated rows are judged each by itself; an empty table gives
an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm import textnum as X
from ridelens.llm.common import with_columns_arrow

SYMBOLS = "#*$%&|<>"
#: n-gram length -> most of the characters that later repeats of such n-grams may cover
GRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20  # most of the characters in repeated lines
MIN_WORDS, WINDOW, WINDOW_PERCENT = 20, 8, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _shares(lengths) -> list[str]:
    return [f"dup_{n}gram_share" for n in sorted(lengths)] + ["dup_line_share"]


SHARES = _shares(GRAM_SHARES)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _lines(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-split line (document ends split too)."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.concatenate([t.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, t.offsets[1:]])
    doc = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, breaks, "right") - 1])
    order = np.lexsort((doc, starts))  # an empty last line lies where the next document begins
    return starts[order], np.sort(ends), doc[order]


def text_stats(t: X.Texts, lengths=tuple(GRAM_SHARES)) -> dict[str, np.ndarray]:
    points = X.prefix((t.data & 0xC0) != 0x80)  # code points before each byte
    chars = points[t.end] - points[t.start]
    by_doc = lambda values, doc: np.bincount(doc, weights=values, minlength=t.n)
    out = {"n_words": np.diff(t.first), "word_chars": by_doc(chars, t.doc), "n_symbols": t.per_doc(_SYMBOL[t.data])}

    start, end, doc = _lines(t)
    has_word = np.searchsorted(t.start, end) > np.searchsorted(t.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    key = X.span_hash(X.BYTE_CODE[t.data], X.BASE, start, end)
    _, later = X.repeats(X.mix(key + X.U64(0x9E3779B1) * doc.astype(np.uint64)))
    line_chars = points[end] - points[start]
    total = np.maximum(points[t.offsets[1:]] - points[t.offsets[:-1]], 1)
    out["n_dup_lines"] = by_doc(later, doc)
    out["dup_line_share"] = by_doc(line_chars * later, doc) / total

    word_chars = np.maximum(out["word_chars"], 1)
    live = None  # windows that can still repeat: both (n-1)-grams inside repeat
    for n in sorted({*lengths, WINDOW}):
        at, key = t.grams(n)
        if live is not None and len(at):
            ok = live[at] & live[at + 1]
            at, key = at[ok], key[ok]
        twice, later = X.repeats(X.mix(key + X.U64(0x9E3779B1) * t.doc[at].astype(np.uint64)))
        live = np.zeros(len(t.doc) + 1, dtype=bool)
        live[at[twice]] = True
        if n == WINDOW:
            out["n_repeat_words"] = by_doc(X.cover(len(t.doc), at[twice], n), t.doc)
        if n in lengths:
            out[f"dup_{n}gram_share"] = by_doc(chars * X.cover(len(t.doc), at[later], n), t.doc) / word_chars
    return out


def _batch(column: pa.Array, lengths=tuple(GRAM_SHARES)) -> dict[str, pa.Array]:
    parts = [text_stats(t, lengths) for _, _, t in X.slices(column)]
    made = {c: np.concatenate([p[c] for p in parts]) for c in COUNTS + _shares(lengths)}
    return {c: pa.array(v.astype(np.int64 if c in COUNTS else np.float64)) for c, v in made.items()}


def repetition_coverage(docs: DataFrame, text_col: str = "text", gram_shares: dict[int, float] | None = None, line_share: float = LINE_SHARE) -> DataFrame:
    """``docs`` without their text column, with the statistics, ``base_failed`` and ``kept``. ``gram_shares``: window
    length in words (1 or more) -> the largest share of characters inside windows that occurred before."""
    shares = GRAM_SHARES if gram_shares is None else gram_shares
    names = _shares(shares)
    stats = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in names])

    batch = lambda column: _batch(column, tuple(shares))
    out = with_columns_arrow(docs.withColumn("_text", F.col(f"`{text_col}`")).drop(text_col), "_text", stats, batch).drop("_text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_share") <= line_share
    for n, most in shares.items():
        fine &= F.col(f"dup_{n}gram_share") <= most
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    judged = repetition_coverage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_t")), "_t")
    return judged.filter("kept").select("_row.*")
