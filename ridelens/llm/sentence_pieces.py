"""SentencePiece encoding that keeps where every piece came from, and decoding.

1. A run of texts is normalised at once: the longest prefix that the model's
   compiled character map has is replaced, every other character stays; blanks
   are collapsed, marked and prefixed as the model says. Every normalised byte
   carries the source byte of its character.
2. The normalised text is cut before each run of blank marks. No piece has a
   mark after another character (checked; a model with such pieces is not cut),
   so merges never cross a cut: each distinct word is segmented once, by the
   library's own merges on a copy of the model without normalisation.
3. Piece lengths, summed, give each piece's normalised bytes and, through the
   alignment, its span of source bytes. Of a character spelled in byte pieces
   the last has the span, those before are empty at its start (the library's
   rule). The lengths must add up to the text, else the task fails.

Models: BPE with byte fallback, without user-defined symbols or a blank as
suffix; others raise before any job. Texts are valid UTF-8.

Defined cases: a null or empty text has no pieces and decodes to the empty
text; repeated rows are encoded each by itself; an input column that has the
name of an added one is replaced; an empty table gives no rows. Row-local: no
shuffle, one slice of texts in memory at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.textnum import BASE, BYTE_CODE, prefix, ragged, release, span_hash

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: bytes of text normalised and encoded at once; a longer document makes a slice of its own
SLICE_BYTES = 1 << 21
#: distinct words remembered between slices; beyond, the memory starts anew
REMEMBERED = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
BPE = 2  # model type of the model format


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharMap:
    """Replacements by longest prefix, read from a compiled character map: the size of a double-array trie, the
    trie's 32-bit units, and the replacements, each ended by a zero byte. An empty map replaces nothing."""

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self._read(np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :])
        keys = [key.decode() for key in self.rules]
        self.longest: dict[str, int] = {}
        for key in keys:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key.encode()))
        chars = lambda found: f"[{''.join(map(re.escape, sorted(found)))}]"
        alone, first, second = ({k for k in keys if len(k) == 1}, {k[0] for k in keys if len(k) > 1}, {k[1] for k in keys if len(k) > 1})
        #: characters at which a rule may begin
        either = ([chars(alone)] if alone else []) + ([chars(first) + f"(?={chars(second)})"] if first else [])
        self.begins = re.compile("|".join(either), re.DOTALL) if either else None

    def _read(self, units: np.ndarray, pool: bytes) -> None:
        """A unit has its byte in bits 0-7, "a value follows" in bit 8, its offset above; a value unit has bit 31."""
        offsets = (units >> 10) << ((units & 0x200) >> 6)
        labels = units & 0x800000FF
        todo = [(int(offsets[0]), b"")]
        while todo:
            base, key = todo.pop()
            nodes = base ^ np.arange(1, 256)
            nodes = nodes[nodes < len(units)]
            for node in nodes[labels[nodes] == (base ^ nodes)].tolist():
                longer, below = key + bytes([base ^ node]), node ^ int(offsets[node])
                if int(units[node]) >> 8 & 1:
                    value = int(units[below]) & 0x7FFFFFFF
                    self.rules[longer] = pool[value : pool.index(b"\0", value)]
                todo.append((below, longer))

    def matches(self, text: str) -> list[tuple[int, int, bytes]]:
        """(first byte, byte after the last, replacement) of the rules that apply, from left to right."""
        if self.begins is None:
            return []
        data, found, done, char, byte = text.encode(), [], 0, 0, 0
        for m in self.begins.finditer(text):
            byte += len(text[char : m.start()].encode())
            char = m.start()
            if byte < done:
                continue
            for n in range(self.longest[text[char]], 0, -1):
                to = self.rules.get(data[byte : byte + n])
                if to is not None and byte + n <= len(data):
                    found.append((byte, byte + n, to))
                    done = byte + n
                    break
        return found




class Model:
    """A model's normaliser and vocabulary, and the library's segmenter of text that is normalised already."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        m = formats.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != BPE or not m.trainer_spec.byte_fallback or USER_DEFINED in kinds or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only BPE models with byte fallback, without user-defined symbols or a blank as suffix")
        spec = m.normalizer_spec
        self.prefix, self.collapse, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        self.size = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in m.pieces], dtype=np.int64)
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces if p.type == NORMAL)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        spec.precompiled_charsmap = b""
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        self.known: dict[bytes, list[int]] = {}

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A run of texts (bytes and offsets) -> normalised bytes, their offsets, the source byte of each
        normalised byte's character, and the source byte at which each text's last character ends."""
        n = len(offsets) - 1
        at = np.arange(len(data))
        source = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, at)) if len(data) else at
        lead = np.ones(len(data), dtype=bool)  # only blanks before it in its replacement
        if self.map.begins is not None:
            found = [(offsets[i] + a, offsets[i] + b, to) for i in range(n)
                     for a, b, to in self.map.matches(data[offsets[i] : offsets[i + 1]].tobytes().decode())]
            if found:
                begin, end = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                counts = np.ones(len(data), dtype=np.int64)
                counts[ragged(begin, end - begin)] = 0
                kept = counts > 0
                counts[begin] = [len(f[2]) for f in found]
                place = prefix(counts)
                made, source = np.empty(place[-1], dtype=np.uint8), np.repeat(source, counts)
                made[place[:-1][kept]] = data[kept]
                inside = ragged(place[begin], counts[begin])
                made[inside] = np.frombuffer(b"".join(f[2] for f in found), dtype=np.uint8)
                lead = np.ones(len(made), dtype=bool)
                lead[inside] = np.concatenate([np.cumsum(np.frombuffer(f[2], dtype=np.uint8) != 0x20) - (np.frombuffer(f[2], dtype=np.uint8) != 0x20) == 0
                                               for f in found])
                data, bounds = made, place[offsets]
            else:
                bounds = offsets
        else:
            bounds = offsets
        last = offsets[1:].copy()
        if self.collapse and len(data):
            blank = data == 0x20
            after = np.concatenate([[True], blank[:-1]])
            after[bounds[:-1][bounds[:-1] < len(data)]] = True
            keep = ~(blank & after & lead)
            mark = np.frombuffer(MARK.encode(), dtype=np.uint8)
            for i in np.flatnonzero(np.diff(bounds)):  # blanks at the end; where they are marked, marks as well
                a, b = bounds[i], bounds[i + 1]
                while b > a and (blank[b - 1] or not keep[b - 1] or (self.escape and b - a >= 3 and (data[b - 3 : b] == mark).all())):
                    step = 1 if blank[b - 1] or not keep[b - 1] else 3
                    b -= step
                    last[i] = source[b] if keep[b] else last[i]
                    keep[b : b + step] = False
            kept = prefix(keep)
            data, source, bounds = data[keep], source[keep], kept[bounds]
        sizes = np.where(data == 0x20, 3, 1) if self.escape else np.ones(len(data), dtype=np.int64)
        extra = np.zeros(len(data) + 1, dtype=np.int64)
        if self.prefix:
            extra[bounds[:-1][np.diff(bounds) > 0]] = 3 if self.escape else 1
        total = prefix(sizes + extra[:-1])
        where = total[:-1] + extra[:-1]
        out, aligned = np.empty(total[-1], dtype=np.uint8), np.repeat(source, sizes + extra[:-1])
        out[where] = data
        blanks = [where[data == 0x20]] + ([where[extra[:-1] > 0] - 3] if self.prefix and self.escape else [])
        if self.escape:
            for found in blanks:
                for j, byte in enumerate(MARK.encode()):
                    out[found + j] = byte
        elif self.prefix:
            out[where[extra[:-1] > 0] - 1] = 0x20
        return out, total[bounds], aligned, last

    def segment(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ids of normalised texts, one after another."""
        begins = np.zeros(len(data) + 1, dtype=bool)
        if self.cut and len(data) > 2:
            a, b, c = MARK.encode()
            marks = np.flatnonzero(data[:-2] == a)
            marks = marks[(data[marks + 1] == b) & (data[marks + 2] == c)]
            begins[marks] = True
            begins[marks[1:][np.diff(marks) == 3]] = False  # inside a run of marks
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        hashes = span_hash(BYTE_CODE[data], BASE, starts, ends)
        order = np.argsort(hashes, kind="stable")
        new_word = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        at, which = order[new_word], np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new_word) - 1
        raw = data.tobytes()
        words = [raw[starts[i] : ends[i]] for i in at]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.merges.encode([w.decode() for w in new], num_threads=1)))
        found = [self.known[w] for w in words]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pool = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(counts.sum()))
        return pool[ragged(prefix(counts)[:-1][which], counts[which])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A run of texts -> ids, first and end source byte of each (within its text), offsets of the texts' ids."""
        made, bounds, source, last = self.normalise(data, offsets)
        ids = self.segment(made, bounds) if len(made) else np.zeros(0, dtype=np.int32)
        upto = prefix(self.size[ids])
        if upto[-1] != len(made):
            raise AssertionError("pieces do not add up to the normalised text")
        tokens = np.searchsorted(upto[:-1], bounds)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(tokens))
        begin, end = upto[:-1], upto[1:]
        to = np.append(source, 0)[end]
        closes = end == bounds[1:][doc]
        to[closes] = last[doc[closes]]
        return ids, source[begin] - offsets[doc], to - offsets[doc], tokens


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a text column; null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def encode_pieces(df: DataFrame, path: str | None = None, text_col: str = "text", decode: bool = False) -> DataFrame:
    """``df`` without its text, with ``ids`` (array of int), ``begins`` and ``ends`` (arrays of int: each piece's source
    bytes), and with ``decode`` also ``decoded``, the library's decoding of the ids. ``path``: a model file that
    every executor has."""
    path = path or model_path()
    load(path)  # an unsuitable model raises here
    added = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in ("ids", "begins", "ends")]
                         + ([T.StructField("decoded", T.StringType())] if decode else []))
    names = {f.name for f in added} | {text_col.lower()}
    base = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([f for f in base.schema if f.name != "_text"] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at, to, data, offsets in runs(batch.column(0)):
                ids, begins, ends, tokens = model.encode(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(a, pa.int32())) for a in (ids, begins, ends)]
                if decode:
                    flat = ids.tolist()
                    lists.append(pa.array(model.library.decode([flat[a:b] for a, b in zip(tokens, tokens[1:])], num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays([c.slice(at, to - at) for c in batch.columns[1:]] + lists, names=[f.name for f in schema])
            release()

    return base.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give the empty text."""
    path = path or model_path()
    load(path)
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    base = df.select(F.col(f"`{ids_col}`").alias("_ids"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([f for f in base.schema if f.name != "_ids"] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = load(path).library.decode([ids or [] for ids in batch.column(0).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return base.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ``covered_bytes``: the source bytes that the pieces span."""
    made = encode_pieces(docs.select("doc_id", "text"), path, decode=True)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("covered_bytes"))
