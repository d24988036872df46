"""Near-duplicate vectors with randomised-rotation binary codes.

Each vector is normalised, padded and rotated by a seeded random orthonormal
frame; the signs of the result are its code, and the correction factor
<code, vector> (both stored once per class) makes <code, query> / factor an unbiased estimate of the cosine.
The estimate's error is at most EPSILON * sqrt((1 - f^2) / f^2) / sqrt(bits - 1)
(EPSILON standard deviations). A pair whose upper bound stays below the
threshold is dropped; every other pair is recomputed exactly in double precision.

Candidates meet in cells: the label and the signs of a few random hyperplanes,
in several tables, so many that a pair at the threshold is missed by all with a
chance of ``MISS``. Every table has hyperplanes of its own, drawn independently:
tables over the bits of one code would fail together. A row goes to its block of
every table once, with its code, factor, keys in as few bytes as they need and the
vector in its own type (the one query side of an estimate, and what exact
cosines need). Cells of any size are split into blocks; a pair is counted only in
the first table where both share a cell. Blocks return link counts and a
spanning forest, never pairs. Equal vectors are one class from the start.

Defined cases: rows with a null id, label or vector, a zero vector or a null
or non-finite component link with nothing and are their own component;
vectors of different lengths link with nothing; repeated rows are copies that
count as links; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.blocks import map_blocks, with_blocks
from ridelens.llm.common import stage
from ridelens.llm.components import components

THRESHOLD, CODE_BITS, EPSILON, MISS, SEED = 0.98, 256, 5.0, 1e-6, 11
CELL_ROWS, CHUNK, PAIRS = 8, 1024, 1 << 20
TESTED = 1 << 14  # pairs estimated at once


@lru_cache
def frame(dim: int, bits: int = CODE_BITS) -> np.ndarray:
    """bits x dim with orthonormal columns (bits is rounded up to a multiple of dim's next 64)."""
    bits = max(bits, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def plan_tables(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per key and number of tables: cells of about CELL_ROWS unrelated rows; a pair at the threshold
    agrees in a bit with chance 1 - angle / pi."""
    bits = max(4, math.ceil(math.log2(max(rows, 2) / CELL_ROWS)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, sign codes (booleans) and correction factors."""
    turned = units @ frame(units.shape[1]).T
    return turned, turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def unpack(codes, bits: int) -> np.ndarray:
    """Stored codes as rows of ``bits`` bits."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    raw = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(codes), -1)
    return np.unpackbits(raw, axis=1, count=bits, bitorder="little")


def key_type(bits: int) -> tuple[str, type]:
    """The smallest integer that holds a key."""
    return ("short", np.int16) if bits <= 15 else ("int", np.int32) if bits <= 31 else ("long", np.int64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@lru_cache(maxsize=4)
def planes(dim: int, n: int) -> np.ndarray:
    """n independent normal hyperplanes: each separates two vectors with chance angle / pi."""
    return np.random.default_rng([SEED, dim]).standard_normal((n, dim))


def cell_keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """tables keys of ``bits`` signs each, from hyperplanes that no other table uses."""
    normals = planes(units.shape[1], bits * tables)
    weights = 1 << np.arange(bits, dtype=np.int64)
    keys = np.empty((len(units), tables), dtype=np.int64)
    for t in range(tables):
        keys[:, t] = (units @ normals[t * bits : (t + 1) * bits].T > 0) @ weights
    return keys


def upper_bounds(turned, code, factor, i, j) -> np.ndarray:
    """Upper confidence bound of the cosine of rows i and j: i by its code, j as the query.
    <sign, x> = 2 <bit, x> - <1, x>, so the bits do without signs."""
    bits = code.shape[1]
    query = turned[j]
    estimate = (2 * np.einsum("ij,ij->i", code[i], query) - query.sum(axis=1)) / math.sqrt(bits) / factor[i]
    spread = np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / factor[i] / math.sqrt(bits - 1)
    return estimate + EPSILON * spread


def forest(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The least row (by ``order``) reachable from each row, by repeated minima."""
    label = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return np.argsort(order, kind="stable")[label]
        label = new


def _search(blocks: list[pa.Table], threshold: float) -> pa.Table:
    """rep, other, links: per row of the blocks its links there, and its forest edge."""
    by_dim: dict[int, list[pa.Table]] = {}
    for b in blocks:
        by_dim.setdefault(b.column("dim")[0].as_py(), []).append(b)
    return pa.concat_tables([_search_equal(b, threshold) for b in by_dim.values()])


def _search_equal(blocks: list[pa.Table], threshold: float) -> pa.Table:
    rows = pa.concat_tables(blocks)
    rep, copies, cell_table = (rows.column(c).to_numpy() for c in ("rep", "copies", "t"))
    units = unit(_matrix(rows.column("vec")))
    keys = _matrix(rows.column("keys"))
    code, factor = unpack(rows.column("code"), frame(units.shape[1]).shape[0]), rows.column("factor").to_numpy()
    turned, code = (units @ frame(units.shape[1]).T).astype(np.float32), code.astype(np.float32)  # rounding is far below the bounds
    links = np.zeros(len(rep), dtype=np.int64)
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def test(all_i: np.ndarray, all_j: np.ndarray) -> None:
        for a in range(0, len(all_i), TESTED):
            test_some(all_i[a : a + TESTED], all_j[a : a + TESTED])

    def test_some(i: np.ndarray, j: np.ndarray) -> None:
        # split blocks meet rows of one chunk several times: those pairs belong to the block of the next chunk
        ok = rep[i] != rep[j]
        i, j = i[ok], j[ok]
        ok = np.argmax(keys[i] == keys[j], axis=1) == cell_table[i]
        i, j = i[ok], j[ok]
        ok = upper_bounds(turned, code, factor, i, j) >= threshold
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
        i, j = i[ok], j[ok]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        found_i.append(i)
        found_j.append(j)

    at, waiting, count = 0, [], 0
    for block in blocks:
        n = block.num_rows
        same = chunk_owner(block)
        for first in range(0, n, 256):  # 256 rows against those after them
            i, j = np.nonzero(np.arange(n)[None, :] > np.arange(first, min(n, first + 256))[:, None])
            i += first
            ok = same(i, j)
            waiting.append((i[ok] + at, j[ok] + at))
            count += int(ok.sum())
            if count >= PAIRS:
                test(*map(np.concatenate, zip(*waiting)))
                waiting, count = [], 0
        at += n
    if waiting:
        test(*map(np.concatenate, zip(*waiting)))
    root = forest(len(rep), np.concatenate(found_i), np.concatenate(found_j), rep)
    keep = links > 0
    return pa.table({"rep": rep[keep], "other": rep[root[keep]], "links": links[keep]})


def chunk_owner(block: pa.Table):
    """Which pairs a block counts: pairs across its chunks; pairs inside chunk c only in the block (c, c + 1),
    or, for the last chunk, in the block with the one before."""
    lo, hi = block.column("_lo")[0].as_py(), block.column("_hi")[0].as_py()
    mine = block.column("_mine").to_numpy()
    last = block.column("_last")[0].as_py()

    def same(i, j):
        inside = mine[i] == mine[j]
        owned = (hi == lo) | ((mine[i] == lo) & (hi == lo + 1)) | ((mine[i] == hi) & (hi == last) & (lo == hi - 1))
        return ~inside | owned

    return same


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    chunk: int = CHUNK, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    # single precision is carried as it is; all arithmetic is in double
    kept = "array<float>" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kept).alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    usable = rows.filter(valid)
    classes = usable.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")
    largest = classes.groupBy("label", F.size("vec")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold, miss)

    key_sql, key_np = key_type(bits)

    def add_keys(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.array([len(v) for v in table.column("vec")], dtype=np.int64)
            for d in np.unique(sizes):
                part = table.filter(pa.array(sizes == d))
                units = unit(_matrix(part.column("vec")))
                _, code, factor = encode(units)
                keys = cell_keys(units, bits, tables).astype(key_np)
                packed = pa.array([x.tobytes() for x in np.packbits(code, axis=1, bitorder="little")], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                for name, made in (("code", packed), ("factor", pa.array(factor)), ("keys", lists)):
                    part = part.append_column(name, made)
                yield from part.to_batches()

    schema = f"label {dict(classes.dtypes)['label']}, vec {kept}, rep long, copies long, code binary, factor double, keys array<{key_sql}>"
    keyed = stage(classes.mapInArrow(add_keys, schema), "codes")
    cells = keyed.select("label", F.size("vec").alias("dim"), "rep", "copies", "vec", "code", "factor", "keys", F.posexplode("keys").alias("t", "key"))
    cells = cells.withColumn("t", F.col("t").cast("long"))
    group = ["label", "dim", "t", "key"]
    # only cells of more than a chunk are listed; all others are one block
    hot = stage(cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > chunk), "large-cells")
    hot = hot.withColumn("_last", F.ceil(F.col("_size") / chunk) - 1)
    # the chunk of each row is needed to know which block counts a pair
    blocks = with_blocks(cells, group, hot, F.col("_last") + 1, F.col("rep"), how="left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    blocks = blocks.withColumn("_mine", F.pmod(F.xxhash64("rep"), F.col("_last") + 1))
    found = map_blocks(blocks.select(*group, "_lo", "_hi", "_mine", "_last", "rep", "copies", "vec", "code", "factor", "keys"), [*group, "_lo", "_hi"],
                       lambda b: _search(b, threshold), "rep long, other long, links long", lambda b: b.num_rows * b.num_rows // 2 + 1, PAIRS)
    found = stage(found, "links")
    links = found.groupBy(F.col("rep").alias("r2")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("rep != other").select(F.col("rep").alias("a"), F.col("other").alias("b")))

    known = classes.join(links, F.col("rep") == F.col("r2"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l2"), F.col("vec").alias("v2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                         F.coalesce("component", "rep").alias("c"))
    out = rows.join(known, (F.col("label") == F.col("l2")) & (F.col("vec") == F.col("v2")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
