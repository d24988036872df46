"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, by T-occurrence search.

1. Every document becomes its set of distinct shingle hashes; equal sets are
   one node from here on (``node``: 64 bits of the set's digest).
2. Candidates: two sets that link differ in at most D shingles, a
   number that follows from the threshold and the sizes. The shingles are dealt
   by hash into more than D buckets, so two linked sets agree in a whole bucket.
   One signature per bucket. Among the sets with an equal signature, sketches of
   256 bins part those that cannot link: a set is compared with the leaders of
   its signature only, and joined to each whose estimate a linked set's leader
   could have (six standard deviations below the bound that the triangle
   inequality of the Jaccard distance gives). So sets that merely share a
   passage do not chain into one group. Joined sets are candidate groups. Where more
   than ``MOST`` sets share a signature (a footer on every page), they are first
   parted by bands of their sketches: two sets that link agree in a whole band but
   for a chance of ``BAND_MISS``, unlike ones hardly ever. Groups still larger are
   compared in blocks of two chunks.
3. In a group, T-occurrence search by DivideSkip over inverted lists: the
   shortest lists are heap-merged with skips, the longest are probed by binary
   search, and candidates that reach the overlap are links. Documents already
   in one component need no further pair. Large groups are split into blocks of
   two chunks each; a block returns a spanning forest.

The work that moves is one row per signature, the sketches of sets that share
one, then the texts of candidate documents. Equal sets of a slice of documents
are combined before the shuffle, so a group of copies that holds a third of the
rows sends one row per slice and signature.

Defined cases: a text without words (or null) has no shingles and links with
nothing; repeated rows are equal documents; a row with a null id has the
component of its equals (null if none has an id) and names none; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm import textnum as X
from ridelens.llm.blocks import map_blocks, with_blocks
from ridelens.llm.common import stage
from ridelens.llm.components import components

SHINGLE, PERCENT = 5, 80  # the default contract of word-shingle operators
CHUNK_DOCS, CHUNK_SHINGLES, WORK_BYTES = 400, 1 << 18, 1 << 20
WINDOW_RATIO = 1.6
BINS, STRONG, SIGMAS = 256, 0.8, 6.0  # sketch: bins, estimate that makes a set its leader's follower, error allowed
MOST, BAND_MISS = 2048, 1e-9  # sets compared as one block; chance that two linked sets share no band
PROBE_COST = 0.01  # DivideSkip's weight of a binary search against a merge step


def shingle_sets(t: X.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's begin (one more entry)."""
    at, grams = t.grams(k)
    words = np.diff(t.first)
    short = np.flatnonzero((words > 0) & (words < k))
    docs = np.concatenate([t.doc[at], short])
    values = np.concatenate([grams, X.span_hash(t.hash, X.GRAM_BASE, t.first[short], t.first[short + 1])])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    docs, values = docs[new], values[new]
    return values, np.searchsorted(docs, np.arange(t.n + 1))


def digests(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    raw = memoryview(values.tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def most_different(a, percent: int):
    """Shingles in which a set of size a and a linked one at least as large can differ: Jaccard >= percent / 100."""
    return (100 - percent) * (a + a * 100 // percent) // (100 + percent)


@lru_cache
def windows(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the smaller set's size: first size, buckets, largest partner, most differing shingles."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(max(firsts[-1] + 1, math.ceil(firsts[-1] * WINDOW_RATIO)))
    first = np.array(firsts, dtype=np.int64)
    last = first[1:] - 1
    differ = most_different(last, percent)
    buckets = np.where(differ == 0, 1, differ + 2 + differ // 50)  # spare buckets: some may be empty
    return first[:-1], buckets, last * 100 // percent, differ


def signatures(values: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document): for each window that a document takes part in, one per bucket with shingles.
    If so many buckets are empty that the equal ones might all be, the empty ones get one too."""
    starts, buckets, partner, limit = windows(percent)
    n = np.diff(first)
    home = np.searchsorted(starts, n, "right") - 1
    out_s, out_d = [], []
    back = 0
    while True:
        window = home - back
        docs = np.flatnonzero((n > 0) & (window >= 0) & ((back == 0) | (partner[np.maximum(window, 0)] >= n)))
        if not len(docs):
            if back:
                break
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        w = window[docs]
        k = buckets[w]
        base = X.prefix(k)
        which = np.repeat(np.arange(len(docs)), n[docs])
        at = np.arange(len(which)) - np.repeat(X.prefix(n[docs])[:-1], n[docs]) + np.repeat(first[docs], n[docs])
        v = values[at]
        spot = base[which] + (v % k[which].astype(np.uint64)).astype(np.int64)
        v = X.mix(v + X.U64(0x5851F42D4C957F2D))
        half = lambda shift: np.bincount(spot, weights=((v >> X.U64(shift)) & X.U64((1 << 26) - 1)).astype(np.float64), minlength=base[-1]).astype(np.uint64)
        count = np.bincount(spot, minlength=base[-1])
        owner = np.repeat(np.arange(len(docs)), k)
        place = (w[owner].astype(np.uint64) << X.U64(40)) + (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        sig = X.mix(X.mix(half(0) * X.U64(0x9E3779B97F4A7C15) + half(26) + (count.astype(np.uint64) << X.U64(56))) + place * X.U64(X.GRAM_BASE))
        empty = np.bincount(owner[count == 0], minlength=len(docs))
        size = n[docs]
        # in its home window a set may be the smaller one of a pair; in a lower one it is the larger
        differ = np.minimum(limit[w], (100 - percent) * 2 * size // (100 + percent) if back else most_different(size, percent))
        emit = (count > 0) | (empty >= k - differ)[owner]
        out_s.append(sig[emit])
        out_d.append(docs[owner[emit]])
        back += 1
    return np.concatenate(out_s), np.concatenate(out_d)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation min-hash: per document a byte of the least hash in each of 256 bins, 0 for an empty bin."""
    n = len(first) - 1
    v = X.mix(values ^ X.U64(0xA0761D6478BD642F))
    least = np.full(n * BINS, ~X.U64(0), dtype=np.uint64)
    spot = np.repeat(np.arange(n), np.diff(first)) * BINS + (v >> X.U64(56)).astype(np.int64)
    np.minimum.at(least, spot, v & X.U64((1 << 56) - 1))
    return np.where(least == ~X.U64(0), 0, least % X.U64(255) + X.U64(1)).astype(np.uint8).reshape(n, BINS)


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a sketch with each of the others."""
    filled = (one > 0) | (others > 0)
    return ((one == others) & filled).sum(axis=1) / np.maximum(filled.sum(axis=1), 1)


def least_alike(percent: int) -> float:
    """The estimate that a set and its partner's leader have at least: the follower is alike its leader by
    STRONG less the error, the partner by (1 - percent / 100) less than that, less the error again."""
    spread = lambda q: SIGMAS * math.sqrt(q * (1 - q) / BINS)
    q = percent / 100 + STRONG - spread(STRONG) - 1
    return q - spread(q) if q > 0 else 0.0


def band_bins(percent: int) -> int:
    """Bins of a band: the most with which two sets at the threshold share no band with a chance of BAND_MISS at most."""
    share = percent / 100
    return max(r for r in (1, 2, 4, 8, 16) if r == 1 or (1 - share**r) ** (BINS // r) <= BAND_MISS)


def same_members(postings: DataFrame) -> DataFrame:
    """(members, node) of the signatures that several sets share; signatures that the same sets share count once."""
    same = Window.partitionBy("sig")
    shared = postings.withColumns({"least": F.min("node").over(same), "most": F.max("node").over(same), "all": F.bit_xor(F.xxhash64("node")).over(same)})
    return shared.filter("least != most").select(F.xxhash64("least", "most", "all").alias("members"), "node").distinct()


def part_by_bands(rows: DataFrame, percent: int) -> DataFrame:
    """rows: members, node, sketch -> (members, node) of the smaller groups that agree in a band; a band of empty bins
    says nothing."""
    r = band_bins(percent)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BINS // r - 1)), lambda b: F.struct(b.alias("b"), F.substring("sketch", b * r + 1, F.lit(r)).alias("s")))
    filled = F.filter(bands, lambda x: x["s"] != F.lit(bytes(r)))
    return same_members(rows.select("members", "node", F.explode(filled).alias("e")).select(F.xxhash64("members", "e.b", "e.s").alias("sig"), "node"))


def chain(nodes: np.ndarray, sketch: np.ndarray, cut: float, parent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Connects each set of one signature with every leader that is alike enough. ``parent`` holds what is
    connected already (over earlier signatures of the task): only edges that connect more are returned."""
    parent = {} if parent is None else parent

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    leaders, edges = [0], []
    for i in range(1, len(nodes)):
        near = alike(sketch[i], sketch[leaders])
        for k in np.flatnonzero(near >= cut):
            a, b = find(int(nodes[i])), find(int(nodes[leaders[k]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(nodes[i]), int(nodes[leaders[k]])))
        if near.max() < STRONG:
            leaders.append(i)
    return edges


def _merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(element, occurrences) of what occurs in at least ``need`` of the sorted lists: a heap of list heads;
    after a miss, as many lists as could not matter skip to the next possible element."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        value, taken = heap[0][0], []
        while heap and heap[0][0] == value:
            taken.append(heapq.heappop(heap))
        if len(taken) >= need:
            found.append((value, len(taken)))
            goal = value + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def t_occurrence(lists: list[list[int]], need: int) -> list[tuple[int, int, list[list[int]]]]:
    """DivideSkip: candidates with their occurrences in the short lists, and the long lists left to probe."""
    lists = sorted(lists, key=len)
    if len(lists) < need:
        return []
    long = min(need - 1, int(need / (PROBE_COST * math.log2(len(lists[-1]) + 1) + 1)))
    short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
    return [(d, c, rest) for d, c in _merge(short, need - long)]


def overlap_needed(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def link_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of one block, as pairs of positions."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest: list[tuple[int, int]] = []
    roots: set[int] = set()

    def union(x: int, y: int) -> None:
        forest.append((x, y))
        a, b = find(x), find(y)
        roots.discard(max(a, b))
        parent[max(a, b)] = min(a, b)

    index: dict[int, list[int]] = {}
    tokens = [s.tolist() for s in sets]
    recent = None
    order = sorted(range(len(sets)), key=lambda i: len(tokens[i]))
    for place, i in enumerate(order):
        own = tokens[i]
        roots.add(i)
        if recent is not None:  # most members of a dense group link with the last one that did
            j = order[recent]
            if len(set(own).intersection(tokens[j])) >= overlap_needed(len(own), len(tokens[j]), percent):
                union(i, j)
        if place and len({find(r) for r in roots}) > 1:
            # earlier documents are no larger: the overlap is at least that with the smallest partner
            need = max(1, overlap_needed(len(own), -(-percent * len(own) // 100), percent))
            for j, seen, rest in t_occurrence([index[x] for x in own if x in index], need):
                other = order[j]
                goal = overlap_needed(len(own), len(tokens[other]), percent)
                if find(i) == find(other) or seen + len(rest) < goal:
                    continue
                for k, x in enumerate(rest):
                    if seen + len(rest) - k < goal:
                        break
                    at = bisect_left(x, j)
                    seen += at < len(x) and x[at] == j
                if seen >= goal:
                    union(i, other)
                    recent = place
        for x in own:
            index.setdefault(x, []).append(place)
    return forest


def documents_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, digest, node, sketch."""
    def run(batches):
        for batch in batches:
            for a, b, t in X.slices(batch.column(2), lower=True):
                values, first = shingle_sets(t, k)
                found = digests(values, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first)), pa.array(found, pa.binary()), pa.array([node_of(d) for d in found], pa.int64()),
                                                  pa.array([x.tobytes() for x in sketches(values, first)], pa.binary())],
                                                 names=["doc_id", "text_hash", "n_shingles", "digest", "node", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, node long, sketch binary")


def candidate_groups(docs: DataFrame, sets: DataFrame, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """node, component: sets connected over signatures and sketches."""
    def run(batches):
        for batch in batches:
            for _, _, t in X.slices(batch.column(0), lower=True, limit=2 * X.SLICE_BYTES):
                values, first = shingle_sets(t, k)
                nodes = np.array([node_of(d) for d in digests(values, first)], dtype=np.int64)
                sig, doc = signatures(values, first, percent)
                node = nodes[doc]
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                new = np.ones(len(sig), dtype=bool)
                new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(sig[new].astype(np.int64)), pa.array(node[new])], names=["sig", "node"])

    def make(tables: list[pa.Table]) -> pa.Table:
        edges, parent = [], {}
        for table in tables:
            sketch = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("sketch")])
            edges += chain(table.column("node").to_numpy(), sketch, cut, parent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    cut = least_alike(percent)
    postings = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "sig long, node long")
    shared = stage(same_members(postings), "signatures")
    one = sets.groupBy(F.col("node").alias("n2")).agg(F.min("sketch").alias("sketch"))
    sketched = lambda rows: rows.join(one.hint("merge"), F.col("node") == F.col("n2")).select("members", "node", "sketch")
    sizes = lambda rows: rows.groupBy("members").agg(F.count(F.lit(1)).alias("_size"))
    hot = stage(sizes(shared).filter(F.col("_size") > MOST).select("members"), "hot")
    if not hot.isEmpty():
        parted = part_by_bands(sketched(shared.join(hot, "members", "left_semi")), percent)
        shared = stage(shared.join(hot, "members", "left_anti").unionByName(parted), "signatures")
    rows = with_blocks(sketched(shared), ["members"], sizes(shared), F.ceil(F.col("_size") / MOST), F.col("node"))
    edges = map_blocks(rows.select("members", "_lo", "_hi", "node", "sketch"), ["members", "_lo", "_hi"], make, "a long, b long", lambda t: t.num_rows * BINS, WORK_BYTES)
    return components(edges.distinct())


def verified_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, k: int, percent: int, id_col: str, text_col: str, chunk_docs: int) -> DataFrame:
    """a, b: a spanning forest of the links, between the least ids of equal sets."""
    reps = sets.filter("doc_id is not null and n_shingles > 0").join(groups, "node").groupBy("digest", "component").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    reps = stage(reps, "candidates")
    sizes = reps.groupBy("component").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_all")).filter("_docs > 1")
    chunks = F.greatest(F.ceil(F.col("_docs") / chunk_docs), F.ceil(F.col("_all") / CHUNK_SHINGLES))
    blocks = with_blocks(reps, ["component"], sizes, chunks, F.col("rep")).select("rep", "digest", "component", "_lo", "_hi")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    # no side has a bound: the same shuffled join at every size
    rows = blocks.join(texts.hint("merge"), "rep").select("component", "_lo", "_hi", "rep", "digest", "text")

    def make(tables: list[pa.Table]) -> pa.Table:
        a, b = [], []
        for table in tables:
            reps_, want = table.column("rep").to_pylist(), table.column("digest").to_pylist()
            found: dict[int, np.ndarray] = {}
            for lo, hi, t in X.slices(table.column("text"), lower=True):
                values, first = shingle_sets(t, k)
                for i, d in enumerate(digests(values, first)):
                    if d == want[lo + i]:  # an id may have other rows with other texts
                        found[reps_[lo + i]] = values[first[i] : first[i + 1]]
            ids = list(found)
            for x, y in link_sets([found[r] for r in ids], percent):
                a.append(ids[x])
                b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_blocks(rows, ["component", "_lo", "_hi"], make, "a long, b long", lambda t: t.column("text").nbytes, WORK_BYTES)


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row."""
    sets = stage(documents_sets(docs, k, id_col, text_col), "sets")
    groups = candidate_groups(docs, sets, k, percent, text_col)
    links = components(verified_links(docs, sets, groups, k, percent, id_col, text_col, chunk_docs))
    classes = sets.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")).join(links, F.col("rep") == F.col("node"), "left")
    # written, so that the join below deals both sides itself and can split a class with many copies
    classes = stage(classes.select(F.col("digest").alias("d2"), F.coalesce("component", "rep").alias("c")), "classes")
    out = sets.join(classes, (F.col("digest") == F.col("d2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of its least id; rows without words or id all stay."""
    found = jaccard_components(docs, k, percent)
    stay = found.filter("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.max(F.col("n_shingles")).alias("_n"))
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "_n")
    # rows without an id are no group: they all stay, outside the join
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # no name of an input column meets one of ours
    rows = docs.filter("doc_id is not null").select(whole, F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_th"))
    rows = rows.join(stay, (F.col("_d") == F.col("_id")) & (F.col("_th") == F.col("_h")))
    again = F.row_number().over(Window.partitionBy("_d", "_th").orderBy(F.lit(1)))
    rows = rows.withColumn("_r", F.when(F.col("_n") > 0, again).otherwise(1)).filter("_r = 1").select("_row.*")
    return rows.unionByName(docs.filter("doc_id is null"))
