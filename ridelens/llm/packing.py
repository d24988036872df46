"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

1. Documents become pieces of at most ``capacity`` tokens (one pass over the
   texts; only ids, lengths and checksums go on, written once).
2. Pieces are dealt round-robin into blocks of about ``BLOCK`` pieces: an
   instance small enough for one task, whatever the corpus size. A block loses
   less than one sequence against its own lower bound when it reaches it.
3. Each block is solved on several islands. A genome is a set of bins.
   Crossover injects whole well-filled bins of one parent into the other,
   drops the bins that now hold duplicates, and best-fits the displaced pieces.
   After an epoch each island's elite goes to the next island of its block.
   Blocks whose elite meets the lower bound ceil(tokens / capacity) are solved
   and leave the search; the others go on for ``EPOCHS`` rounds.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each by itself; a null id is carried; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import stage

CAPACITY, END_ID = 1024, 2
BLOCK, ISLANDS, EPOCHS = 16_384, 3, 2
POPULATION, GENERATIONS, WELL_FILLED = 4, 6, 0.98
#: the ranks of the same vocabulary as byte_bpe_50k.json: the same ids, several times faster (compared in the tests)
TOKENIZER, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one with the rest."""
    rest = n % capacity or capacity
    starts = [0, *range(rest, n, capacity)] if n > capacity else [0]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def encoder(path: str):
    """The byte-level BPE of a rank file; as in its JSON form, the special token's string in a text is that token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache
def json_encoder(path: str):
    """The JSON form of the same vocabulary, beside the rank file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def encode(path: str, text: str) -> list[int]:
    """The ids of a text. The rank file's encoder raises at blank runs of about a million code points (its pattern
    backtracks over them); such a text goes through the JSON form, which gives the same ids."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return json_encoder(path).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. ``tokenizer``: a rank file present on every executor,
    with its JSON form beside it."""
    where = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.array([*encode(where, text.as_py() or ""), END_ID], dtype="<u4")
                made += [(key, j, s, n, zlib.crc32(found[s : s + n].tobytes())) for j, (s, n) in enumerate(cut(len(found), capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*made)) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class Open:
    """Bins by free space: best fit in O(1), with a bit set of the spaces that some bin has."""

    def __init__(self, capacity: int):
        self.spaces: dict[int, list[int]] = {}
        self.bits, self.capacity = 0, capacity

    def add(self, bin_: int, free: int) -> None:
        self.spaces.setdefault(free, []).append(bin_)
        self.bits |= 1 << free

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least free space of ``need`` or more, and that space."""
        fitting = self.bits >> need
        if not fitting:
            return None
        free = need + (fitting & -fitting).bit_length() - 1
        bins = self.spaces[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return found, free


def best_fit(order: list[int], lens: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Adds the items, in the order given, each to the bin that it fills best, else to a new one."""
    space = Open(capacity)
    for k, items in enumerate(bins):
        free = capacity - sum(lens[i] for i in items)
        if free:
            space.add(k, free)
    for i in order:
        at = space.take(lens[i])
        if at is None:
            bins.append([])
            at = (len(bins) - 1, capacity)
        bins[at[0]].append(i)
        if at[1] > lens[i]:
            space.add(at[0], at[1] - lens[i])
    return bins


def fitness(bins: list[list[int]], lens: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then well-filled bins beside emptier ones, which later crossovers can empty."""
    return len(bins), -sum((sum(lens[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    good = [x for x in a if sum(lens[i] for i in x) >= WELL_FILLED * capacity]
    injected = rng.sample(good, (len(good) + 1) // 2)
    inside = {i for x in injected for i in x}
    child, displaced = [list(x) for x in injected], []
    for x in b:
        if inside.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return best_fit(sorted(displaced, key=lambda i: -lens[i]), lens, child, capacity)


def mutate(bins: list[list[int]], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the worst-filled bins and a few others, then best-fits their items."""
    order = sorted(range(len(bins)), key=lambda k: sum(lens[i] for i in bins[k]))
    out = {*order[: 2 + len(order) // 50], *rng.sample(order, min(len(order), 3))}
    loose = [i for k in out for i in bins[k]]
    return best_fit(sorted(loose, key=lambda i: -lens[i] * rng.uniform(0.9, 1.1)), lens, [list(x) for k, x in enumerate(bins) if k not in out], capacity)


def evolve(lens: list[int], capacity: int, seed: int, given: list[list[list[int]]]) -> list[list[int]]:
    """The best genome of one island after an epoch that starts from the given ones. Pieces that fill a bin
    by themselves stay out of the search."""
    full = [[i] for i, n in enumerate(lens) if n == capacity]
    loose = sorted((i for i, n in enumerate(lens) if n < capacity), key=lambda i: -lens[i])
    rng, least = random.Random(seed), -(-sum(lens[i] for i in loose) // capacity)
    rated = lambda g: (fitness(g, lens, capacity), g)
    people = [rated([b for b in g if lens[b[0]] < capacity]) for g in given] or [rated(best_fit(loose, lens, [], capacity))]
    best = min(people, key=lambda x: x[0])
    if len(best[1]) > least:
        while len(people) < POPULATION:
            noisy = sorted(loose, key=lambda i: -lens[i] * rng.uniform(0.8, 1.2))
            people.append(rated(best_fit(noisy, lens, [], capacity)))
        for _ in range(GENERATIONS):
            people.sort(key=lambda x: x[0])
            if len(people[0][1]) <= least:
                break
            (_, a), (_, b) = rng.sample(people[: max(2, POPULATION // 2)], 2)
            people[-1] = rated(crossover(a, b, lens, capacity, rng))
            people[-2] = rated(mutate(people[0][1], lens, capacity, rng))
        best = min(people, key=lambda x: x[0])
    return full + best[1]


def _genome(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _bins(genome) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(max(genome)) + 1)]
    for i, k in enumerate(genome):
        out[int(k)].append(i)
    return out


def _epoch(people: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """people: block, island, lens, seeds (array of genomes) -> block, island, genome, n_bins, least."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for block, island, lens, seeds in zip(pdf.block, pdf.island, pdf.lens, pdf.seeds):
                lens = [int(x) for x in lens]
                best = evolve(lens, capacity, hash((int(block), int(island), epoch)), [_bins(g) for g in seeds])
                made.append((block, island, _genome(best, len(lens)), len(best), -(-sum(lens) // capacity)))
            yield pd.DataFrame(made, columns=["block", "island", "genome", "n_bins", "least"])

    return people.select("block", "island", "lens", "seeds").mapInPandas(run, "block long, island int, genome array<int>, n_bins int, least int")


def pack(found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces (a written table)."""
    total = found.count()
    n_blocks = max(1, math.ceil(total / block))
    dealt = found.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)))
    items = F.collect_list(F.struct(*found.columns)).alias("items")
    blocks = stage(dealt.groupBy("block").agg(items).withColumn("lens", F.transform("items", lambda x: x["length"].cast("int"))), "blocks")
    lens = blocks.select("block", "lens")
    people = lens.withColumns({"island": F.explode(F.array(*[F.lit(i) for i in range(islands)])), "seeds": F.array().cast("array<array<int>>")})
    # the search is long for its few bytes: a few islands a task, whatever their size
    spread = lambda rows: rows.repartition(math.ceil(n_blocks * islands / 4), "block", "island")
    # the first island's start is best-fit decreasing: where it meets the bound, no island is needed
    best = stage(_epoch(people.filter("island = 0"), capacity, 0), "packed")
    done = [best.filter("n_bins <= least")]
    state = stage(best.filter("n_bins > least").unionByName(
        _epoch(spread(people.filter("island > 0").join(best.filter("n_bins > least").select("block"), "block")), capacity, 0)), "islands")
    for epoch in range(1, epochs + 1):
        elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("genome").alias("elite"))
        migrated = state.join(elite, ["block", "island"]).join(lens, "block").withColumn("seeds", F.array("genome", "elite"))
        state = stage(_epoch(spread(migrated), capacity, epoch), "islands")
    done.append(state.withColumn("_r", F.row_number().over(Window.partitionBy("block").orderBy("n_bins", "island"))).filter("_r = 1").drop("_r"))
    solved = done[0].unionByName(done[1]).select("block", "genome")
    rows = blocks.select("block", "items").join(solved, "block").select("block", F.explode(F.arrays_zip("items", "genome")).alias("z"))
    rows = rows.select("z.items.*", (F.col("block") * F.lit(1 << 20) + F.col("z.genome")).alias("sequence_id"))
    place = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)))


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and place there."""
    return pack(stage(pieces(docs, tokenizer, capacity), "pieces"), capacity)
