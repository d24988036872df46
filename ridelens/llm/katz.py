"""Scoring by a Katz backoff bigram model learned from the corpus itself.

p(w | h) = d(r) r / c(h) for a pair seen r times, else a(h) p(w). The Good-Turing
discounts d come from the counts of counts of all pairs (and of all words for
p), smoothed by a log-linear fit where groups of copies distort them, and a(h) = (1 - seen mass) / (1 - p of the words seen after h) makes every
history sum to one exactly. Unknown words share one class, which gets the mass
that discounting the words leaves.

The tables are partitioned by key and never broadcast or collected:

1. Documents are dealt into batches of about ``BATCH`` bytes of text, repeats of one row over several.
2. Each batch sends its distinct words with training counts to the word's
   partition, which sums them and answers with total counts and word numbers.
3. Each batch sends its distinct pairs to the partition of the history. A
   history with more than a quarter of a mean partition is split by the
   second word; there are at most 4 x partitions of those. The partition sums
   the pairs and answers with total counts, and with a history's statistics
   where the batch has a pair never seen.
4. Each batch scores its texts. Counts of counts and the split histories'
   statistics, bounded in number, come as one row.

So a word or pair that holds a third of the corpus is one entry per batch. The
texts are shuffled once; the three steps read that exchange again.

Defined cases: a null text is the end token alone; a null id is trained on;
repeated rows count each; with no training row every token is unknown and
scores log10(1); an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm import textnum as X

BATCH, SHARD = 8 << 20, 32 << 20  # bytes of text of a batch, and for each partition of the tables
SALTS = 64
CUTOFF = 5  # counts above are not discounted
FOLDS, HELD_FOLD = 7, 2
END = np.uint64(0x656E645F746F6B65)  # the end token's key; words' keys are 64-bit hashes
CLASSES = CUTOFF + 2  # numbers of count 1 .. CUTOFF + 1, and the sum of larger counts' occurrences

#: messages between batches and partitions; a payload is an Arrow table, compressed
REQUEST = "shard int, batch long, payload binary"
ANSWER = "batch long, shard int, kind string, payload binary, name long, classes array<long>, pairs array<long>, split array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def slope(n: np.ndarray) -> float | None:
    """Slope of log n[r] over log r (Simple Good-Turing): a count is averaged over the zero counts around it, and weighs
    as much as it is sure. None where fewer than two are not zero."""
    r = np.flatnonzero(n[1 : CUTOFF + 2] > 0) + 1
    if len(r) < 2:
        return None
    low, high = np.concatenate([[0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    return float(np.polyfit(np.log(r), np.log(2 * n[r] / (high - low)), 1, w=np.sqrt(n[r]))[0])


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0 .. CUTOFF from n[r] = number of events with count r (n[CUTOFF + 1] is the last): Good-Turing with
    the counts of counts as they are where every d[r] is proper, else with those of a log-linear fit, which are proper
    wherever the fit falls faster than 1 / r. Where it does not, half an occurrence is taken off at each improper r."""
    r = np.arange(1, CUTOFF + 1)
    proper, d = np.zeros(CUTOFF, dtype=bool), np.zeros(CUTOFF)
    if (n[1 : CUTOFF + 2] > 0).all() and (tail := (CUTOFF + 1) * n[CUTOFF + 1] / n[1]) < 1:
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
        proper = (d > 0) & (d < 1)
    if not proper.all() and (b := slope(n)) is not None and b < -1:
        tail = (CUTOFF + 1) ** (b + 1)
        d = ((1 + 1 / r) ** (b + 1) - tail) / (1 - tail)
        proper = (d > 0) & (d < 1)
    return np.concatenate([[0.0], np.where(proper, d, (r - 0.5) / r)])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r"""
    return np.where(counts <= CUTOFF, d[np.minimum(counts, CUTOFF)], 1.0) * counts


def by_class(counts: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Per group: how many counts are 1, 2, .. CUTOFF + 1, and the sum of the counts over CUTOFF."""
    out = np.zeros((n, CLASSES), dtype=np.int64)
    few = (counts >= 1) & (counts <= CUTOFF + 1)
    np.add.at(out, (group[few], counts[few] - 1), 1)
    many = counts > CUTOFF
    np.add.at(out, (group[many], CLASSES - 1), counts[many])
    return out


def mass(classes: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum of d(r) r over what by_class counted."""
    return classes[..., :CUTOFF] @ (d[1:] * np.arange(1, CUTOFF + 1)) + classes[..., -1]


def bare(classes: np.ndarray) -> np.ndarray:
    """1 where nothing is rare enough to be discounted: there one occurrence is set aside, to leave some mass."""
    return (classes[..., :CUTOFF].sum(axis=-1) == 0).astype(np.int64)


def occurrences(classes: np.ndarray) -> np.ndarray:
    return classes[..., :CUTOFF] @ np.arange(1, CUTOFF + 1) + classes[..., -1]


class Model:
    """The bounded global numbers: discounts of both orders and the word level's divisor."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.tokens = int(occurrences(words))
        self.word_d = discounts(np.concatenate([[0], words[: CUTOFF + 1]]))
        self.pair_d = discounts(np.concatenate([[0], pairs[: CUTOFF + 1]]))
        self.divisor = max(self.tokens + int(bare(words)), 1)
        self.unknown = 1 - float(mass(words, self.word_d)) / self.divisor

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.word_d) / self.divisor, self.unknown)

    def backoff(self, stats: np.ndarray) -> np.ndarray:
        """a(h) from the classes of a history's pair counts, then of its words' counts."""
        pairs, words = stats[..., :CLASSES], stats[..., CLASSES:]
        left = 1 - mass(pairs, self.pair_d) / np.maximum(occurrences(pairs) + bare(pairs), 1)
        return np.where(occurrences(pairs) > 0, left / (1 - mass(words, self.word_d) / self.divisor), 1.0)


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, after) of each run of equal values."""
    if not len(values):
        return []
    first = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    return [(int(values[a]), a, z) for a, z in zip(first, [*first[1:], len(values)])]


def packed(**columns: np.ndarray) -> bytes:
    """Columns of equal length as a compressed Arrow stream: sorted numbers and small counts shrink to a few bytes."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(payload.as_buffer() if isinstance(payload, pa.Scalar) else payload).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def joined(payloads: list[dict[str, np.ndarray]], column: str) -> np.ndarray:
    return np.concatenate([p[column] for p in payloads]) if payloads else np.zeros(0, dtype=np.int64)


def messages(answers: pa.Table, kind: str) -> list[tuple[int, dict[str, np.ndarray]]]:
    """(partition, payload) of the answers of a kind, in order of the partitions."""
    rows = zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("payload"))
    return sorted(((s, unpacked(p)) for k, s, p in rows if k == kind), key=lambda x: x[0])


def globals_of(answers: pa.Table) -> dict[str, np.ndarray]:
    at = answers.column("kind").to_pylist().index("globals")
    return {c: np.array(answers.column(c)[at].as_py() or [], dtype=np.int64) for c in ("classes", "pairs", "split")}


class Batch:
    """A batch's tokens: ``words`` are its distinct keys in order, ``token`` and ``doc`` one entry per token."""

    def __init__(self, table: pa.Table):
        self.ids, self.held = table.column("doc_id"), table.column("held_out").to_numpy()
        docs, keys = [], []
        for first, _, t in X.slices(table.column("text"), lower=True):
            docs += [t.doc + first, np.arange(t.n) + first]
            keys += [t.hash, np.full(t.n, END)]
        doc = np.concatenate(docs)
        order = np.argsort(doc, kind="stable")  # the ends come after their document's words
        self.doc = doc[order]
        self.words, token = np.unique(np.concatenate(keys), return_inverse=True)
        self.token = token[order]
        self.train = ~self.held[self.doc]
        self.n_docs = table.num_rows

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train], minlength=len(self.words))

    def shards(self, n: int) -> np.ndarray:
        return ((self.words >> np.uint64(33)) % np.uint64(n)).astype(np.int64)

    def answered(self, answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and training counts from the partitions' answers."""
        number, count, shard = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64), self.shards(n)
        for part, payload in messages(answers, "word"):
            number[shard == part], count[shard == part] = payload["number"], payload["count"]
        return number, count

    def pairs(self, number: np.ndarray, count: np.ndarray, tokens: int, n: int):
        """Distinct pairs in order of (partition, history, word): partition, history number, word position,
        training count, and the pair of each token. History 0 begins a document; words' numbers start at 1."""
        width = len(self.words) + 1
        before = np.zeros(len(self.token), dtype=np.int64)
        before[1:] = self.token[:-1] + 1
        before[np.flatnonzero(np.diff(self.doc, prepend=-1))] = 0
        key, which = np.unique(before * width + self.token, return_inverse=True)
        history, word = key // width, key % width
        h = np.concatenate([[0], number])[history]
        h_count = np.concatenate([[count[np.searchsorted(self.words, END)]], count])[history]
        split = h_count * 4 * n > tokens
        shard = (np.where(split, h + number[word], h)) % n
        order = np.lexsort((number[word], h, shard))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        seen = np.bincount(which[self.train], minlength=len(key))
        return shard[order], h[order], h_count[order], split[order], word[order], seen[order], place[which]


LONGS = pa.list_(pa.int64())
ASK = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary())])
ANSWERS = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("kind", pa.string()), ("payload", pa.binary()), ("name", pa.int64()),
                     *[(c, LONGS) for c in ("classes", "pairs", "split")]])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")],
                    ("base_score", pa.float64()), ("score", pa.float64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _ask_words(n: int):
    def run(table: pa.Table) -> pa.Table:
        b = Batch(table)
        shard, counts, batch = b.shards(n), b.counts(), table.column("batch")[0].as_py()
        return _rows([(s, batch, packed(words=b.words[shard == s], counts=counts[shard == s])) for s in np.unique(shard).tolist()], ASK)

    return run


def _total_words(table: pa.Table):
    asked = [unpacked(p) for p in table.column("payload")]
    words, at = np.unique(joined(asked, "words"), return_inverse=True)
    return asked, words, at, np.bincount(at, weights=joined(asked, "counts"), minlength=len(words)).astype(np.int64)


def _sum_words(n: int):
    """Per batch the numbers and counts of its words, and one row with the partition's counts of counts."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked, _, at, total = _total_words(table)
        classes = by_class(total, np.zeros(len(total), np.int64), 1)[0]
        rows = [(None, shard, "words", None, None, [*classes, int((total > 0).sum())], None, None)]
        to = 0
        for batch, mine in zip(table.column("batch").to_pylist(), asked):
            part = at[to : to + len(mine["words"])]
            rows.append((batch, shard, "word", packed(number=part * n + shard + 1, count=total[part]), None, None, None, None))
            to += len(part)
        return _rows(rows, ANSWERS)

    return run


def _ask_pairs(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ASK.empty_table()
        b, batch = Batch(left), left.column("batch")[0].as_py()
        number, count = b.answered(right, n)
        shard, h, _, split, word, seen, _ = b.pairs(number, count, int(occurrences(globals_of(right)["classes"][:CLASSES])), n)
        w, c = number[word], count[word]
        return _rows([(s, batch, packed(h=h[a:z], split=split[a:z].astype(np.int8), w=w[a:z], count=c[a:z], n=seen[a:z])) for s, a, z in runs(shard)], ASK)

    return run


def _total_pairs(table: pa.Table):
    """The requests; of each entry its pair; of each pair its first entry and its total."""
    asked = [unpacked(p) for p in table.column("payload")]
    h, w = joined(asked, "h"), joined(asked, "w")
    order = np.lexsort((w, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    total = np.bincount(at, weights=joined(asked, "n"), minlength=int(new.sum())).astype(np.int64)
    return asked, h, w, at, order[new], total


def _sum_pairs(answers: bool):
    """Totals of a partition's pairs. ``answers``: per batch its pairs' totals, its histories that leave no mass, and
    the statistics of those with an unseen pair there. Else: counts of counts, and the split histories' statistics."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked, h, _, at, first, total = _total_pairs(table)
        names, group = np.unique(h[first], return_inverse=True)
        is_split = np.zeros(len(names), dtype=bool)
        is_split[group[joined(asked, "split")[first] > 0]] = True
        stats = np.concatenate([by_class(total, group, len(names)), by_class(np.where(total > 0, joined(asked, "count")[first], 0), group, len(names))], axis=1)
        if not answers:
            rows = [(None, shard, "pairs", None, None, by_class(total, np.zeros(len(total), np.int64), 1)[0], None, None)]
            return _rows(rows + [(None, shard, "split", None, int(names[k]), stats[k], None, None) for k in np.flatnonzero(is_split)], ANSWERS)
        rows, to = [], 0
        empty = (bare(stats[:, :CLASSES]) == 1) & ~is_split
        for batch, mine in zip(table.column("batch").to_pylist(), asked):
            part = at[to : to + len(mine["h"])]
            unseen = np.unique(group[part[total[part] == 0]])
            unseen = unseen[~is_split[unseen]]
            own = np.unique(group[part])
            rows.append((batch, shard, "pair", packed(total=total[part]), None, None, None, None))
            rows.append((batch, shard, "history", packed(name=names[unseen], **{f"s{i}": stats[unseen, i] for i in range(2 * CLASSES)}), None, None, None, None))
            rows.append((batch, shard, "bare", packed(name=names[own[empty[own]]]), None, None, None, None))
            to += len(part)
        return _rows(rows, ANSWERS)

    return run


def _score(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORED.empty_table()
        b, whole = Batch(left), globals_of(right)
        model, vocabulary = Model(whole["classes"][:CLASSES], whole["pairs"]), int(whole["classes"][CLASSES])
        number, count = b.answered(right, n)
        _, h, h_count, _, word, _, place = b.pairs(number, count, model.tokens, n)
        r = joined([p for _, p in messages(right, "pair")], "total")
        told = [p for _, p in messages(right, "history")]
        split = whole["split"].reshape(-1, 1 + 2 * CLASSES)
        names = np.concatenate([split[:, 0], joined(told, "name")])
        stats = np.concatenate([split[:, 1:], np.stack([joined(told, f"s{i}") for i in range(2 * CLASSES)], axis=1)])
        none = np.concatenate([split[bare(split[:, 1 : 1 + CLASSES]) == 1, 0], joined([p for _, p in messages(right, "bare")], "name")])

        p = discounted(r, model.pair_d) / np.maximum(h_count + np.isin(h, none), 1)
        unseen = np.flatnonzero(r == 0)
        if len(unseen):
            order = np.argsort(names, kind="stable")
            spot = order[np.minimum(np.searchsorted(names[order], h[unseen]), len(names) - 1)]
            p[unseen] = model.backoff(stats[spot]) * model.word(count[word[unseen]])
        of = lambda values: np.bincount(b.doc, weights=values, minlength=b.n_docs)
        known = count[b.token]
        base = np.log10((known + 1) / (model.tokens + vocabulary + 1))
        return pa.table([b.ids.combine_chunks(), pa.array(b.held), pa.array(np.bincount(b.doc, minlength=b.n_docs)), pa.array(of(known > 0).astype(np.int64)),
                         pa.array(np.full(b.n_docs, model.tokens)), pa.array(of(base)), pa.array(of(np.log10(p)[place]))], schema=SCORED)

    return run


def _word_rows(n: int):
    def run(table: pa.Table) -> pa.Table:
        _, words, _, total = _total_words(table)
        shard = table.column("shard")[0].as_py()
        out = pa.table({"shard": pa.array(np.full(len(words), shard, np.int32)), "number": np.arange(len(words)) * n + shard + 1, "key": words.view(np.int64), "count": total})
        return out.filter(pa.array(total > 0))

    return run


def _pair_rows(table: pa.Table) -> pa.Table:
    _, h, w, _, first, total = _total_pairs(table)
    shard = table.column("shard")[0].as_py()
    out = pa.table({"shard": pa.array(np.full(len(first), shard, np.int32)), "history": h[first], "word": w[first], "count": total})
    return out.filter(pa.array(total > 0))


class Plan:
    """The steps that scores and tables share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, batch_bytes: int, parts: int | None):
        self.spark = docs.sparkSession
        key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(key) % FOLDS == HELD_FOLD).alias("held_out"), F.col(text_col).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.batches = max(1, math.ceil(size / batch_bytes))
        # a partition holds its share of all requests: their number follows the text
        self.n = n = parts or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD))
        # the salt keeps repeats of one row out of one batch
        salt = F.monotonically_increasing_id() % SALTS
        self.texts = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(self.batches))).repartition(n, "batch")
        self.asked_words = self.texts.groupBy("batch").applyInArrow(_ask_words(n), REQUEST)
        words = self.asked_words.groupBy("shard").applyInArrow(_sum_words(n), ANSWER)
        self.totals = words.filter("kind = 'words'").agg(self.add(CLASSES + 1).alias("x")).scalar()
        self.told = words.filter("kind = 'word'")
        right = self.with_globals(self.told, classes=self.totals)
        self.asked_pairs = self.texts.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_ask_pairs(n), REQUEST)

    @staticmethod
    def add(k: int):
        return F.array(*[F.coalesce(F.sum(F.col("classes")[i]), F.lit(0)) for i in range(k)])

    def with_globals(self, answers: DataFrame, **found) -> DataFrame:
        """Beside the answers, one row per batch with the global numbers."""
        kept = {"kind": F.lit("globals"), "batch": F.col("id"), **found}
        one = self.spark.range(self.batches).select(*[kept.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in answers.schema])
        return answers.unionByName(one)


def write_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, parts: int | None = None) -> None:
    """Writes the model: ``words`` (number, 64-bit key, count) and ``pairs`` (numbers of history and word, count;
    history 0 begins a document), each partitioned by ``shard``. A word's number names its shard: (number - 1) % parts."""
    plan = Plan(docs, id_col, text_col, batch_bytes, parts)
    tables = {"words": plan.asked_words.groupBy("shard").applyInArrow(_word_rows(plan.n), "shard int, number long, key long, count long"),
              "pairs": plan.asked_pairs.groupBy("shard").applyInArrow(_pair_rows, "shard int, history long, word long, count long")}
    for name, table in tables.items():
        table.write.partitionBy("shard").parquet(f"{path}/{name}")


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability) per row."""
    plan = Plan(docs, id_col, text_col, batch_bytes, parts)
    asked = plan.asked_pairs.groupBy("shard")
    sums = asked.applyInArrow(_sum_pairs(False), ANSWER)
    pairs = sums.filter("kind = 'pairs'").agg(plan.add(CLASSES).alias("x")).scalar()
    # at most 4 n histories can hold more than 1 / (4 n) of the tokens each
    split = sums.filter("kind = 'split'").groupBy("name").agg(plan.add(2 * CLASSES).alias("s"))
    split = split.agg(F.flatten(F.collect_list(F.concat(F.array("name"), "s"))).alias("x")).scalar()
    found = asked.applyInArrow(_sum_pairs(True), ANSWER)
    right = plan.with_globals(plan.told.unionByName(found), classes=plan.totals, pairs=pairs, split=split)
    return plan.texts.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_score(plan.n), SCORES)
