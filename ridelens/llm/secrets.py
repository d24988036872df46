"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they occur.
Weak parts (identifiers, short secrets, endpoints) are ordinary text by
themselves; they are reported only when complementary parts lie in one scope:
at most ``scope`` code points apart, or in one block of settings, however long.
A block is a run of lines with one name and value each; a blank line, a section
header or prose ends it. The first is an interval join: each part is put into
the bins its interval touches, an equi-join on (row, bin) finds the meeting
intervals, and semi-joins keep it from multiplying. The second is a semi-join
on (row, block).

Only rows of spans are written and joined, never texts: the texts are scanned
once, in one projection. Positions are running sums of the lengths between and
of the matches, taken in chunks of ``CHUNK`` and chunks of chunks, so the work
is in proportion to the text however many matches it has.

Defined cases: a null or empty text has no spans; repeated rows each get their
own result; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import stage

SCOPE, BIN = 200, 256

# FIXED VALUES: the base kinds in the order in which spans at one start are listed
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more: runs are maximal
MIN_VALUE, MIN_ACCESS = 6, 20
# weak parts: kind -> (role, pattern)
WEAK = {
    "user": ("identifier", r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""),
    "pass": ("secret", r"""(?<![A-Za-z0-9])(?i:pass|pwd|pin|auth|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,}"""),
    "key40": ("secret", r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]*[0-9])(?=[0-9a-z/+]*[A-Z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"),
    "endpoint": ("endpoint", r"""(?<![A-Za-z0-9])(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh|s3)://[^\x20\x09-\x0D"'<>]+|(?<![A-Za-z0-9])(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}"""),
}
# a line of a settings block: one name and one value (env, properties, INI, YAML, JSON), or a comment
SETTING = r"""^[\x20\t]*(?:[#;].*|(?:export\x20+|-\x20+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=][\x20\t]*(?:"[^"]*"|'[^']*'|[^\x20\t]*)[\x20\t]*[,;]?)\r?$"""
KINDS = ["assign", "access", "hex", *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", **{k: r for k, (r, _) in WEAK.items()}}

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, levels: int = 3) -> Column:
    """zero, op(zero, v0), op(op(zero, v0), v1), ...: one entry more than ``values``. An array grows by copying, so
    runs of ``CHUNK`` values are summed by themselves, then their totals the same way, ``levels`` deep."""

    def short(v: Column) -> Column:
        return F.aggregate(v, F.array(zero), lambda s, x: F.array_append(s, op(F.element_at(s, -1), x)))

    def long(v: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return let(F.transform(number, lambda c: short(F.slice(v, c * CHUNK + 1, CHUNK))), joined)

    def joined(chunks: Column) -> Column:
        def moved(before: Column) -> Column:
            each = F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, o: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: op(o, x)))
            return F.concat(F.flatten(each), F.array(F.element_at(before, -1)))

        return let(running(F.transform(chunks, lambda c: F.element_at(c, -1)), op, zero, levels - 1), moved)

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, short(v)).otherwise(long(v))) if levels > 1 else let(values, short)


def spans_of(text: Column, kind: str, pattern: str, least: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of spans in code points. What lies between the
    matches (``split``) and the matches themselves give every position by a running sum of lengths.
    ``least``: which matches stay, as an array of booleans beside them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    keep = least if least is not None else F.transform(hits, lambda h: F.lit(True))
    sizes = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), keep.alias("keep"))

    def found(s: Column) -> Column:
        at = running(F.zip_with(s["gap"], s["hit"], lambda g, h: g + F.coalesce(h, F.lit(0))), lambda a, b: a + b, F.lit(0))
        parts = F.arrays_zip(at.alias("at"), s["gap"].alias("gap"), s["hit"].alias("hit"), s["keep"].alias("keep"))
        return F.transform(F.filter(parts, lambda p: p["hit"].isNotNull() & p["keep"]), lambda p: F.struct(
            (p["at"] + p["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (p["at"] + p["gap"] + p["hit"]).alias("end"), F.lit(kind).alias("kind")))

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(sizes, found)).otherwise(F.array().cast(f"array<{SPAN}>"))


def long_blocks(text: Column, scope: int) -> Column:
    """(a, b) of the blocks of settings longer than the scope, in code points; shorter ones link nothing more."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct((F.length(x) + 1).alias("n"), x.rlike(SETTING).alias("inside")))

    def blocks(s: Column) -> Column:
        at = running(F.transform(s, lambda x: x["n"]), lambda a, b: a + b, F.lit(0))
        inside = F.transform(s, lambda x: x["inside"])
        none = F.array(F.lit(False))

        def ends(p: Column) -> Column:
            # a block begins at a line inside after one outside, and ends before a line outside after one inside
            edges = F.arrays_zip(p["at"].alias("at"), F.concat(p["inside"], none).alias("now"), F.concat(none, p["inside"]).alias("before"))
            first = F.transform(F.filter(edges, lambda e: e["now"] & ~e["before"]), lambda e: e["at"])
            after = F.transform(F.filter(edges, lambda e: ~e["now"] & e["before"]), lambda e: e["at"])
            return F.zip_with(first, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        return F.filter(let(F.struct(at.alias("at"), inside.alias("inside")), ends), lambda b: b["b"] - b["a"] > scope)

    return let(lines, blocks)


def scan(docs: DataFrame, text_col: str = "text", carry: dict[str, Column] | None = None, scope: int = SCOPE) -> DataFrame:
    """One written row per input row: ``rid``, the carried columns, ``base`` spans, ``weak`` spans and long ``blocks``."""
    text = F.col(text_col)
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), 2), lambda v: F.length(v) >= MIN_VALUE)
    long_access = F.transform(F.regexp_extract_all(text, F.lit(ACCESS), 0), lambda v: F.length(v) >= MIN_ACCESS)
    base = F.concat(spans_of(text, "assign", ASSIGN, long_value), spans_of(text, "access", ACCESS, long_access), spans_of(text, "hex", HEX))
    weak = F.concat(*[spans_of(text, k, p) for k, (_, p) in WEAK.items()])
    carry = carry or {"doc_id": F.col("doc_id")}
    found = docs.select(*[c.alias(k) for k, c in carry.items()], F.array_sort(base).alias("base"), weak.alias("weak"), text.alias("_text"))
    found = found.withColumn("blocks", F.when(F.size("weak") > 0, long_blocks(F.col("_text"), scope))).drop("_text")
    return stage(found.withColumn("rid", F.monotonically_increasing_id()), "spans")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, start, rank, end, kind of the weak parts that complementary parts make credible:
    a secret near an identifier, an identifier near a secret, an endpoint near both."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    parts = found.filter(F.size("weak") > 0).select("rid", F.explode(F.concat("base", "weak")).alias("p")).select("rid", "p.*")
    parts = parts.withColumn("role", role[F.col("kind")])
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / BIN), F.floor(last / BIN)))
    blocks = found.filter(F.size("blocks") > 0).select(F.col("rid").alias("r3"), F.explode("blocks").alias("k")).select("r3", "k.*")
    blocks = blocks.withColumn("b3", bins(F.col("a"), F.col("b") - 1))
    inside = (F.col("rid") == F.col("r3")) & (F.floor(F.col("start") / BIN) == F.col("b3")) & (F.col("start") >= F.col("a")) & (F.col("start") < F.col("b"))
    parts = stage(parts.join(blocks, inside, "left").withColumnRenamed("a", "block").drop("r3", "b", "b3"), "parts")
    asked = parts.filter(F.col("kind").isin(*WEAK))

    def near(rows: DataFrame, wanted: str) -> DataFrame:
        """The rows with a part of the wanted role at most ``scope`` code points away or in their block."""
        left = rows.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope))
        right = parts.filter(F.col("role") == wanted).select(F.col("rid").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
        right = right.withColumn("b2", bins(F.col("s2"), F.col("e2")))
        meet = (F.col("rid") == F.col("r2")) & (F.col("bin") == F.col("b2")) & (F.col("start") <= F.col("e2") + scope) & (F.col("s2") <= F.col("end") + scope)
        blocked = parts.filter((F.col("role") == wanted) & F.col("block").isNotNull()).select("rid", "block")
        return left.join(right, meet, "left_semi").drop("bin").unionByName(rows.join(blocked, ["rid", "block"], "left_semi")).distinct()

    by_role = lambda r: asked.filter(F.col("role") == r)
    both = near(near(by_role("endpoint"), "identifier"), "secret")
    return near(by_role("secret"), "identifier").unionByName(near(by_role("identifier"), "secret")).unionByName(both).drop("role", "block")


def find_secrets(docs: DataFrame, text_col: str = "text", carry: dict[str, Column] | None = None, scope: int = SCOPE) -> DataFrame:
    """The carried columns, ``base`` and ``spans`` (base and linked parts), arrays in order of start, then kind."""
    found = scan(docs, text_col, carry, scope)
    more = linked(found, scope).groupBy("rid").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("more"))
    out = found.join(more, "rid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return out.withColumn("spans", spans).drop("rid", "weak", "blocks", "more")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their checksum and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def merged(spans: str) -> Column:
    """(a, b) of the runs of overlapping spans, which are in order of start."""
    def runs(s: Column) -> Column:
        upto = running(F.transform(s, lambda x: x["end"]), F.greatest, F.lit(0))

        def cut(p: Column) -> Column:
            # a run begins at a span that starts no earlier than all before it end
            begins = F.zip_with(F.transform(s, lambda x: x["start"]), F.slice(p, F.lit(1), F.size(s)), lambda a, b: a >= b)

            def ends(b: Column) -> Column:
                each = F.arrays_zip(F.transform(s, lambda x: x["start"]).alias("a"), b.alias("first"), F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.lit(True))).alias("last"),
                                    F.slice(p, F.lit(2), F.size(s)).alias("b"))
                return F.zip_with(F.transform(F.filter(each, lambda e: e["first"]), lambda e: e["a"]),
                                  F.transform(F.filter(each, lambda e: e["last"]), lambda e: e["b"]), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

            return let(begins, ends)

        return let(upto, cut)

    return F.when(F.size(spans) > 0, let(F.col(spans), runs)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def without(wide: Column, runs: Column, length: Column, mark: str) -> Column:
    """The text of four bytes a code point with every run replaced by the mark. Such bytes are cut without reading
    what is before them; a leading byte order mark of ours keeps one of the text's own."""
    def piece(a: Column, b: Column) -> Column:
        return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, a * 4 + 1, (b - a) * 4)), "UTF-32")

    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"]))
    stops = F.concat(F.transform(runs, lambda r: r["a"]), F.array(length))
    return F.array_join(F.zip_with(starts, stops, piece), mark)


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every reported span replaced by the mark; ``n_chars`` follows the new text.
    Spans meet their text again by id and text hash; rows without spans are untouched."""
    carry = {"_id": F.col(id_col), "_h": F.xxhash64(text_col)}
    found = find_secrets(docs, text_col, carry).filter(F.size("spans") > 0).select("_id", "_h", "spans").dropDuplicates(["_id", "_h"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # no name of an input column meets one of ours
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("_d"), F.col(f"`{text_col}`").alias("_text"))
    out = rows.join(found, F.col("_d").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_h")), "left").withColumn("_runs", merged("spans"))
    text, hit = F.col("_text"), F.size("_runs") > 0
    clean = let(F.encode(text, "UTF-32"), lambda wide: without(wide, F.col("_runs"), F.length(text), mark))
    out = out.withColumn("_clean", F.when(hit, clean).otherwise(text))
    new = {text_col.lower(): F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(F.col(f"_row.`{c}`") if new.get(c.lower()) is None else new[c.lower()]).alias(c) for c in docs.columns])
