"""Document fingerprints as invertible Bloom look-up sketches, in DataFrame functions only.

A text is cut into paragraphs; each paragraph's digest goes into one cell of each of three
tables. Two sketches are subtracted cell by cell; peeling recovers the digests in which the
texts differ, and on which side. Where the small sketch that is kept does not peel, its
counts tell about how many digests differ, and larger ones are made for that many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogue_factors.llm.common import bounded
from dialogue_factors.session import materialize

TABLES = 3
# Bits of a cell's number in the sketch that is kept and in a group of a larger one.
KEPT_BITS = 3
# Bits of the retries of a group, and where in a digest they begin.
RETRIES = {4: 22, 7: 10}
# Differing digests that a group of a larger sketch has on average, by estimate.
GROUP_DIGESTS = 6
# The estimate is off by about 0.3 of itself; larger sketches are made for a quarter more.
ESTIMATE_MARGIN = 1.25
PEELING_ROUNDS = 16
# A paragraph is a line; longer ones go on in a new piece after so many words.
PIECE_WORDS = 16
# Ids of one window of neighbours.
WINDOW_BITS = 8
SINGLE_WINDOW = 10_000

Function = Callable[[Column], Column]


def let(value: Column, body: Function) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: lines, cut after `PIECE_WORDS` words."""
    pieces = F.flatten(F.transform(
        F.split(text, r"\n+"), lambda p: F.regexp_extract_all(p, F.lit(rf"\S+(?:\s+\S+){{0,{PIECE_WORDS - 1}}}"), F.lit(0))
    ))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(signed: Column, table: int, bits: int) -> Column:
    """`(n, k)` entries with their check and their cell `j` of a table: each table reads its
    own bits of a digest, and retries read other bits."""
    shift = table * bits + RETRIES.get(bits, 0)
    cell = lambda x: F.shiftrightunsigned(x.k, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.transform(signed, lambda x: F.struct(x.n.alias("n"), x.k.alias("k"), _check(x.k).alias("c"), cell(x).alias("j")))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), key.alias("k"), check.alias("c"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _fold(placed: Column, j: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The entries of cell `j` taken into `start` one by one."""
    return F.aggregate(placed, start, lambda a, x: F.when(x.j == j, step(a, x)).otherwise(a))


def signed(values: Column, sign: int) -> Column:
    """Digests as entries of a sketch, to be added (1) or taken away (-1)."""
    return F.transform(values, lambda d: F.struct(F.lit(sign).cast("long").alias("n"), d.alias("k")))


def sketch(entries: Column, bits: int = KEPT_BITS) -> Column:
    """Cells of entries: their number, and the xor of them and of their checks. Entries of
    both signs make the difference of two sketches at once."""
    add = lambda a, x: _cell(a.n + x.n, a.k.bitwiseXOR(x.k), a.c.bitwiseXOR(x.c))
    table = lambda t: let(
        _placed(entries, t, bits),
        lambda placed: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda j: _fold(placed, j, _zero(), add)),
    )
    return F.flatten(F.array(*[table(t) for t in range(TABLES)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x.n - y.n, x.k.bitwiseXOR(y.k), x.c.bitwiseXOR(y.c)))


def peel(cells: Column, bits: int = KEPT_BITS) -> Column:
    """The digests of a difference as `(n, k)`, n = 1 on the left side only and -1 on the
    right only; null if cells are left after peeling.

    Each round takes the digests of all pure cells out of their cells at once; a digest
    that is pure in several cells counts once."""

    remove = lambda a, x: _cell(a.n - x.n, a.k.bitwiseXOR(x.k), a.c.bitwiseXOR(x.c))

    def without(cells: Column, pure: Column) -> Column:
        table = lambda t: let(_placed(pure, t, bits), lambda placed: F.transform(
            F.slice(cells, (t << bits) + 1, 1 << bits), lambda c, j: _fold(placed, j, c, remove)
        ))
        return F.flatten(F.array(*[table(t) for t in range(TABLES)]))

    def one_round(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state.cells, lambda c: (F.abs(c.n) == 1) & (_check(c.k) == c.c)), lambda c: F.struct(c.n.alias("n"), c.k.alias("k"))
        ))
        peeled = let(pure, lambda p: F.struct(
            F.when(F.size(p) > 0, without(state.cells, p)).otherwise(state.cells).alias("cells"),
            F.concat(state.found, p).alias("found"), (F.size(p) > 0).alias("more"),
        ))
        return F.when(state.more, peeled).otherwise(state)

    none = F.array().cast("array<struct<n:bigint,k:bigint>>")
    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("more"))
    empty = lambda s: ~F.exists(s.cells, lambda c: (c.n != 0) | (c.k != 0) | (c.c != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELING_ROUNDS)), start, one_round, lambda s: F.when(empty(s), s.found))


def estimate(cells: Column, a: Column, b: Column) -> Column:
    """About how many digests differ, from the counts of a subtracted sketch.

    The squared counts of a table's m cells add up to D + (d * d - D) / m on average, d
    being the difference of the sizes; D is at least |d| and at most both sizes together."""
    m, d = 1 << KEPT_BITS, F.size(a) - F.size(b)
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c.n * c.n) / TABLES
    return F.least(F.greatest((m * squares - d * d) / (m - 1), F.abs(d).cast("double"), F.lit(1.0)), (F.size(a) + F.size(b)).cast("double"))


def _larger(entries: Column, expected: Column) -> Column:
    """The difference by a sketch of as many groups of cells as the differing digests need.

    A group is a sketch of its own. One that does not peel is retried with more cells, read
    from other bits, and one that fails again is compared by its digests (a group would
    have to differ in hundreds, or two digests to agree in 21 bits)."""
    def exact(values: Column) -> Column:
        side = lambda n: F.transform(F.filter(values, lambda v: v.n == n), lambda v: v.k)
        return F.concat(signed(F.array_except(side(1), side(-1)), 1), signed(F.array_except(side(-1), side(1)), -1))

    def group(values: Column) -> Column:
        return F.coalesce(*[peel(sketch(values, bits), bits) for bits in (KEPT_BITS, *RETRIES)], exact(values))

    # Groups of groups, so that dealing digests out costs their number times its root.
    groups = expected * ESTIMATE_MARGIN / GROUP_DIGESTS
    high = F.ceil(F.sqrt(groups))
    shape = F.struct(high.cast("int").alias("high"), F.ceil(groups / high).cast("int").alias("wide"))
    part = lambda values, g, w, shift: F.filter(values, lambda v: F.pmod(F.shiftrightunsigned(v.k, shift), w) == g)
    every = lambda w: F.sequence(F.lit(0), w - 1)

    def row(s: Column, g: Column) -> Column:
        return let(part(entries, g, s.high, 34), lambda p: F.flatten(F.transform(every(s.wide), lambda h: let(part(p, h, s.wide, 49), group))))

    return let(shape, lambda s: F.flatten(F.transform(every(s.high), lambda g: row(s, g))))


def differences(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests that only one of two texts has, as `(n, k)`: n = 1 for the first's."""
    larger = lambda cells: let(F.concat(signed(a, 1), signed(b, -1)), lambda e: _larger(e, estimate(cells, a, b)))
    return let(subtract(sketch_a, sketch_b), lambda cells: F.coalesce(peel(cells), larger(cells)))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Jaccard similarity of the paragraphs, from the digests that differ."""
    both, d = F.size(a) + F.size(b), F.size(differ)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def as_text(cells: Column, values: Column) -> Column:
    """A fingerprint: the number of digests and the cells, 13 bytes each, in base 64."""
    hexed = lambda c, size: F.lpad(F.hex(c), size, "0")
    packed = F.array_join(F.transform(cells, lambda c: F.concat(hexed(F.pmod(c.n, F.lit(256)), 2), hexed(c.k, 16), hexed(c.c, 8))), "")
    return F.concat(F.size(values).cast("string"), F.lit(":"), F.translate(F.base64(F.unhex(packed)), "\r\n", ""))


def _previous(keys: DataFrame) -> DataFrame:
    """`k, prev`: the next smaller of distinct numbers. Larger tables go by windows of
    numbers that lie close, and those by the same rule one level up."""
    if keys.count() <= SINGLE_WINDOW:
        return keys.withColumn("prev", F.lag("k").over(Window.orderBy("k")))
    grouped = keys.withColumn("g", F.shiftright("k", WINDOW_BITS))
    within = grouped.withColumn("lag", F.lag("k").over(Window.partitionBy("g").orderBy("k")))
    ends = materialize(grouped.groupBy("g").agg(F.max("k").alias("last")), "ends")
    above = _previous(ends.select(F.col("g").alias("k")))
    ends = above.select(F.col("k").alias("g"), F.col("prev").alias("pg")).join(ends.select(F.col("g").alias("pg"), "last"), "pg")
    return within.join(ends.select("g", "last"), "g", "left").select("k", F.coalesce("lag", "last").alias("prev"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """`doc_id, text, next_text, bucket, real`: each text with the next by `doc_id`, the
    first following the last. Texts are shuffled once, in windows of 256 ids; the first
    row of a window is also sent to the window before (`real` is false there). Null ids
    come first, equal ids go by a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.coalesce(F.shiftright("doc_id", WINDOW_BITS), F.lit(-(1 << 62)))
    rows = rows.withColumn("bucket", bucket).withColumn("h", F.xxhash64("text"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "h")).alias("f")
    heads = materialize(rows.groupBy("bucket").agg(first), "heads")
    before = _previous(heads.select(F.col("bucket").alias("k")))
    last = heads.agg(F.max("bucket").alias("m")).first().m
    heads = heads.join(before, heads.bucket == before.k).select(
        F.col("f.doc_id").alias("head_id"), F.col("f.h").alias("head_h"), F.coalesce("prev", F.lit(last)).alias("send")
    )
    heads = bounded(materialize(heads, "heads"), 32)
    own = F.coalesce("doc_id", F.lit(-(1 << 63)))
    marked = rows.join(heads, (own == heads.head_id) & (rows.h == heads.head_h), "left")
    place = lambda b, real: F.struct(b.alias("bucket"), F.lit(real).alias("real"))
    places = F.when(F.col("send").isNotNull(), F.array(place(F.col("bucket"), True), place(F.col("send"), False))).otherwise(F.array(place(F.col("bucket"), True)))
    dealt = marked.select("doc_id", "text", "h", F.explode(places).alias("p")).select("doc_id", "text", "h", "p.bucket", "p.real")
    in_order = Window.partitionBy("bucket").orderBy(F.desc("real"), F.asc_nulls_first("doc_id"), "h")
    return dealt.withColumn("next_text", F.lead("text").over(in_order))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next text. Returns `doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, edited_lost, edited_gained`; the last two
    count the paragraphs that the edit took away and brought in. Null texts are empty; two
    texts without words are alike (1), such a text and another are not (0). Repeated rows
    follow each other. Other columns are not read.
    """
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(coalesce(next_text, ''), 1, int(floor(length(text) / 2)))"))
    rows = with_next_text(docs).withColumn("edited", edited).withColumn("a", digests(F.col("text"))).withColumn("e", digests(F.col("edited")))
    rows = rows.withColumn("sa", sketch(signed(F.col("a"), 1))).withColumn("se", sketch(signed(F.col("e"), 1))).select(
        "bucket", "real", "doc_id", "h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "e", "sa", "se"
    )
    in_order = Window.partitionBy("bucket").orderBy(F.desc("real"), F.asc_nulls_first("doc_id"), "h")
    rows = rows.withColumn("b", F.lead("a").over(in_order)).withColumn("sb", F.lead("sa").over(in_order)).where("real")
    pair = lambda x, sx: differences(F.col("a"), F.col(x), F.col("sa"), F.col(sx))
    rows = rows.withColumn("to_edited", pair("e", "se")).withColumn("to_next", pair("b", "sb"))
    only = lambda n: F.size(F.filter("to_edited", lambda v: v.n == n)).cast("long")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sa"), F.col("a")).alias("fingerprint"),
        as_text(F.col("se"), F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("a"), F.col("b"), F.col("to_next")).alias("near_next"),
        only(1).alias("edited_lost"), only(-1).alias("edited_gained"),
    )
