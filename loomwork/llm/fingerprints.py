"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark expressions only.

A text's paragraphs are its lines; a line is cut at the first ``.``, ``!`` or ``?`` behind ``SHORT`` code points of a
piece, or at ``LONG``. They become a set of 61-bit digests whose low 16 bits check the rest. A sketch
has three tables of s cells (a power of two, the number of digests at least); a digest is added to one cell of
each. A cell has the count and the exclusive or of its digests, and only cells that hold some are
kept. Sketches of two versions subtract cell by cell; what they share cancels. Peeling takes cells that hold one
digest, by count, check and place, removes it from its other cells, and so recovers the digests that differ.

The fingerprint is the sketch as text, ``tables' size;digests;cell:count:digests,...`` in hexadecimal. It is a function
of the text alone: the sketch is peeled by itself, and while it gets stuck, made again twice as large.
``likeness`` is 1 - differing / (all digests of both), 1 for two empty sets, and comes from two sketches alone: they are
subtracted and peeled; of two sizes the smaller sketch is first brought to the larger size, from the digests that it was
peeled into. Where peeling the difference gets stuck, sketches of these digests with other hashes are made, each twice as large
as the one before, up to 2**28 cells. Digests that shared their cells in all of these sizes would at last be compared as they are,
so a likeness is always the true one.

The next document is that of the next smaller id, nulls last, ties by a hash of the text; after the last comes
the first. Rows that repeat id and text are one document here, each with the same next one. The order is made
of narrow rows; a text is shuffled once, and the beginning that its neighbour takes once more.

Defined results: null texts are empty, an empty text has the empty sketch; equal texts have equal fingerprints; very long
texts have larger sketches; a single document is its own next one; other columns of any name are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.storage import with_rank

SHORT, LONG = 96, 256
LEAST = 16
#: Passes of one peeling; one that needs more counts as stuck, and is made larger.
ROUNDS = 64
LARGEST = 1 << 28
SALT = 7919


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once, as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """SQL: the set of paragraph digests of a text column."""
    pieces = f"regexp_extract_all({text}, '[^\\\\n]{{{SHORT}}}[^\\\\n.!?]{{0,{LONG - SHORT}}}+[.!?]*+|[^\\\\n]{{1,{SHORT}}}', 0)"
    top = "shiftrightunsigned(xxhash64(p), 19)"
    return f"array_distinct(transform({pieces}, p -> {let('h', top, 'shiftleft(h, 16) | cast(hash(h) & 65535 as bigint)')}))"


def cell(x: str, table: str, s: str, salt: int | str) -> str:
    """SQL: the cell of digest ``x`` in a table."""
    return f"cast(3 * (xxhash64({x}, cast({salt} as bigint) + {table}) & ({s} - 1)) + {table} as int)"


def entries(xs: str, n: int, s: str, salt: int | str = 0) -> str:
    """SQL: what digests add to cells, each ``n`` times."""
    one = ", ".join(f"named_struct('c', {cell('x', str(t), s, salt)}, 'n', {n}, 'x', x)" for t in range(3))
    return f"flatten(transform({xs}, x -> array({one})))"


def combined(entries_: str) -> str:
    """SQL: entries added up by cell, without empty cells."""
    starts = "filter(sequence(1, size(es)), i -> i = 1 or es[i - 1].c != es[greatest(i - 2, 0)].c)"
    run = "slice(es, st, m)"
    added = f"named_struct('c', es[st - 1].c, 'n', aggregate({run}, 0, (a, e) -> a + e.n), 'x', aggregate({run}, 0L, (a, e) -> a ^ e.x))"
    one = let("m", "coalesce(get(starts, k + 1), size(es) + 1) - st", f"if(m = 1, es[st - 1], {added})")
    cells = let("starts", starts, f"filter(transform(starts, (st, k) -> {one}), c -> c.n != 0 or c.x != 0L)")
    return let("es", f"sort_array({entries_})", f"if(size(es) = 0, es, {cells})")


def sketch(xs: str, s: str, salt: int | str = 0) -> str:
    """SQL: struct (s, n, cells) of an array of distinct digests."""
    return f"named_struct('s', {s}, 'n', size({xs}), 'cells', {combined(entries(xs, 1, s, salt))})"


def negated(cells: str) -> str:
    return f"transform({cells}, e -> named_struct('c', e.c, 'n', -e.n, 'x', e.x))"


def peel(cells: str, s: str, salt: int | str = 0) -> str:
    """SQL: struct (cells, plus, minus): the cells left after peeling, and the digests recovered by sign.

    A digest and a table are one number, 4 * digest + table. Cells that hold one digest go as they are, and only
    those that the digest has beside them are settled by sorting."""
    place = cell("c.x", "c.c % 3", s, salt)
    single = f"abs(c.n) = 1 and (c.x & 65535) = (hash(shiftright(c.x, 16)) & 65535) and c.c = {place}"
    split = f"transform(s_.cells, c -> named_struct('pure', {single}, 'c', c))"
    at = lambda n: f"transform(filter(split, e -> e.pure and e.c.n = {n}), e -> 4 * e.c.x + e.c.c % 3)"
    of = lambda keys: f"array_distinct(transform({keys}, k -> shiftright(k, 2)))"
    beside = lambda xs, keys, n: f"transform(array_except(flatten(transform({xs}, x -> array(4 * x, 4 * x + 1, 4 * x + 2))), {keys}), k -> named_struct('c', {cell('shiftright(k, 2)', 'k % 4', s, salt)}, 'n', {n}, 'x', shiftright(k, 2)))"
    state = "named_struct('cells', {}, 'plus', {}, 'minus', {}, 'stop', {})".format
    rest = combined(f"concat(transform(filter(split, e -> not e.pure), e -> e.c), {beside('plus', 'ups', -1)}, {beside('minus', 'downs', 1)})")
    taken = let("plus", of("ups"), let("minus", of("downs"), state(rest, "concat(s_.plus, plus)", "concat(s_.minus, minus)", "size(plus) + size(minus) = 0")))
    step = let("split", split, let("ups", at(1), let("downs", at(-1), taken)))
    none = "cast(array() as array<bigint>)"
    return f"aggregate(sequence(1, {ROUNDS}), {state(cells, none, none, 'false')}, (s_, r_) -> if(s_.stop or size(s_.cells) = 0, s_, {step}))"


def outcome(peeled: str) -> str:
    """SQL: how many digests were recovered; null if peeling got stuck."""
    return let("r", peeled, "if(size(r.cells) = 0, size(r.plus) + size(r.minus), cast(null as int))")


def recovered(of: str) -> str:
    """SQL: the digests of a sketch by itself; null if peeling gets stuck."""
    return let("r", peel(f"{of}.cells", f"{of}.s"), "if(size(r.cells) = 0, r.plus, cast(null as array<bigint>))")


CELLS = "array<struct<c: int, n: int, x: bigint>>"


def first_of(s: str, body: str, kind: str) -> str:
    """SQL: ``body``, an expression of a size ``s_of``, at ``s``, 2 * ``s`` and so on up to LARGEST, of the first for which it isn't null."""
    sizes = f"transform(sequence(0, greatest(0, {LARGEST.bit_length() - 1} - length(bin({s})) + 1)), d_ -> shiftleft({s}, d_))"
    return f"aggregate({sizes}, cast(null as {kind}), (f_, s_of) -> if(f_ is not null, f_, {body}))"


def with_sketch(rows: DataFrame, xs: str, into: str) -> DataFrame:
    """Add the sketch of the digests ``xs``, of the first size at which it can be peeled, and as ``into``_xs what it is peeled into."""
    least = f"shiftleft(1, length(bin(greatest(size({xs}), {LEAST}) - 1)))"
    peeled = let("xs_", recovered("sk_"), "if(xs_ is null, null, named_struct('sk', sk_, 'xs', xs_))")
    made = first_of(least, let("sk_", sketch(xs, "s_of"), peeled), f"struct<sk: struct<s: int, n: int, cells: {CELLS}>, xs: array<bigint>>")
    rows = rows.withColumn("__made", F.expr(f"coalesce({made}, named_struct('sk', {sketch(xs, least)}, 'xs', {xs}))"))
    return rows.withColumns({into: F.col("__made.sk"), f"{into}_xs": F.col("__made.xs")}).drop("__made")


def with_likeness(rows: DataFrame, name: str, a: str, b: str, b_cells: bool = True) -> DataFrame:
    """Add the likeness of two versions, from their sketches ``a`` and ``b`` and what these are peeled into.

    Without ``b_cells`` the cells of ``b`` are made again from its digests."""
    diff, xs, ys = f"__{name}_diff", f"{a}_xs", f"{b}_xs"
    s = f"greatest({a}.s, {b}.s)"
    one = f"if({a}.s = {s}, {a}.cells, {entries(xs, 1, s)})"
    two = entries(ys, -1, s)
    if b_cells:
        two = f"if({b}.s = {s}, {negated(f'{b}.cells')}, {two})"
    rows = rows.withColumn(diff, F.expr(outcome(peel(combined(f"concat({one}, {two})"), s))))
    salt = f"{SALT} * (length(bin(s_of)) - length(bin({s})))"  # by how often it was doubled
    again = outcome(peel(combined(f"concat({entries(xs, 1, 's_of', salt)}, {entries(ys, -1, 's_of', salt)})"), "s_of", salt))
    larger = first_of(f"least(2 * {s}, {LARGEST})", again, "int")
    compared = f"size(array_except({xs}, {ys})) + size(array_except({ys}, {xs}))"
    rows = rows.withColumn(diff, F.expr(f"coalesce({diff}, {larger}, {compared})"))
    share = f"try_divide(cast({diff} as double), {a}.n + {b}.n)"
    return rows.withColumn(name, F.expr(f"coalesce(1 - {share}, 1D)")).drop(diff)


def as_text(of: str) -> str:
    """SQL: a sketch as a string."""
    return f"concat(hex({of}.s), ';', hex({of}.n), ';', array_join(transform({of}.cells, c -> concat(hex(c.c), ':', hex(c.n), ':', hex(c.x))), ','))"


def neighbours(keyed: DataFrame) -> DataFrame:
    """(__of_id, __of_h): each document, and (__to_id, __to_h, __take) the one before it with the number of code points that it takes."""
    ranked = with_rank(keyed.select("__id", "__h", F.length("__text").alias("__chars")).distinct(), F.col("__id").desc_nulls_last(), F.col("__h"))
    n = max(1, ranked.count())
    before = ranked.select((F.col("rank") % n + 1).alias("rank"), F.col("__id").alias("__to_id"), F.col("__h").alias("__to_h"), F.expr("__chars div 3").cast("int").alias("__take"))
    return ranked.join(before, "rank").select(F.col("__id").alias("__of_id"), F.col("__h").alias("__of_h"), "__to_id", "__to_h", "__take")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __text, __sketch and __sketch_xs of every row, and of the next document the beginning that this one takes (__begin),
    its sketch's sizes (__next) and what that is peeled into (__next_xs)."""
    keyed = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__h", F.xxhash64("__text"))
    given = keyed.join(neighbours(keyed), F.col("__id").eqNullSafe(F.col("__of_id")) & (F.col("__h") == F.col("__of_h")))
    given = given.select("__to_id", "__to_h", F.expr("substring(__text, 1, __take)").alias("__begin"), F.expr(digests("__text")).alias("__xs"))
    given = with_sketch(given, "__xs", "__next").withColumn("__next", F.struct("__next.s", "__next.n")).drop("__xs")
    given = given.dropDuplicates(["__to_id", "__to_h"])
    rows = keyed.join(given, F.col("__id").eqNullSafe(F.col("__to_id")) & (F.col("__h") == F.col("__to_h"))).drop("__to_id", "__to_h", "__h")
    return with_sketch(rows.withColumn("__xs", F.expr(digests("__text"))), "__xs", "__sketch").drop("__xs")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last third is replaced by as much of the next one's beginning."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("__text").cast("long"))
    rows = rows.withColumn("__edited", F.expr("concat(substring(__text, 1, cast(n_chars - n_chars div 3 as int)), __begin)")).drop("__text", "__begin")
    rows = rows.withColumn("edited_sha256", F.sha2("__edited", 256)).withColumn("__xs", F.expr(digests("__edited"))).drop("__edited")
    rows = with_sketch(rows, "__xs", "__changed").drop("__xs")
    rows = with_likeness(rows, "near_edited", "__sketch", "__changed")
    rows = with_likeness(rows, "near_next", "__sketch", "__next", b_cells=False)
    return rows.select(
        F.col("__id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.expr(as_text("__sketch")).alias("fingerprint"),
        F.expr(as_text("__changed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
