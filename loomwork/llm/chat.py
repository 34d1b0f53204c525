"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become a block by array functions; blocks are concatenated:

    <|im_start|>ROLE \\n TEXT [<|im_sep|> TEXT ...] <|im_end|> \\n

The separator keeps the turns of a merged block apart, so reading back restores every turn. In a
text each ``<``, backslashes, ``|`` gets one backslash more, so no control string can occur inside a
text and the change is reversed exactly. A role is URL-encoded. ``loss_mask`` is run-length coded:
lengths of alternating runs, the first one without loss; runs of texts that carry loss are marked
by ``loss`` = true.

Reading cuts the output at the mask's runs. ``loss_text`` is what the runs with loss cut out, and ``mask_ok`` tells whether
all text runs cut out just the texts that the template's control strings bound, and the runs add up to the whole.

Defined results: a null text is empty; a null role is the empty role; turns are ordered by turn,
nulls first, ties by role and then text, so repeated rows stay as repeated turns; a null
conversation id is a conversation of its own; very long texts are formatted whole; other columns of any name are
left out; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
#: Runs are added up in stretches of this many, so that the place of a run takes few steps.
STRETCH = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, loss_mask (array of runs), n_blocks for each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # indices at which the role changes: each begins a block
    chats = chats.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role != turns[greatest(i - 1, 0)].role)"))
    chats = chats.withColumn("blocks", F.expr("transform(starts, (s, k) -> named_struct('role', turns[s].role, 'texts', transform(slice(turns, s + 1, coalesce(try_element_at(starts, k + 2), size(turns)) - s), t -> t.text)))"))
    escaped = chats.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), F.transform(b["texts"], escape).alias("texts"))))
    head = lambda b: F.concat(F.lit(START), F.url_encode(b["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(STOP))), "")
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    # a control run before each text: the block's head (and the stop before it) or a separator; one at the end
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.flatten(
                F.transform(
                    b["texts"],
                    lambda t, i: F.array(
                        run(F.when(i > 0, F.lit(len(SEP))).otherwise(F.length(head(b)) + F.when(k > 0, F.lit(len(STOP))).otherwise(0)), F.lit(False)),
                        run(F.length(t), b["role"].isin(*loss_roles)),
                    ),
                )
            ),
        )
    )
    return escaped.select("conv_id", formatted.alias("formatted"), F.concat(mask, F.array(run(F.lit(len(STOP)), F.lit(False)))).alias("loss_mask"), F.size("blocks").cast("long").alias("n_blocks"))


def runs_cut(formatted: str, mask: str) -> str:
    """SQL: the text runs of a mask (every other one, from the second) cut out of ``formatted``, as structs (raw, loss).

    Four bytes a code point make every cut take time by its own length; a leading character keeps the decoder from taking a first U+FEFF for a mark."""
    total = lambda of, at, n: f"aggregate(slice({of}, {at}, {n}), 0L, (t, r) -> t + r)"
    lengths = f"transform({mask}, r -> r.chars)"
    sums = f"transform(sequence(0, size(ls) div {STRETCH}), q -> {total('ls', f'q * {STRETCH} + 1', STRETCH)})"
    before = f"transform(sequence(0, size(ls) div {STRETCH}), q -> {total('sums', 1, 'q')})"
    at = f"before[i div {STRETCH}] + {total('ls', f'(i div {STRETCH}) * {STRETCH} + 1', f'i % {STRETCH}')}"
    cut = f"substring(decode(concat(encode('A', 'UTF-32'), substring(wide, cast(4 * ({at}) + 1 as int), cast(4 * ls[i] as int))), 'UTF-32'), 2)"
    each = f"transform(filter(sequence(0, size(ls) - 1), i -> i % 2 = 1), i -> named_struct('raw', {cut}, 'loss', {mask}[i].loss))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return let("wide", f"encode({formatted}, 'UTF-32')", let("ls", lengths, let("sums", sums, let("before", before, each))))


def read_chats(formatted: DataFrame) -> DataFrame:
    """From conv_id, formatted, loss_mask: ``turns`` (role, text), ``loss_text``, and ``mask_ok``."""
    blocks = F.expr(rf"transform(slice(split(formatted, '<\\|im_start\\|>', -1), 2, greatest(size(split(formatted, '<\\|im_start\\|>', -1)) - 1, 0)), b -> named_struct('role', url_decode(substring_index(b, '\n', 1)), 'body', substring(b, instr(b, '\n') + 1, length(b) - instr(b, '\n') - {len(STOP)})))")
    got = formatted.withColumn("blocks", blocks)
    raw = F.flatten(F.transform("blocks", lambda b: F.transform(F.split(b["body"], r"<\|im_sep\|>", -1), lambda t: F.struct(b["role"].alias("role"), t.alias("raw")))))
    got = got.withColumn("raw", raw)
    turns = F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text")))
    got = got.withColumn("turns", turns)
    got = got.withColumn("cut", F.expr(runs_cut("formatted", "loss_mask")))
    loss = F.transform(F.filter("cut", lambda c: c["loss"]), lambda c: unescape(c["raw"]))
    ok = F.expr("transform(cut, c -> c.raw) = transform(raw, t -> t.raw) and aggregate(loss_mask, 0L, (t, r) -> t + r.chars) = length(formatted) and size(loss_mask) = 2 * size(raw) + 1")
    return got.select("conv_id", "formatted", "n_blocks", "turns", F.array_join(loss, "").alias("loss_text"), ok.alias("mask_ok"))
