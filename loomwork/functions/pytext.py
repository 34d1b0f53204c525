"""Text rules on Spark columns as Python has them: white space, lines, numbers, rounding.

Java's ``\\s``, ``.`` and ``$`` differ from Python's, so patterns name white space and set (?d); ANSI mode
raises on bad casts, so every cast is a guarded try_cast. Trimming is by characters and not by pattern,
which looks at the ends of a text only.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters for which str.isspace() holds.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What float() accepts, but for underscores, which count as not numeric here.
FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)$"
#: Where splitlines() breaks a text.
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(s: Column) -> Column:
    """str.strip(), for all Unicode white space."""
    return F.btrim(s, F.lit(SPACE))


def collapse(s: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(s), f"[{SPACE}]+", " ")


def blank_to_null(s: Column) -> Column:
    """For chains of ``or``: an empty string counts as missing."""
    return F.nullif(s, F.lit(""))


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def to_float(s: Column) -> Column:
    """float(s) of a stripped text, or null where that raises."""
    return F.when(s.rlike(FLOAT), s.try_cast("double"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ten_decimals(x: Column) -> Column:
    """``'%.10f' % x`` of a double: its binary value, exactly, rounded half to even; ``inf``, ``-inf`` and ``nan`` as Python writes them.

    What is behind the point is a whole number of 2**-87, as far as it matters: less than 2**-35 rounds to nothing, and more has no
    smaller bits. Times 10**10 that fits a decimal of 38 digits. From 2**63 on all digits are those of a whole number."""
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = once(F.abs(x), lambda a: F.when(a < float(1 << 63), _fixed(a)).otherwise(F.concat(_whole_digits(a), F.lit("." + "0" * 10))))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def _fixed(a: Column) -> Column:
    dec = lambda c, digits: c.cast(f"decimal({digits},0)")
    fraction = a - F.floor(a).cast("double")
    high = F.floor(fraction * float(1 << 43))
    low = lambda h: F.floor((fraction * float(1 << 43) - h.cast("double")) * float(1 << 44))
    units = once(high, lambda h: dec(h, 13) * F.lit(1 << 44).cast("decimal(14,0)") + dec(low(h), 14))
    scaled = units * F.lit(5**10).cast("decimal(7,0)")  # 10**10 / 2**87 is 5**10 / 2**77
    one = F.lit(Decimal(1 << 77))
    parts = once(scaled, lambda p: F.struct(F.call_function("div", p, one).alias("q"), (p % one).alias("r")))

    def rounded(p: Column) -> Column:
        twice = p["r"] * F.lit(Decimal(2))
        return p["q"] + F.when((twice > one) | ((twice == one) & (p["q"] % 2 == 1)), 1).otherwise(0)

    digits = once(parts, rounded)
    return once(digits, lambda d: F.concat((F.floor(a) + F.when(d == 10**10, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((d % 10**10).cast("string"), 10, "0")))


def _whole_digits(a: Column) -> Column:
    """The digits of a double from 2**63 on, by limbs of nine digits: 54 bits, multiplied by what power of two is left."""
    limb, step = 10**9, 29

    def times(limbs: Column, factor: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry"))
        add = lambda acc, x: once(x * factor + acc["carry"], lambda v: F.struct(F.concat(acc["done"], F.array(v % limb)).alias("done"), F.call_function("div", v, F.lit(limb)).alias("carry")))
        return F.aggregate(limbs, start, add, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))

    def digits(k: Column) -> Column:
        m = F.floor(a * F.pow(F.lit(2.0), -k))
        limbs = F.array(m % limb, F.call_function("div", m, F.lit(limb)) % limb, F.call_function("div", m, F.lit(limb**2)))
        factors = F.concat(F.array_repeat(F.lit(1 << step).cast("bigint"), F.call_function("div", k, F.lit(step)).cast("int")), F.array(F.pow(F.lit(2.0), k % step).cast("bigint")))
        parts = F.aggregate(factors, limbs, times)
        return F.ltrim(F.array_join(F.transform(F.reverse(parts), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), F.lit("0"))

    return once(F.floor(F.log2(a)) - 53, digits)


def lines(s: Column) -> Column:
    """The non-blank lines of a text, stripped."""
    return F.filter(F.transform(F.split(s, LINE_BREAKS), strip), lambda x: x != "")


def word_count(s: Column) -> Column:
    """Runs of non-space characters; 0 for null. The spaces between them are counted, so that no array of words is made.

    The text is collapsed once, wherever the expression stands."""
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + (x != "").cast("int")
    return F.coalesce(once(collapse(s), count), F.lit(0)).cast("long")


def last(items: Column) -> Column:
    """The last element; null for an empty array."""
    return F.try_element_at(items, F.lit(-1))


def matches(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def shortened(s: Column, n: int) -> Column:
    """For display: n characters, then dots if there were more."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def rate(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded half to even; 0 for nothing."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def percent_label(part: Column, whole: Column) -> Column:
    """``part/whole  p%`` with the percentage cut off, not rounded."""
    share = F.coalesce(F.floor(F.try_divide(F.lit(100.0) * part, whole.cast("double"))), F.lit(0)).cast("int")
    return F.format_string("%d/%d  %d%%", part, whole, share)


def short_name(model: Column) -> Column:
    """The first part between hyphens that is neither empty nor a version number; else the first part."""
    parts = F.split(model, "-", -1)
    named = F.filter(parts, lambda p: (p != "") & ~F.replace(p, F.lit("."), F.lit("")).rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(parts, F.lit(1)))


def looked_up(key: Column, names: dict[str, str]) -> Column:
    """The name for a key; the key itself where there is none."""
    if not names:
        return key
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]), key), key)


def limit_from_json(key: Column, config: str, default: int) -> Column:
    """An integer per key from a JSON object; the default for other keys or unreadable JSON."""
    by_key = F.from_json(F.lit(config), "map<string, int>")
    return F.coalesce(F.try_element_at(by_key, key), F.lit(default)).cast("long")
