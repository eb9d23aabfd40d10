"""Scalar expressions on tokens, codes, labels and patterns. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIALS = ("[PAD]", "[CLS]", "[VISIT]")
STEP, ITEM = " -> ", ", "


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_event(token: Column | str) -> Column:
    """Whether a token is clinical; null for null."""
    return _c(token).rlike("^[CPD]:")


def stream(token: Column | str) -> Column:
    """C, P or D by the token's prefix, `?` for anything else; null for null."""
    t = _c(token)
    return F.when(t.isNull(), None).when(is_event(t), F.left(t, F.lit(1))).otherwise("?")


def code_version(token: Column | str) -> Column:
    """9 or 10 if the token carries a code version, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(token), r"^[CP]:(9|10)_", 1), F.lit("")), F.lit("99")).cast("int")


def bare_code(token: Column | str) -> Column:
    """The token without its stream and version (or drug) prefix."""
    return F.regexp_replace(_c(token), r"^[CPD]:(?:(?:9|10|RX)_)?", "")


def token(stream_name: str, version: Column | None, code: Column) -> Column:
    """`C:10_I509`-like token; null if a part is null."""
    return F.concat(F.lit(f"{stream_name}:"), version.cast("string") if version is not None else F.lit("RX"), F.lit("_"), code)


def shortened(text: Column | str, n: int, mark: str = "…") -> Column:
    """At most n characters, the last of them the mark if something was cut."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - len(mark))), F.lit(mark))).otherwise(t)


def readable(token_col: Column | str, title: Column | str) -> Column:
    """`title (code)`, or the bare token without a title."""
    t, name = _c(token_col), _c(title)
    return F.when(F.length(F.trim(name)) > 0, F.concat(F.trim(name), F.lit(" ("), bare_code(t), F.lit(")"))).otherwise(t)


def first_word(text: Column | str) -> Column:
    """What stands before the first blank."""
    return F.split_part(_c(text), F.lit(" "), F.lit(1))


def abbreviated(title: Column | str, exact: dict[str, str], phrases: list[tuple[str, str]], shortenings: list[tuple[str, str]]) -> Column:
    """A shorter title: an exact entry wins; else the first phrase found is replaced; then all shortenings; then blanks collapse."""
    t = _c(title)
    out = reduce(lambda acc, kv: acc.when(F.contains(t, F.lit(kv[0])), F.replace(t, F.lit(kv[0]), F.lit(kv[1]))), phrases, F.when(F.lit(False), t)).otherwise(t) if phrases else t
    for old, new in shortenings:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for old, new in exact.items():
        out = F.when(t == old, F.lit(new)).otherwise(out)
    return out


def canonical_label(text: Column | str) -> Column:
    """Lower case, other characters than letters and digits as single blanks, for loose comparison."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def rendered(pattern: Column | str) -> Column:
    """`{A, B} -> C` of an array of item sets; braces for sets of several items."""
    one = lambda s: F.when(F.size(s) > 1, F.concat(F.lit("{"), F.array_join(s, ITEM), F.lit("}"))).otherwise(F.array_join(s, ITEM))
    return F.array_join(F.transform(_c(pattern), one), STEP)


def parsed(text: Column | str) -> Column:
    """The array of item sets of a rendered pattern. Tokens holding `, ` or ` -> ` cannot come back; keep the arrays where that may be."""
    return F.transform(F.split(_c(text), STEP), lambda s: F.split(F.regexp_replace(s, r"^\{|\}$", ""), ITEM))


def canonical(pattern: Column | str) -> Column:
    """Item sets with sorted items."""
    return F.transform(_c(pattern), lambda s: F.array_sort(s))


def ndc11(raw: Column | str) -> Column:
    """An 11-digit drug code: 4-4-2, 5-3-2, 5-4-1 and 5-4-2 forms padded by part, bare digits padded left and cut; null without digits."""
    t = F.trim(_c(raw).cast("string"))
    part = lambda i, n: F.lpad(F.regexp_replace(F.split_part(t, F.lit("-"), F.lit(i)), r"\D", ""), n, "0")
    hyphened = F.concat(part(1, 5), part(2, 4), part(3, 2))
    digits = F.regexp_replace(F.regexp_replace(t, r"\.0$", ""), r"\D", "")
    plain = F.lpad(F.left(digits, F.lit(11)), 11, "0")
    return F.when(digits == "", None).when(F.size(F.split(t, "-")) == 3, hyphened).otherwise(plain)
