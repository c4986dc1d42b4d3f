"""Text column helpers: trimming, line handling, masking, keyword hits and number formats."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tillsight import fixed_values as fv

# Every Unicode whitespace character, separators \x1c-\x1f included, and the line breaks among them.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_LINE_BREAK = r"\R|[\x1c-\x1e]"


def strip(x: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.btrim(x, F.lit(WHITESPACE))


def is_blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def text_lines(x: Column) -> Column:
    """Stripped, non-blank lines of a text, in order."""
    stripped = F.transform(F.split(F.coalesce(x, F.lit("")), _LINE_BREAK), strip)
    return F.filter(stripped, lambda line: line != "")


def contains_any(x: Column, terms: Iterable[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | x.contains(term)
    return hit


def keyword_hits(x: Column, keywords: Iterable[str]) -> Column:
    """How many distinct keywords occur in the text as substrings."""
    hits = F.lit(0)
    for keyword in keywords:
        hits = hits + x.contains(keyword).cast("int")
    return hits


def mask_personal_data(x: Column, enabled: bool = True) -> Column:
    """Hide phone numbers, e-mail addresses and resident ids, in that order.

    Each pattern holds a fixed sign; texts without it skip the pattern. (?U) makes \\d and \\b
    Unicode aware.
    """
    if not enabled:
        return x
    masked = x
    for sign, pattern, mask in _MASKS:
        masked = F.when(x.contains(sign), F.regexp_replace(masked, "(?U)" + pattern, mask)).otherwise(masked)
    return masked


_MASKS = (
    ("-", fv.PHONE_PATTERN, fv.PHONE_MASK),
    ("@", fv.EMAIL_PATTERN, fv.EMAIL_MASK),
    ("-", fv.RESIDENT_PATTERN, fv.RESIDENT_MASK),
)


def violates_policy(x: Column, terms: Iterable[str] = fv.BLOCKED_TERMS) -> Column:
    return contains_any(F.lower(x), terms)


def with_safe_text(
    df: DataFrame, name: str, text: Column, masking: bool = True, terms: Iterable[str] = fv.BLOCKED_TERMS
) -> DataFrame:
    """Add the masked text as column `name`; a row whose text holds a blocked term fails the job.

    Each step is a column of its own: a step names its input several times, and nested into one expression the text
    would be written out again for each of them.
    """
    df = df.withColumn(name, text)
    for sign, pattern, mask in _MASKS if masking else ():
        replaced = F.regexp_replace(name, "(?U)" + pattern, mask)
        df = df.withColumn(name, F.when(F.col(name).contains(sign), replaced).otherwise(F.col(name)))
    df = df.withColumn("_lowered", F.lower(name))
    blocked = F.when(contains_any(F.col("_lowered"), terms), F.raise_error(F.lit(fv.POLICY_ERROR)))
    return df.withColumn(name, blocked.otherwise(F.col(name))).drop("_lowered")


_NUMBER_SPEC = re.compile(r"%([+,]?)\.(\d)f")
_ANY_SPEC = re.compile(r"%%|%[+,]?\.\df|%,?[ds]")


def fixed(x: Column, places: int, flag: str = "") -> Column:
    """A number with fixed decimals, rounded on its exact value; `flag` is "," (groups) or "+" (sign)."""
    text = F.format_number(x.cast("double"), places)
    if flag != ",":
        text = F.replace(text, F.lit(","), F.lit(""))
    if flag == "+":
        text = F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))
    return text


def fmt(pattern: str, *values: Column) -> Column:
    """printf-style text; numbers with decimals go through `fixed`. Takes %s, %d, %,d and %.Nf with + or ,."""
    specs = [spec for spec in _ANY_SPEC.findall(pattern) if spec != "%%"]
    if len(specs) != len(values):
        raise ValueError(f"{len(specs)} places for {len(values)} values: {pattern}")
    written = []
    for spec, value in zip(specs, values):
        number = _NUMBER_SPEC.fullmatch(spec)
        written.append(fixed(value, int(number[2]), number[1]) if number else value)
    return F.format_string(_NUMBER_SPEC.sub("%s", pattern), *written)


def percent(x: Column) -> Column:
    return fmt("%.1f%%", x * 100)


def signed_percent(x: Column) -> Column:
    return fmt("%+.1f%%", x)


def won(x: Column) -> Column:
    return fmt("%,.0f원", x)


def plain_number(x: Column) -> Column:
    """A number as a double written without exponent: 12345678.5, 10.0."""
    x = x.cast("double")
    wide = F.regexp_replace(x.cast("decimal(30,10)").cast("string"), r"0+$", "")
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), wide).otherwise(x.cast("string"))
