"""Text, money, year and extraction expressions: Column -> Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_join(cols: list[Column], sep: str) -> Column:
    """f06: joins what isn't blank."""
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (F.trim(x) != "")), sep)


def preview(col: Column, n: int) -> Column:
    """f07."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


#: Fixed values.
PLACEHOLDERS = ["Unavailable", "Not found in document", "Not found", "Not disclosed", "Not specified", "Unknown", "N/A", "None", ""]


def clean_placeholder(col: Column, default: str | None = None) -> Column:
    """f08."""
    return F.when(col.isNull() | F.trim(col).isin(PLACEHOLDERS), F.lit(default)).otherwise(col)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def present(text: Column, terms: list[str]) -> Column:
    """Those of the terms that occur in a text, in their order; none for null. One expression, however many terms."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms])


#: Fixed values.
DECK_KEYWORDS = ["revenue", "market", "funding", "investment", "startup", "business", "product", "team", "financial", "growth", "traction", "customers", "users", "sales", "opportunity"]


def is_valid_document(text: Column, min_chars: int = 200, terms: list[str] | None = None, min_hits: int = 2) -> Column:
    """f09."""
    return F.coalesce((F.length(F.trim(text)) >= min_chars) & (hits(text, terms or DECK_KEYWORDS) >= min_hits), F.lit(False))


def html_to_text(col: Column) -> Column:
    """s06: scripts and styles go with their content, other tags become a space."""
    bare = F.regexp_replace(F.regexp_replace(col, "(?is)<script[^>]*>.*?</script>", " "), "(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))


def clean_text(col: Column, collapse: bool = True, ascii_only: bool = True) -> Column:
    """x01."""
    out = F.regexp_replace(col, "[^\\x20-\\x7E\\n\\t]" if ascii_only else "[\\x00-\\x08\\x0B-\\x1F]", " ")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f]+", " ") if collapse else F.regexp_replace(out, "[ \\t]+", " "))


def search_form(col: Column) -> Column:
    """x02: lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), "[^\\p{L}\\p{N}_ \\t\\n\\r]", " "), "[ \\t\\n\\r]+", " "))


def words_and_money(col: Column) -> Column:
    """x03: letters, digits, _, $ and %; tokens of two characters and more."""
    return F.filter(F.split(F.regexp_replace(F.lower(col), "[^\\p{L}\\p{N}_$% \\t\\n\\r]", " "), "[ \\t\\n\\r]+"), lambda x: F.length(x) > 1)


def letter_runs(col: Column) -> Column:
    """x04."""
    return F.array_remove(F.split(F.lower(col), "[^\\p{L}]+"), "")


def blank_split(col: Column) -> Column:
    """x05."""
    return F.filter(F.split(col, "[ \\t\\n\\r\\f]+"), lambda x: x != "")


def scale_of(suffix: Column) -> Column:
    s = F.lower(F.trim(suffix))
    return F.when(s.isin("k", "thousand"), 1e3).when(s.isin("m", "million"), 1e6).when(s.isin("b", "bn", "billion"), 1e9).when(s == "crore", 1e7).when(s == "lakh", 1e5).otherwise(1.0)


_AMOUNT = "([$₹]?)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(K|M|B|thousand|million|billion|crore|lakh)\\b"


def normalise_numbers(col: Column) -> Column:
    """x06: every amount with a unit is written out with thousands separators; crore and lakh get the rupee sign."""
    found = F.regexp_extract_all(col, F.lit(f"(?i)({_AMOUNT})"), 1)

    def spelled(m: Column) -> Column:
        unit = F.regexp_extract(m, f"(?i){_AMOUNT}", 3)
        number = F.regexp_replace(F.regexp_extract(m, f"(?i){_AMOUNT}", 2), ",", "").try_cast("decimal(20,4)")
        value = number * scale_of(unit).cast("decimal(12,0)")
        sign = F.when(F.lower(unit).isin("crore", "lakh"), F.lit("₹")).otherwise(F.regexp_extract(m, f"(?i){_AMOUNT}", 1))
        return F.concat(sign, F.format_number(value, 0))

    # a match is replaced by its own first remaining occurrence, longest first, so that 5M doesn't touch 25M
    ordered = F.array_sort(F.array_distinct(found), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(found) == 0, col).otherwise(F.aggregate(ordered, col, lambda acc, m: F.replace(acc, m, spelled(m))))


def drop_chart_noise(col: Column) -> Column:
    """x07: runs of three and more short numbers, then lone ones between blanks, go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "(?:\\b[0-9]{1,3}\\b[ \\t]+){2,}[0-9]{1,3}\\b", " "), "(^|[ \\t\\n])[0-9]{1,3}($|[ \\t\\n])", " "), "[ \\t]+", " "))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that matches, trimmed; null if none does."""
    return F.coalesce(*[let(F.regexp_extract(text, p, group), lambda found: F.when(found != "", F.trim(found))) for p in patterns])


def money_value(col: Column) -> Column:
    """x20: display money to a number; null on failure."""
    bare = F.lower(F.regexp_replace(col, "[$₹, ]", ""))
    number = F.regexp_extract(bare, "^([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return number * scale_of(F.regexp_extract(bare, "^[0-9.]+([a-z]*)$", 1))


def percent_value(col: Column) -> Column:
    return F.regexp_extract(col, "([0-9]+(?:\\.[0-9]+)?)\\s*%", 1).try_cast("double")


def fixed(v: Column, digits: int) -> Column:
    """v with 0 or 1 decimals, rounded as C's printf does: by the exact value of the double, ties to even (Java's formatter rounds the
    shortest decimal form up). From 2^53 on a double is whole and Java's form is taken."""
    if digits not in (0, 1):
        raise ValueError("digits is 0 or 1")

    def tenths(x: Column) -> Column:
        # the fraction in units of 2^-58, exact wherever it can reach the next tenth
        t = ((x - F.floor(x)) * 2.0**58).cast("long") * 10
        q, r = F.shiftright(t, 58), t.bitwiseAND((1 << 58) - 1)
        up = (r > 1 << 57) | ((r == 1 << 57) & (q % 2 == 1))
        return F.floor(x) * 10 + q + up.cast("long")

    def spelled(x: Column) -> Column:
        if digits == 0:
            return F.rint(x).cast("long").cast("string")
        return let(tenths(x), lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string")))

    return F.when(F.abs(v) < 2.0**53, F.concat(F.when(v < 0, "-").otherwise(""), spelled(F.abs(v)))).otherwise(F.format_string(f"%.{digits}f", v))


def money_display(v: Column) -> Column:
    """x21."""
    shown = lambda sign, by, digits: F.concat(F.lit("$"), fixed(v / by, digits), F.lit(sign))
    return F.when(v >= 1e9, shown("B", 1e9, 1)).when(v >= 1e6, shown("M", 1e6, 1)).when(v >= 1e3, shown("K", 1e3, 0)).when(v.isNotNull(), F.concat(F.lit("$"), F.floor(v + 0.5).cast("long").cast("string")))


def normal_year(yr: Column, base: Column | int = 2024) -> Column:
    """x22: four digits stay; 'Year N' and 1-20 count from the base year."""
    base = F.lit(base) if isinstance(base, int) else base
    n = F.regexp_extract(yr, "^(?:Year )?([0-9]{1,2})$", 1).try_cast("int")
    return F.when(yr.rlike("^[0-9]{4}$"), yr.try_cast("int")).when(n.between(1, 20), base + n - 1)


def keep(items: list[tuple[Column, Column | str]]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in items]))


def first_class(text: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """The first class any of whose terms occurs."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, terms in reversed(classes):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(t) for t in terms]), name).otherwise(out)
    return out


def argmax_class(text: Column, classes: list[tuple[str, list[str]]], none: str) -> Column:
    """The class with the most terms present, the first of equals; `none` if there is no hit."""
    counts = [hits(text, terms) for _, terms in classes]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(none)
    for (name, _), n in reversed(list(zip(classes, counts, strict=True))):
        out = F.when((n == most) & (most > 0), name).otherwise(out)
    return out
