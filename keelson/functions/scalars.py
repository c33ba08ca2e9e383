"""Scalar functions as Column expressions: all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names with one meaning, and factors between units of one dimension.
UNIT_NAMES = {
    "percent": "%", "pct": "%", "milliseconds": "ms", "millisecond": "ms", "seconds": "s", "second": "s", "sec": "s",
    "minutes": "min", "minute": "min", "mins": "min", "hours": "h", "hour": "h", "hrs": "h", "hr": "h",
    "volts": "v", "volt": "v", "kilovolts": "kv", "kilovolt": "kv", "hertz": "hz",
}
UNIT_FACTORS = {
    ("ms", "s"): 0.001, ("s", "ms"): 1000.0, ("kva", "mva"): 0.001, ("mva", "kva"): 1000.0, ("kw", "mw"): 0.001, ("mw", "kw"): 1000.0,
    ("kvar", "mvar"): 0.001, ("mvar", "kvar"): 1000.0, ("min", "h"): 1 / 60, ("h", "min"): 60.0, ("s", "min"): 1 / 60, ("min", "s"): 60.0,
    ("kv", "v"): 1000.0, ("v", "kv"): 0.001,
}
# Patterns of ids in questions; those with (?i) match in any case.
ID_PATTERNS = {
    "rfi": r"(?i)\bRFI-\d{3,4}\b",
    "ncr": r"(?i)\bNCR-\d{1,4}\b",
    "activity": r"(?i)\bACT-\d{2,3}\b",
    "equipment": r"\b[A-Z]{2,4}-\d{2}[A-Z]\b|\b(?:UPS|GEN|SWG|ATS|CH|CRAH|PDU)-\d{2}[A-Z]?\b",
    "clause": r"\b[A-Z]{2,5}-\d+\.\d+(?:\.\d+)?\b",
    "itp": r"(?i)\bITP-[A-Z0-9]{6,}\b",
}
TAG_PATTERN = r"\b([A-Z]{2,4}-\d{2}[A-Z]?)\b"


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def leading_number(text: Column) -> Column:
    """The number that a text begins with; null without one."""
    return F.expr("try_cast(null as double)") if text is None else F.regexp_extract(text.cast("string"), r"^\s*(-?\d+(\.\d+)?)", 1).try_cast("double")


def unit_name(unit: Column) -> Column:
    """A unit trimmed, lower-cased and by its short name; '' for null."""
    short = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.coalesce(F.element_at(_map(UNIT_NAMES), short), short)


def unit_factor(source: Column, target: Column) -> Column:
    """What a value in ``source`` is multiplied by; null for units of different dimensions."""
    a, b = unit_name(source), unit_name(target)
    table = _map({f"{x}|{y}": factor for (x, y), factor in UNIT_FACTORS.items()})
    return F.when(a == b, F.lit(1.0)).otherwise(F.element_at(table, F.concat(a, F.lit("|"), b)))


def convert(value: Column, source: Column, target: Column) -> Column:
    return value * unit_factor(source, target)


def tolerance(text: Column) -> tuple[Column, Column]:
    """(amount, is relative) of a tolerance such as '±10%' or '±2'; nulls without one."""
    number = F.regexp_extract(text, r"±?\s*(\d+(?:\.\d+)?)\s*(%?)", 1).try_cast("double")
    relative = F.regexp_extract(text, r"±?\s*(\d+(?:\.\d+)?)\s*(%?)", 2) == "%"
    return F.when(relative, number / 100).otherwise(number), relative


def words(text: Column) -> Column:
    """The distinct runs of the letters a to z in a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1)))


def word_overlap(one: Column, other: Column) -> Column:
    return F.size(F.array_intersect(words(one), words(other)))


def plain_dashes(text: Column) -> Column:
    return F.translate(text, "—–", "--")


def ids_in(text: Column, kind: str) -> Column:
    """All ids of a kind in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ID_PATTERNS[kind]), F.lit(0))


def tags_in(text: Column, deny: tuple[str, ...] = ("ACT", "RFI", "TIA", "CX")) -> Column:
    """The distinct equipment tags in a text."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG_PATTERN), F.lit(1)))
    return F.filter(found, lambda t: ~F.split(t, "-")[0].isin(*deny))


def padded_id(text: Column, prefix: str = "NCR", width: int = 4) -> Column:
    """'NCR-1' and 'NCR-001' as 'NCR-0001'."""
    number = F.regexp_extract(text, r"-(\d+)", 1).try_cast("int").cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0")))


def next_id(last_number: Column, prefix: str, width: int = 4) -> Column:
    number = (F.coalesce(last_number, F.lit(0)) + 1).cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0")))


def content_id(content: Column) -> Column:
    """The first twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 12)


def is_content_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{12}$"), F.lit(False))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._ -]", "_")


def clean_cell(cell: Column) -> Column:
    """A register's cell trimmed; null for blank ones and formulas."""
    text = F.trim(cell.cast("string"))
    return F.when((text == "") | text.startswith("="), F.lit(None).cast("string")).otherwise(text)


def iso_date(text: Column) -> Column:
    """The date of an ISO text; null for anything else."""
    return F.expr("null") if text is None else F.substring(text.cast("string"), 1, 10).try_cast("date")


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON out of an answer: code fences are dropped, and what stands around the outermost braces or brackets."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*$", ""), r"(?s)^[^{\[]*", "")
    return F.from_json(F.regexp_replace(bare, r"(?s)[^}\]]*$", ""), schema)


def signed(number: Column) -> Column:
    return F.format_string("%+d", number.cast("long"))


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def _workday_number(day: Column) -> Column:
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return (F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))).cast("long")


def workdays_between(start: Column, end: Column) -> Column:
    """Mondays to Fridays from ``start`` on and before ``end``; negative if ``end`` is earlier."""
    return F.when(start <= end, _workday_number(end) - _workday_number(start)).otherwise(_workday_number(F.date_add(end, 1)) - _workday_number(F.date_add(start, 1)))


def workday_offset(start: Column, workdays: Column) -> Column:
    """The workday that lies ``workdays`` (cut to whole days) after ``start``, which rolls on from a weekend."""
    k = _workday_number(start) + workdays.cast("long")
    return F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(k / F.lit(5)) * 7 + F.pmod(k, F.lit(5))).cast("int"))


def half_even(number: Column, places: int) -> Column:
    """Rounded as IEEE arithmetic has it: ties, which are rare among binary values, go to the even digit.

    The product with the power of ten and its rounding error (found by splitting
    both factors) tell on which side of a tie the exact value lies.
    """
    scale = float(10**places)
    split = lambda x: (x * 134217729.0) - ((x * 134217729.0) - x)
    high, s_high = split(number), split(scale)
    low, s_low = number - high, scale - s_high
    product = number * scale
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low
    whole = F.floor(product).cast("double")
    beyond = product - whole - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    return F.when(F.abs(product) < 2.0**52, F.when(up, whole + 1).otherwise(whole) / scale).otherwise(number)
