"""Column expressions that bring identifiers written by hand to one form.

Everything here is a plain Column built from JVM functions, so it stays inside
whole-stage code generation and can be pushed next to a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Printable ASCII and its full-width twins, in code point order.
ASCII = "".join(map(chr, range(0x21, 0x7F)))
FULLWIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))

# Subject entries that name nobody, letters only, upper case.
NOBODY = ("ANON", "ANONYMOUS", "ANONYMIZED", "ANONYMISED", "UNKNOWN", "UNK", "NONE", "NULL", "NA", "NAN", "NIL", "MISSING", "TBD", "X", "XX", "XXX")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def narrow(value: Column | str) -> Column:
    """Full-width ASCII twins as ASCII; strings without any are not touched."""
    c = _column(value)
    return F.when(c.rlike("[\\uFF01-\\uFF5E]"), F.translate(c, FULLWIDTH, ASCII)).otherwise(c)


def with_hex(df: DataFrame, source: str, digits: int, name: str) -> DataFrame:
    """``df`` with ``name``, the ``digits`` lower-case hex digits of the hash in
    ``source`` however it is written.

    Prefixes (``0x``, ``blake3:``, ``blake3=``), separators, white space and
    case are dropped. Null, anything of another length or alphabet, and
    placeholders of one repeated digit give null. The steps are separate
    projections so that no step is evaluated twice, and a value already in form
    skips the replacements.
    """
    form = f"\\A[0-9a-f]{{{digits}}}\\z"  # not $, which also matches before a last line break
    c = F.col(source)
    x = F.regexp_replace(F.lower(narrow(c)), r"[\s\p{Z}\p{Cf}]+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^(?:blake3[:=]|0x)", ""), r"[:_.\-]+", "")
    staged = df.withColumn("_x", F.when(c.rlike(form), c).otherwise(x))
    x = F.col("_x")
    return staged.withColumn(name, F.when(x.rlike(form) & (x != F.repeat(F.substring(x, 1, 1), F.lit(digits))), x)).drop("_x")


def kept(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which none of the cleaned columns is null.

    The mark, which is not deterministic, keeps the condition above the cleaning:
    pushed down to the scan it would repeat the whole expression at each mention.
    """
    known = [F.col(n).isNotNull() for n in names]
    return df.withColumn("_here", F.monotonically_increasing_id()).where(reduce(lambda a, b: a & b, known, F.col("_here") >= 0)).drop("_here")


def hex_long(value: Column, start: int) -> Column:
    """Sixteen hex digits from ``start`` (1-based) as a signed 64-bit integer."""
    high = F.conv(F.substring(value, start, 8), 16, 10).cast("long")
    low = F.conv(F.substring(value, start + 8, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def with_subject(df: DataFrame, source: str, name: str) -> DataFrame:
    """``df`` with ``name``: a subject by its letters (case aside) and its number, as ``ALB|331``.

    Letters before and after the number both count, so ``IBX-71-II`` is not
    ``IBX-71``. Leading zeros and separators do not count. Entries that name
    nobody (placeholder words, or neither letters nor a number) and null give null.
    """
    x = F.col("_x")
    staged = df.withColumn("_x", F.upper(narrow(source)))
    staged = staged.withColumn("_letters", F.regexp_replace(x, r"[^\p{L}]+", "")).withColumn("_number", F.regexp_replace(F.regexp_replace(x, r"[^0-9]+", ""), r"^0+", ""))
    nobody = (F.col("_number") == "") & F.col("_letters").isin("", *NOBODY)
    return staged.withColumn(name, F.when(x.isNotNull() & ~nobody, F.concat_ws("|", "_letters", "_number"))).drop("_x", "_letters", "_number")


def person_key(value: Column | str) -> Column:
    """An annotator's name by its letters and digits, case, width, look-alikes and separators aside."""
    x = F.lower(narrow(value))
    x = F.translate(x, "аеорсухіѕԁһԝԛјӏɡкνο", "aeopcyxisdhwqjlgkvo")  # fixed values: look-alikes and their Latin letters
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def captured(value: Column | str) -> Column:
    """A capture date, or null where it is missing or one that no digital image can have."""
    c = _column(value)
    return F.when((c > F.lit("1970-01-01").cast("date")) & (c < F.lit("2100-01-01").cast("date")), c)
