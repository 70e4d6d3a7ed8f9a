"""Visually identical text with different characters.

DuckDB runs inside the Arrow partitions: one embedded SQL query brings a text to
its consistent form with ``nfc_normalize``, ``translate`` and regular
expressions. The form

* drops invisible characters (a joiner between two pictographs stays: it shapes
  them),
* writes every single space character as a space,
* writes full-width, half-width, styled and shaped forms, ligatures, Roman numeral
  signs and other compatibility signs as the letters they show,
* composes accents, and
* writes look-alike letters of other scripts as the Latin letter.

Case, accents, digits and words stay as they are, and so do signs whose
difference a reader sees: raised and lowered, circled and squared ones, fractions.
Texts are equal to a reader where their forms are equal. Each step is guarded by
the characters it is about, so plain texts pass through at the cost of a scan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spread import cut, lookup, salted_join

BLOCK = 50_000

# Letters of Cyrillic, Greek and others, and the Latin letters they look like.
LOOKALIKES = (
    ("аеорсухіјѕԁһԝԛӏѵɡοɑνϲϳ", "aeopcyxijsdhwqlvgoavcj"),
    ("АВЕЅІЈКМНОРСТУХҮԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABESIJKMHOPCTYXYQWABEZHIKMNOPTYXCJ"),
    ("ёїѐӓӧӱӯόὸ", "ëïèäöÿȳóò"),
    ("ЁЇЀӒӦΪΫΆΈΊΌΎЌ", "ËÏÈÄÖÏŸÁÉÍÓÝḰ"),
    ("ӐӑӖӗ", "ĂăĔĕ"),
    ("‐‑", "--"),
    ("օհսոցյ", "ohungj"),
    ("ᴄᴏꜱᴠᴡᴢ", "cosvwz"),
)
# Accented look-alikes that compose to two characters.
COMPOSED = {"ў": "y\u0306", "Ў": "Y\u0306", "Ή": "H\u0301"}
# Kinds of compatibility signs that look like the letters they stand for, and the
# ranges in which signs of the mixed kind do (ligatures, digraphs, Roman numerals, dots, radicals, jamo).
SHOWN = ("font", "noBreak", "wide", "narrow", "small", "initial", "medial", "final", "isolated")
MIXED = ((0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2033, 0x2034), (0x203C, 0x203C), (0x2047, 0x2049), (0x2160, 0x217F), (0x2488, 0x249B), (0x2E80, 0x2FD5), (0x3131, 0x318E), (0xFB00, 0xFB17))
# Characters without any mark, as a class of the expression language.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"
PICTOGRAPH = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?"
JOIN = "\uE0F5"  # a private character that stands for a joiner that is kept


@cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Signs and the character, or characters, they show, before composition."""
    one, several = {}, dict(COMPOSED)
    for c in range(0xA0, 0x20000):
        kind = unicodedata.decomposition(chr(c)).partition(">")[0].lstrip("<")
        if kind in SHOWN or (kind == "compat" and any(a <= c <= b for a, b in MIXED)):
            shown = unicodedata.normalize("NFKC", chr(c))
            if len(shown) == 1:
                one[chr(c)] = shown
            elif kind == "compat" or 0xFEF5 <= c <= 0xFEFC:  # and the ligatures of lam and alef
                several[chr(c)] = shown
    one |= {"\uff9e": "\u3099", "\uff9f": "\u309a"}  # voiced marks join the kana before them
    one |= {chr(c): " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}
    return one, several


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters) -> str:
    """A class of the expression language for characters, by ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in out) + "]"


def form_query(rows: str, text: str) -> str:
    """The SQL of ``rows`` (a table or subquery) with ``form``, the consistent form of the
    column ``text``; null for null."""
    one, several = tables()
    alike = tuple("".join(p) for p in zip(*LOOKALIKES))
    swap = lambda x, pair: f"translate({x}, {_quoted(pair[0])}, {_quoted(pair[1])})"
    where = lambda x, characters, then: f"CASE WHEN regexp_matches({x}, '{characters}') THEN {then} ELSE {x} END"
    joined = "_x"
    for _ in range(2):  # neighbouring joiners share a pictograph
        joined = f"regexp_replace({joined}, '({PICTOGRAPH})\\x{{200D}}({PICTOGRAPH})', '\\1{JOIN}\\2', 'g')"
    spelled = "_x"
    for sign, letters in several.items():
        spelled = f"replace({spelled}, {_quoted(sign)}, {_quoted(letters)})"
    steps = [
        where("_x", r"\x{200D}", joined),
        where("_x", INVISIBLE, f"regexp_replace(_x, '{INVISIBLE}+', '', 'g')"),
        where("_x", _class(one), swap("_x", ("".join(one), "".join(one.values())))),
        where("_x", _class(several), spelled),
        # once for letters with loose accents, once for those that composition makes
        where("_x", _class(alike[0]), swap("_x", alike)),
        "nfc_normalize(_x)",
        where("_x", _class(alike[0]), swap("_x", alike)),
        where("_x", _class(COMPOSED), spelled),
        f"replace(nfc_normalize(_x), '{JOIN}', '\u200D')",
    ]
    query = f"SELECT *, {text} AS _x FROM {rows}"
    for step in steps:
        query = f"SELECT * REPLACE (CASE WHEN regexp_full_match(_x, '[\\x00-\\x7F]*') THEN _x ELSE {step} END AS _x) FROM ({query})"
    return f"SELECT * RENAME (_x AS form) FROM ({query})"


def _run(query: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("part", pa.Table.from_batches([batch]))
            out = con.sql(query).to_arrow_table().select(names)
            con.unregister("part")
            yield from out.to_batches()
        con.close()

    return run


def forms(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, form): the consistent form of every text, '' for empty and null for null
    texts. One row for each row; other columns are not read."""
    kind = documents.schema[id_column].dataType.simpleString()
    query = f"SELECT _id AS {id_column}, form FROM ({form_query('part', '_text')})"
    own = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return own.mapInArrow(_run(query, [id_column, "form"]), f"{id_column} {kind}, form string")


def hashes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, form_hash, text_hash): SHA-256 of form and text of every row whose text shows
    at least one visible character; long texts leave the partition as 64 digits."""
    kind = documents.schema[id_column].dataType.simpleString()
    query = f"""SELECT _id AS {id_column}, sha256(form) AS form_hash, sha256(_text) AS text_hash
        FROM ({form_query('(SELECT * FROM part WHERE _text IS NOT NULL)', '_text')})
        WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]')"""
    own = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return own.mapInArrow(_run(query, [id_column, "form_hash", "text_hash"]), f"{id_column} {kind}, form_hash string, text_hash string")


def found(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of one form and different strings.

    Rows are compared by hash; forms written in one way only are dropped before
    any pairing, so many copies of one string cost nothing. Null, empty and
    invisible texts and null ids are in no pair.
    """
    own = hashes(documents).where("doc_id is not null").select("doc_id", F.unhex("form_hash").alias("form"), F.unhex("text_hash").alias("text"))
    own = cut(own, "forms")
    forms_ = own.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("_a"), F.max("text").alias("_b")).where("_a <> _b").select("form", "n")
    forms_ = cut(forms_, "several")
    rows = lookup(forms_.select("form"), own, ["form"], block).distinct()
    other = rows.select("form", F.col("doc_id").alias("doc_id_b"), F.col("text").alias("_text"))
    pairs = salted_join(rows.withColumnRenamed("doc_id", "doc_id_a"), other, ["form"], forms_.withColumn("m", F.col("n")), block)
    return pairs.where("doc_id_a < doc_id_b and text <> _text").select("doc_id_a", "doc_id_b").distinct()
