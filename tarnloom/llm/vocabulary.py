"""Mapping free-entered values to a canonical list. SQL only.

A value is brought to its bare words: width, look-alikes, accents, invisible
characters and bracketed remarks away, then everything but letters. Words in a
row, written together, are its pieces; the whole value is the longest one, and
once more with its first word put behind. A piece means the entry whose name or
abbreviation it is, or the closest entry within the slips of the pen that the
lengths of both allow: one for each three letters, two at most, where a slip is
one letter more, less, other or two neighbours swapped. A whole value that is a
beginning, of at least LEAST letters, of one entry only means that entry (a
cut-off name). The piece of most words, then of most letters, that means
something decides, so any words around an entry's name qualify it without naming
another. Abbreviations are codes, of which a slip makes another code, and count
only as they are.

Slips are found by a pigeonhole join: s slips are a Levenshtein distance of at
most 2 s, so of 2 s + 1 segments of a reference string one is in the piece
unchanged, moved by at most 2 s places. The join is an equality join on the
segment's letters over the distinct pieces, spread over tasks; candidates are
verified with the built-in levenshtein, and distances above s, which only swaps
allow, by the letters that differ and then by the swaps themselves. What nothing maps is reported through an
anti-join as entry 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.clean import ASCII, FULLWIDTH
from ..functions.spread import cut, small

LEAST = 4
# Letters that look like, or are, Latin letters with a mark, and the plain letters.
MARKED = "аеорсухіѕԁһԝԛјӏɡкмтвнοαεικνρτυ" + "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőřśšşţťùúûüūůűýÿźżž"
PLAIN = "aeopcyxisdhwqjlgkmtbhoaeiknptu" + "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorsssttuuuuuuuyyzzz"


def _sql(text: str) -> str:
    """A string literal for ``spark.sql`` with named frames, in which braces are doubled."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


def letters_sql(value: str) -> str:
    """The SQL array of a value's bare words."""
    x = f"lower(translate({value}, {_sql(FULLWIDTH)}, {_sql(ASCII)}))"
    x = f"translate(regexp_replace({x}, {_sql(r'[\p{M}\p{Cf}]+')}, ''), {_sql(MARKED)}, {_sql(PLAIN)})"
    x = f"regexp_replace({x}, {_sql(r'^\s*\(([^()]*)\)\s*$')}, '$1')"
    x = f"regexp_replace({x}, {_sql(r'\([^()]*\)|\[[^\[\]]*\]')}, ' ')"
    return f"regexp_extract_all({x}, '[a-z]+', 0)"


WORDS = f"""
SELECT name, w FROM (SELECT name, {letters_sql("name")} AS w FROM (SELECT DISTINCT name FROM {{categories}} WHERE name IS NOT NULL)) WHERE size(w) > 0"""

WHOLE = """
SELECT name, array_join(w, '') AS form, size(w) AS n, 0 AS turned FROM {words}
UNION ALL SELECT name, array_join(slice(w, 2, size(w)), '') || w[0], size(w), 1 FROM {words} WHERE size(w) > 1"""

ENTRIES = f"""
SELECT DISTINCT finding_id, array_join(w, '') AS form, array_join({letters_sql("abbrev")}, '') AS short, size(w) AS n
FROM (SELECT finding_id, abbrev, {letters_sql("name")} AS w FROM {{reference}} WHERE finding_id IS NOT NULL)"""



def swaps_sql(value: str) -> str:
    """The SQL array of a word's forms with two neighbouring letters swapped."""
    part = f"concat(substring({value}, 1, i - 1), substring({value}, i + 1, 1), substring({value}, i, 1), substring({value}, i + 2))"
    return f"transform(sequence(1, greatest(1, length({value}) - 1)), i -> {part})"


# Names and abbreviations as they are; of several entries the smallest id.
EQUAL = """
SELECT f.name, f.n, f.turned AS rank, length(f.form) AS letters, 0 AS slips, 0 AS d, f.turned, e.finding_id FROM {forms} f JOIN {entries} e ON f.form = e.form
UNION ALL SELECT f.name, f.n, 2, length(f.form), 0, 0, 0, e.finding_id FROM {forms} f JOIN {entries} e ON f.form = e.short WHERE f.turned = 0 AND e.short <> ''"""

# Beginnings that are those of one entry only.
BEGUN = """
WITH beginnings AS (
  SELECT form, min(finding_id) AS finding_id FROM (
    SELECT finding_id, explode(transform(sequence({least}, greatest({least}, length(form) - 1)), n -> substring(form, 1, n))) AS form FROM {entries} WHERE length(form) > {least})
  GROUP BY form HAVING count(DISTINCT finding_id) = 1)
SELECT f.name, f.n, 3 AS rank, length(f.form) AS letters, 0 AS slips, 0 AS d, 0 AS turned, b.finding_id FROM {forms} f JOIN beginnings b ON f.form = b.form WHERE f.turned = 0"""

# What nothing settles as a whole, with its pieces: up to one word more than the longest entry has.
PIECES = """
WITH open AS (SELECT w.* FROM {words} w LEFT ANTI JOIN {settled} s ON w.name = s.name),
most AS (SELECT coalesce(max(n), 0) + 1 AS k FROM {entries}),
starts AS (SELECT name, w, posexplode(w) AS (at, first) FROM open),
parts AS (SELECT name, w, at, explode(sequence(1, least((SELECT k FROM most), size(w) - at))) AS n FROM starts)
SELECT DISTINCT name, array_join(slice(w, at + 1, n), '') AS form, n, 0 AS turned FROM parts
UNION ALL SELECT f.name, f.form, f.n, f.turned FROM {whole} f JOIN open o ON f.name = o.name WHERE f.turned = 1 OR f.n > (SELECT k FROM most)"""

# The segments of a reference string with their places, against the places of the distinct pieces, which
# are few bytes and much work: they and what they meet are spread over a fixed number of tasks.
CANDIDATES = """
WITH sized AS (SELECT finding_id, form, CAST(least(2, length(form) div 3) AS INT) AS s FROM {entries}),
cuts AS (
  SELECT finding_id, form, s, explode(transform(sequence(0, 2 * s), i -> struct(
    CAST(floor(length(form) * i / (2 * s + 1)) AS INT) + 1 AS place,
    substring(form, CAST(floor(length(form) * i / (2 * s + 1)) AS INT) + 1, CAST(floor(length(form) * (i + 1) / (2 * s + 1)) - floor(length(form) * i / (2 * s + 1)) AS INT)) AS segment))) AS c
  FROM sized WHERE s > 0),
shapes AS (SELECT coalesce(sort_array(collect_set(length(c.segment))), array()) AS ws FROM cuts),
distinct_ AS (SELECT DISTINCT form FROM {pieces}),
own AS (SELECT /*+ REPARTITION({parts}) */ form FROM distinct_),
parts AS (
  SELECT form, width, explode(sequence(1, length(form) - width + 1)) AS place
  FROM (SELECT form, explode((SELECT ws FROM shapes)) AS width FROM own) WHERE length(form) >= width),
met AS (
  SELECT DISTINCT p.form, c.finding_id, c.form AS entry, least(c.s, CAST(length(p.form) div 3 AS INT)) AS s
  FROM parts p JOIN cuts c ON substring(p.form, p.place, p.width) = c.c.segment AND p.width = length(c.c.segment)
  WHERE abs(p.place - c.c.place) <= 2 * c.s AND abs(length(p.form) - length(c.form)) <= least(c.s, length(p.form) div 3))
SELECT /*+ REPARTITION({parts}) */ * FROM met"""

# The number keeps the conditions above the distance: pushed below, they would repeat it at each mention.
SLIPPED = """
WITH measured AS (SELECT *, levenshtein(form, entry, 4) AS d, monotonically_increasing_id() AS at FROM {candidates}),
letters AS (
  SELECT *, CASE WHEN d > s THEN greatest(
      aggregate(transform(sequence(97, 122), a -> greatest(0, length(form) - length(replace(form, chr(a), '')) - length(entry) + length(replace(entry, chr(a), '')))), 0, (x, y) -> x + y),
      aggregate(transform(sequence(97, 122), a -> greatest(0, length(entry) - length(replace(entry, chr(a), '')) - length(form) + length(replace(form, chr(a), '')))), 0, (x, y) -> x + y)) ELSE 0 END AS other
  FROM measured WHERE at >= 0 AND d BETWEEN 0 AND 2 * s)
SELECT form, finding_id, CASE WHEN d = 2 AND array_contains({swaps_form}, entry) THEN 1 ELSE least(d, s) END AS slips, d FROM letters
WHERE at >= 0 AND (d <= s OR other <= 2 * s - d AND (array_contains({swaps_form}, entry) OR (s = 2 AND (arrays_overlap({swaps_form}, {swaps_entry})
  OR exists({swaps_form}, x -> levenshtein(x, entry, 1) >= 0) OR exists({swaps_entry}, x -> levenshtein(form, x, 1) >= 0)))))"""

CHOSEN = """
WITH every AS (
  SELECT * FROM {settled}
  UNION ALL SELECT * FROM {equal}
  UNION ALL SELECT p.name, p.n, 4, length(p.form), s.slips, s.d, p.turned, s.finding_id FROM {pieces} p JOIN {slipped} s ON p.form = s.form)
SELECT name, min(struct(-n, rank, -letters, slips, d, turned, finding_id)).finding_id AS finding_id FROM every GROUP BY name"""

RESULT = """
WITH matched AS (SELECT c.id AS category_id, min(m.finding_id) AS finding_id FROM {categories} c JOIN {chosen} m ON c.name = m.name WHERE c.id IS NOT NULL GROUP BY c.id)
SELECT * FROM matched
UNION ALL
SELECT DISTINCT c.id, CAST(0 AS BIGINT) FROM {categories} c LEFT ANTI JOIN matched m ON c.id = m.category_id WHERE c.id IS NOT NULL"""


def map_values(spark: SparkSession, categories: DataFrame, reference: DataFrame, least: int = LEAST) -> DataFrame:
    """(category_id, finding_id): every category with the entry its name means, 0 if none.

    Distinct names are mapped once. Null and empty names, and names without a
    Latin letter, map to 0; rows with a null id are left out; a repeated id with
    several names takes the smallest entry among them. An empty reference maps
    everything to 0.
    """
    words = cut(spark.sql(WORDS, categories=categories), "words")
    entries = small(cut(spark.sql(ENTRIES, reference=reference), "entries"))
    whole = spark.sql(WHOLE, words=words)
    settled = cut(spark.sql(EQUAL, forms=whole, entries=entries).union(spark.sql(BEGUN.replace("{least}", str(int(least))), forms=whole, entries=entries)), "settled")
    pieces = cut(spark.sql(PIECES, words=words, settled=settled, entries=entries, whole=whole), "pieces")
    equal = spark.sql(EQUAL, forms=pieces, entries=entries)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    candidates = cut(spark.sql(CANDIDATES.replace("{parts}", parts), pieces=pieces, entries=entries), "candidates")
    slipped = cut(spark.sql(SLIPPED.replace("{swaps_form}", swaps_sql("form")).replace("{swaps_entry}", swaps_sql("entry")), candidates=candidates), "slipped")
    chosen = cut(spark.sql(CHOSEN, settled=settled, equal=equal, pieces=pieces, slipped=small(slipped)), "chosen")
    return spark.sql(RESULT, categories=categories.select("id", "name"), chosen=small(chosen))
