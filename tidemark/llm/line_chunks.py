"""Line dedup by content-defined chunks, in DataFrame and SQL functions only.

A text is split into lines, each line is hashed, and a rolling hash over the last two line hashes decides where a
chunk ends: whenever it is divisible by ``DIVISOR``. Boundaries depend on the lines around them alone, so the same
passage is cut alike wherever it stands and lines put in before it move nothing. A line of ``LONG_LINE`` words or more
is a chunk by itself. A chunk of two or more lines and ``MIN_WORDS`` words, or of one long line, that occurs more than
once in the whole corpus stays at its first place (least id, then hash of the text, then position) and goes
elsewhere. Occurrences are grouped by the bytes of the chunk, not only its hash; a hash that two different chunks
share removes nothing.

No key is split by hand: counts are aggregated per task before the shuffle, so a chunk in a third of all texts gives
one row per task, and the joins behind them have rows of a few bytes that adaptive execution can split.

Defined results: a null or empty text has no chunk that can go; rows that repeat both id and text are one
place and get equal results; a null id comes after all others; if all lines go the text is empty, and the row stays;
other columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shared import settle
from .tables import free_name

DIVISOR = 3
LONG_LINE = 50
MIN_WORDS = 8

#: The steps from a text to its chunks. Each is a generator of one row, so no step is computed again for every element.
_WORDS = "length({0}) - length(replace({0}, ' ', '')) + 1"
_STEPS = [
    "transform(split(t, '\\n', -1), l -> struct(l AS line, CAST(conv(left(md5(l), 13), 16, 10) AS BIGINT) AS h, " + _WORDS.format("l") + f" >= {LONG_LINE} AS long)) AS v",
    "filter(sequence(1, size(v)), i -> i = size(v) OR v[i - 1].long OR v[i].long OR (if(i > 1, v[i - 2].h, 0) * 31 + v[i - 1].h) % " + f"{DIVISOR} = 0) AS ends",
    "transform(ends, (e, j) -> struct(if(j = 0, 1, ends[j - 1] + 1) AS first, e AS last)) AS spans",
    "transform(spans, s -> array_join(transform(slice(v, s.first, s.last - s.first + 1), x -> x.line), '\\n')) AS texts",
]


def _steps(df: DataFrame, wanted: int) -> DataFrame:
    for step in _STEPS[:wanted]:
        name = step.rsplit(" AS ", 1)[1]
        df = df.select("*", F.inline(F.array(F.struct(F.expr(step).alias(name)))).alias(name))
    return df


def chunks(df: DataFrame) -> DataFrame:
    """id, h, idx, k1, k2, text of the chunks that may go; from id, h, t."""
    made = _steps(df.where("t IS NOT NULL"), 4).select("id", "h", F.posexplode(F.arrays_zip("spans", "texts")).alias("idx", "c"))
    lines, words = "(c.spans.last - c.spans.first + 1)", f"({_WORDS.format('c.texts')} + c.spans.last - c.spans.first)"
    fit = made.where(f"({lines} > 1 AND {words} >= {MIN_WORDS}) OR {words} >= {LONG_LINE}")
    return fit.selectExpr("id", "h", "idx", "xxhash64(c.texts) AS k1", "xxhash64('second', c.texts) AS k2", "c.texts AS text")


def repeated(found: DataFrame) -> DataFrame:
    """Stored: k1, k2 and least id of the chunks that occur more than once, compared by their bytes."""
    same = found.groupBy("k1", "k2", "text").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    alone = same.groupBy("k1", "k2").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return settle(alone.where("texts = 1 AND n > 1").select("k1", "k2", "first_id"))


def removals(found: DataFrame) -> DataFrame:
    """id, h and the indices of the chunks that go."""
    again = repeated(found)
    places = settle(found.select("id", "h", "idx", "k1", "k2").join(again, ["k1", "k2"]))
    first = places.where("id <=> first_id").groupBy("k1", "k2").agg(F.min(F.struct("h", "idx")).alias("place"))
    gone = places.join(first, ["k1", "k2"]).where("NOT (id <=> first_id AND h = place.h AND idx = place.idx)")
    return settle(gone.groupBy("id", "h").agg(F.collect_set("idx").alias("gone")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines_col: str | None = None, n_removed_col: str | None = None) -> DataFrame:
    """All rows and columns, the text without its repeated chunks; on request the lines there were and those that went."""
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    go = removals(chunks(base))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    # What goes grows with the corpus, so it is never broadcast, however small it is here.
    go = go.withColumnsRenamed({"id": "gone_id", "h": "gone_h"}).hint("merge")
    met = rows.join(go, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    cut = _steps(met.select("row", "gone", F.expr(f"if(gone IS NULL, '', row.`{text_col}`) AS t")), 4)
    left = "array_join(filter(texts, (x, j) -> NOT array_contains(gone, j)), '\\n')"
    text: Column = F.expr(f"if(gone IS NULL, row.`{text_col}`, {left})")
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    if n_lines_col:
        columns.append(F.expr(f"coalesce(length(row.`{text_col}`) - length(replace(row.`{text_col}`, '\\n', '')) + 1, 0L)").cast("long").alias(free_name(df, n_lines_col)))
    if n_removed_col:
        columns.append(F.expr("if(gone IS NULL, 0L, aggregate(filter(spans, (s, j) -> array_contains(gone, j)), 0L, (a, s) -> a + s.last - s.first + 1))").alias(free_name(df, n_removed_col)))
    return cut.select(*columns)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), hashed AS (
  SELECT *, ('0x' || left(md5(line), 13))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) + 1 >= {LONG_LINE} AS long FROM lines
), ended AS (
  SELECT *, i = n OR long OR coalesce(lead(long) OVER d, false) OR (coalesce(lag(h) OVER d, 0) * 31 + h) % {DIVISOR} = 0 AS ends
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM ended
), chunked AS (
  SELECT doc_id, idx, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines,
         sum(length(line) - length(replace(line, ' ', '')) + 1) AS words
  FROM numbered GROUP BY doc_id, idx
), ranked AS (
  SELECT *, ((n_lines > 1 AND words >= {MIN_WORDS}) OR words >= {LONG_LINE})
            AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, idx) > 1 AS gone
  FROM chunked
), rebuilt AS (
  SELECT doc_id, sum(n_lines) AS n_lines, sum(CASE WHEN gone THEN n_lines ELSE 0 END) AS n_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '') AS text
  FROM ranked GROUP BY doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed_lines, sha256(text) AS text_sha256 FROM rebuilt
"""
