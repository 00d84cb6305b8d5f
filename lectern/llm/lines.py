"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive non-blank lines is hashed. A window that occurs more than once in
the corpus keeps its first occurrence (smallest doc_id, then position); the lines that its later
occurrences cover are merged into intervals and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(text: Column) -> Column:
    """Positions and trimmed content of the non-blank lines."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """A row for each window: its 128-bit hash, the row it is in and its number there."""
    text = F.col(f"`{text_col}`")
    hashed = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("_row"),
        F.transform(_filled(text), lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit("half"), x["line"]).alias("b"))).alias("_h"),
    ).where(F.size("_h") >= size)
    h = F.col("_h")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(h) - size),
        lambda i: F.struct(
            F.xxhash64(*[h[i + k]["a"] for k in range(size)]).alias("_a"),
            F.xxhash64(*[h[i + k]["b"] for k in range(size)]).alias("_b"),
            i.alias("_at"),
        ),
    )
    return hashed.select("_id", "_row", F.inline(runs))


def covered(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """For each row with something to remove: the sorted numbers of its non-blank lines that go."""
    all_windows = windows(docs, id_col, text_col, size)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_at").alias("at")))
    repeated = (
        all_windows.groupBy("_a", "_b").agg(F.count("*").alias("_n"), first.alias("_first")).where("_n > 1")
        .select("_a", "_b", F.col("_first.id").alias("_fid"), F.col("_first.row").alias("_frow"), F.col("_first.at").alias("_fat"))
    )
    own = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_row") == F.col("_frow"))
    last = F.col("_at") + size - 1
    begin = F.when(own, F.greatest(F.col("_at"), F.col("_fat") + size)).otherwise(F.col("_at"))
    later = all_windows.join(repeated, ["_a", "_b"]).where(~(own & (F.col("_at") == F.col("_fat")))).select("_id", "_row", begin.alias("_from"), last.alias("_to")).where("_from <= _to")
    each = later.groupBy("_id", "_row").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))
    return each.select("_id", "_row", F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_from"], s["_to"]))))).alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, count_col: str | None = "lines_removed", chars_col: str | None = None) -> DataFrame:
    """Remove every repeat of a window of `size` consecutive non-blank lines from all rows.

    Keeps all rows and columns; text_col gets the text that is left. Lines compare without spaces
    at their ends; blank lines are skipped in windows and go only between two removed lines. A text
    with fewer than `size` non-blank lines, also an empty one, stays as it is, null stays null. A
    text all of whose windows repeat becomes empty. Where a window overlaps its own first
    occurrence in a text, the first occurrence's lines stay. Rows that repeat both id and text
    count as one row. `count_col` (None: not added) gets the number of lines removed; `chars_col`,
    if given, the new length. Columns of any other name pass through.
    """
    if count_col and count_col in docs.columns:
        raise ValueError(f"the input has a column {count_col}; name another count_col")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    text = F.col("row").getField(text_col)
    gone = covered(docs, id_col, text_col, size).select(F.col("_id").alias("gone_id"), F.col("_row").alias("gone_key"), F.col("_gone").alias("gone"))
    both = keyed.join(gone, F.col("row").getField(id_col).eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    g = F.col("gone")
    runs = both.withColumns({
        "begins": F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) != x - 1)),
        "ends": F.filter(g, lambda x, i: (i == F.size(g) - 1) | (F.get(g, i + 1) != x + 1)),
        "all": F.when(g.isNotNull(), _lines(text)),
        "pos": F.when(g.isNotNull(), F.transform(_filled(text), lambda x: x["pos"])),
    })
    raw = runs.withColumns({
        "begins": F.transform("begins", lambda x: F.get(F.col("pos"), x)),
        "ends": F.transform("ends", lambda x: F.get(F.col("pos"), x)),
    })
    b, e, lines = F.col("begins"), F.col("ends"), F.col("all")

    def piece(k: Column) -> Column:
        start = F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        end = F.coalesce(F.get(b, k), F.size(lines))
        return F.slice(lines, start + 1, end - start)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b)), piece)), "\n")
    new = F.when(g.isNull(), text).otherwise(left)
    changed = {text_col: new}
    if chars_col:
        changed[chars_col] = F.length(F.coalesce(new, F.lit(""))).cast(docs.schema[chars_col].dataType)
    extra = [F.when(g.isNull(), F.lit(0)).otherwise(F.size(g)).cast("long").alias(count_col)] if count_col else []
    return raw.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns], *extra)


#: The same removal in DuckDB's SQL, on columns doc_id and text of `documents`.
ORACLE = """
WITH raw AS (
  SELECT doc_id, i - 1 AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), filled AS (
  SELECT doc_id, pos, trim(line) AS line, row_number() OVER d - 1 AS num,
         lead(trim(line), 1) OVER d AS line2, lead(trim(line), 2) OVER d AS line3
  FROM raw WHERE trim(line) <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), seen AS (
  SELECT doc_id, num, first_value(doc_id) OVER w AS fdoc, first_value(num) OVER w AS fat
  FROM filled WHERE line3 IS NOT NULL
  WINDOW w AS (PARTITION BY line, line2, line3 ORDER BY doc_id, num)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fdoc THEN greatest(num, fat + 3) ELSE num END, num + 3)) AS num
  FROM seen WHERE NOT (doc_id = fdoc AND num = fat)
), runs AS (
  SELECT f.doc_id, f.pos, f.num - row_number() OVER (PARTITION BY f.doc_id ORDER BY f.num) AS run
  FROM filled f JOIN gone g ON f.doc_id = g.doc_id AND f.num = g.num
), cuts AS (SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM runs GROUP BY doc_id, run
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text FROM raw r
  WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.doc_id = r.doc_id AND r.pos BETWEEN c.a AND c.b) GROUP BY r.doc_id
), counts AS (SELECT doc_id, sum(n) AS n FROM cuts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(c.n, 0) AS BIGINT) AS lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""
