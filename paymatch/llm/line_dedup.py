"""Line de-duplication by winnowing over line hashes.

Lines are compared trimmed; blank lines don't count. A run of lines *qualifies*
with ``RUN_LINES`` lines or ``RUN_WORDS`` words. From every line the shortest
qualifying run is a window; the smallest line hash of each window is selected
as a fingerprint, so two texts that share a qualifying run share a fingerprint.
Positions of fingerprints that occur more than once are joined, and the match
is extended both ways, by windows that start and windows that end around it,
as far as the lines agree. Runs that occurred before (by doc_id, then line)
are deleted; the first occurrence stays. DataFrame operations only; every join is
on a window's digest against its first occurrence, never between all copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.llm.store import drop, save

RUN_LINES = 3
RUN_WORDS = 50
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """Non-blank lines in order: (no, low, high, words): place, two hashes, number of words."""
    trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("no"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    return F.transform(F.filter(trimmed, lambda x: x["line"] != ""), lambda x: F.struct(
        x["no"].alias("no"), F.xxhash64(x["line"]).alias("low"), F.xxhash64(F.lit("line"), x["line"]).alias("high"),
        F.regexp_count(x["line"], F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))


def _length(i: Column, step: int) -> Column:
    """Lines of the shortest qualifying run from line ``i`` on (step 1) or back (step -1)."""
    words, out, total = F.col("words"), F.lit(RUN_LINES), F.lit(0)
    sums = []
    for k in range(RUN_LINES - 1):
        total = total + F.coalesce(F.get(words, i + step * k), F.lit(0))
        sums.append(total)
    for k, s in reversed(list(enumerate(sums))):
        out = F.when(s >= RUN_WORDS, k + 1).otherwise(out)
    return out


def _windows(rows: DataFrame) -> DataFrame:
    """One row per document with its ``windows``: (start, size, fingerprint, place, digest)."""
    flat = rows.select("doc_id", "text_hash", *[F.col(f"lines.{c}").alias(c) for c in ("no", "low", "high", "words")])
    places = F.sequence(F.lit(0), F.size("no") - 1)

    def window(start: Column, size: Column) -> Column:
        part = F.slice("low", start + 1, size)
        least = F.array_min(part)
        return F.struct(start.alias("start"), size.alias("size"), least.alias("fingerprint"),
                        (start + F.array_position(part, least).cast("int") - 1).alias("place"),
                        F.xxhash64(part).alias("digest_low"),
                        F.xxhash64(F.slice("high", start + 1, size)).alias("digest_high"),
                        F.slice("no", start + 1, size).alias("lines"))

    def fits(w: Column) -> Column:
        return (w["start"] >= 0) & (w["start"] + w["size"] <= F.size("no"))

    # the start may fall outside; such runs are dropped before they are read
    def runs(step: int) -> Column:
        pairs = F.transform(places, lambda i: F.struct(
            (i if step > 0 else i - _length(i, -1) + 1).alias("start"), _length(i, step).alias("size")))
        return F.filter(pairs, fits)

    both = F.array_distinct(F.concat(runs(1), runs(-1)))
    return flat.where(F.size("no") > 0).select(
        "doc_id", "text_hash", F.transform(both, lambda w: window(w["start"], w["size"])).alias("windows"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines of later repeated runs: doc_id, text_hash, removed (places of the lines, ascending).

    Rows are ordered by doc_id (null last), then by text hash, so rows that
    repeat both are one document. A window that overlaps its own first
    occurrence stays. Null and blank texts have no lines; documents without
    such lines give no row.
    """
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       _lines(F.col("text").cast("string")).alias("lines")).where("lines is not null")
    windows = save(_windows(rows), "windows")
    selected = windows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform(
        "windows", lambda w: F.struct(w["fingerprint"].alias("fingerprint"), w["place"].alias("place"))))).alias("f"))
    shared = save(selected.groupBy(F.col("f.fingerprint").alias("known")).count().where("count > 1").select("known"),
                  "fingerprints")
    spread = windows.select("doc_id", "text_hash", F.explode("windows").alias("w")).select("doc_id", "text_hash", "w.*")
    matches = save(spread.join(shared, F.col("fingerprint") == F.col("known"), "left_semi")
                   .drop("fingerprint", "place"), "matches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start")
    first = save(matches.groupBy(F.col("digest_low").alias("low"), F.col("digest_high").alias("high"))
                 .agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("low", "high", "first"),
                 "first")
    later = matches.join(first, (F.col("digest_low") == F.col("low")) & (F.col("digest_high") == F.col("high")))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = later.where(~same | (F.col("start") >= F.col("first.start") + F.col("size")))
    removed = save(later.select("doc_id", "text_hash", F.explode("lines").alias("no")).distinct()
                   .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("no")).alias("removed")), "removed")
    for used in (windows, shared, matches, first):
        drop(used)
    return removed


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and their places in ``removed``.

    All rows and other columns stay; a null text stays null. A column of
    ``docs`` that is called ``removed`` is replaced.
    """
    found = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                                        F.col("removed").alias("_removed"))
    # the other columns travel as one, so no name of theirs can clash
    rest = [c for c in docs.columns if c not in ("removed", "text")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "doc_id", "text",
                       F.xxhash64(F.col("text").cast("string")).alias("_text_hash"))
    joined = base.join(found.hint("merge"), base["doc_id"].eqNullSafe(F.col("_id"))
                       & (F.col("_text_hash") == F.col("_hash")), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    text = F.when(F.col("_removed").isNull(), F.col("text").cast("string")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select("row.*", text.alias("text"),
                         F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"))


#: The operator's result over ``documents`` in DuckDB SQL, stated without fingerprints.
ORACLE = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, no, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split
), counted AS (
  SELECT doc_id, no, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i
  FROM lines WHERE line <> ''
), around AS (
  SELECT *, lead(line, 1) OVER d AS a1, lead(line, 2) OVER d AS a2, lead(n, 1) OVER d AS n1,
         lag(line, 1) OVER d AS b1, lag(line, 2) OVER d AS b2, lag(n, 1) OVER d AS m1
  FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, i AS start, CASE WHEN n >= {RUN_WORDS} THEN 1 WHEN n + n1 >= {RUN_WORDS} THEN 2 ELSE 3 END AS size,
         CASE WHEN n >= {RUN_WORDS} THEN line WHEN n + n1 >= {RUN_WORDS} THEN line || chr(10) || a1
              ELSE line || chr(10) || a1 || chr(10) || a2 END AS run
  FROM around
  UNION
  SELECT doc_id, i - CASE WHEN n >= {RUN_WORDS} THEN 0 WHEN n + m1 >= {RUN_WORDS} THEN 1 ELSE 2 END,
         CASE WHEN n >= {RUN_WORDS} THEN 1 WHEN n + m1 >= {RUN_WORDS} THEN 2 ELSE 3 END,
         CASE WHEN n >= {RUN_WORDS} THEN line WHEN n + m1 >= {RUN_WORDS} THEN b1 || chr(10) || line
              ELSE b2 || chr(10) || b1 || chr(10) || line END
  FROM around
), firsts AS (
  SELECT run, min(struct_pack(doc_id := doc_id, start := start)) AS f FROM runs WHERE run IS NOT NULL GROUP BY run
), later AS (
  SELECT r.doc_id, r.start, r.size FROM runs r JOIN firsts USING (run)
  WHERE r.doc_id <> f.doc_id OR r.start >= f.start + r.size
), gone AS (
  SELECT DISTINCT c.doc_id, c.no FROM later l JOIN counted c
    ON c.doc_id = l.doc_id AND c.i >= l.start AND c.i < l.start + l.size
), per_doc AS (
  SELECT s.doc_id, count(*) AS n_lines, count(g.no) AS n_removed,
         coalesce(string_agg(CAST(g.no AS VARCHAR), ',' ORDER BY g.no), '') AS removed,
         coalesce(string_agg(CASE WHEN g.no IS NULL THEN s.line END, chr(10) ORDER BY s.no), '') AS kept
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.no = s.no GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
