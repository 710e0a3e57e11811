"""Join helpers: skew-splittable joins, lookups, semi/anti membership.

No helper measures anything while a plan is built, and none forces a
broadcast: whether a side is small enough is Spark's decision, by its size in
bytes. Beyond that every join here has a plain exchange under both of its
inputs, the one shape that adaptive execution can split when a partition is
skewed, as finely as the data asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number of distinct salt values given to rows whose join key cannot match.
NULL_SALT_BUCKETS = 1024


def salted_key(col: str | Column, *spread: str, blank: bool = False,
               buckets: int = NULL_SALT_BUCKETS) -> Column:
    """Join key with NULLs (and ``''`` with ``blank``) replaced by unmatchable values.

    Spark hashes every NULL key to the same shuffle partition; for an outer
    join whose NULL-key rows are a large share of the input that partition
    becomes the straggler. The salt is a deterministic hash of ``spread``
    columns (the same on every task attempt) prefixed by a control character;
    callers also require the original key in the join condition, so a salted
    row can never match.
    """
    if not spread:
        raise ValueError("salted_key needs columns to spread by")
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    salt = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("string"))
    unmatchable = c.isNull() | (c == "") if blank else c.isNull()
    return F.when(unmatchable, salt).otherwise(c)


def skew_join(facts: DataFrame, dim: DataFrame, fact_key: str | Column, dim_key: str,
              how: str = "left") -> DataFrame:
    """Equi-join of facts with a side that is unique (or nearly so) on its key.

    A side that was just de-duplicated or aggregated is already partitioned by
    its key, so Spark would join it without an exchange — and adaptive
    execution splits a skewed partition only where both inputs are plain
    exchanges. A second key, the hash of the first, asks for an exchange of
    its own; the extra shuffle is that of the narrow side. A key that holds a
    third of all facts is then split at run time into as many tasks as its
    size needs. NULL keys never match.
    """
    return skew_joins(facts, fact_key, [(dim, dim_key)], how)


def skew_joins(facts: DataFrame, fact_key: str | Column, dims: Sequence[tuple[DataFrame, str]],
               how: str = "left") -> DataFrame:
    """:func:`skew_join` with several sides on one key; the facts are shuffled once."""
    key = F.col(fact_key) if isinstance(fact_key, str) else fact_key
    out = facts.withColumn("_sj_key", key).withColumn("_sj_hash", F.xxhash64("_sj_key"))
    for dim, dim_key in dims:
        d = dim.withColumn("_sj_dkey", F.col(dim_key).cast(out.schema["_sj_key"].dataType))
        d = d.withColumn("_sj_dhash", F.xxhash64("_sj_dkey"))
        out = out.join(d, (out["_sj_key"] == d["_sj_dkey"]) & (out["_sj_hash"] == d["_sj_dhash"]), how)
        out = out.drop("_sj_dkey", "_sj_dhash")
    return out.drop("_sj_key", "_sj_hash")


def lookup_flag(facts: DataFrame, key: str, lookup_keys: DataFrame, lookup_col: str,
                flag_name: str, spread: tuple[str, ...]) -> DataFrame:
    """Add boolean ``flag_name``: does ``facts[key]`` occur in ``lookup_keys``?

    ``lookup_keys`` is de-duplicated first (partial aggregation), so the
    join never fans out: a fact row matches at most one lookup row (R9).
    NULL keys are salted by ``spread``; hot keys are split (``skew_join``).
    """
    lk = (lookup_keys.select(F.col(lookup_col).cast("string").alias("_lk_key"))
          .where(F.col("_lk_key").isNotNull()).distinct()
          .withColumn("_lk_hit", F.lit(True)))
    out = skew_join(facts, lk, salted_key(key, *spread), "_lk_key", "left")
    hit = F.coalesce(F.col("_lk_hit"), F.lit(False)) & F.col(key).isNotNull()
    return out.withColumn(flag_name, hit).drop("_lk_key", "_lk_hit")


def _key_set(keys: DataFrame, keys_col: str) -> DataFrame:
    k = F.col(keys_col)
    return keys.select(k.alias("_in_key")).where(k.isNotNull()).distinct()


def present_in(df: DataFrame, key: Column, keys: DataFrame, keys_col: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (``IN (SELECT ...)``, J6).

    Spark splits only the left side of a semi or anti join at run time, so the
    keys are reduced to distinct ones first (map-side), and a key with
    a third of all rows on either side fills no task. The distinct keys are
    hashed, so the rows, mostly many times as many, are not sorted.
    """
    return skew_join(df, _key_set(keys, keys_col).hint("shuffle_hash"), key, "_in_key", "left_semi")


def missing_in(df: DataFrame, key: Column, keys: DataFrame, keys_col: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (left join + IS NULL, J15); NULL keys are in none."""
    return skew_join(df, _key_set(keys, keys_col), key, "_in_key", "left_anti")
