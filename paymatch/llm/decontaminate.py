"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some words of a short span and ignore the others, so a span
with substituted words still hashes alike under a mask that skips them. Seeds
of all documents meet the seeds of the benchmark; for each diagonal that is hit, document and
item are compared over all of the item that lies in the document. A matching word
scores 1, another word -PENALTY; an item is found if a stretch scores
enough for its size (:func:`enough`). DataFrame operations only.

The plan is the same at every size. Document seeds pass a sieve of the benchmark's seeds (a
bit table of fixed size, so it is no switch: a larger benchmark lets more seeds pass), and what passes is
shuffled without its text, as (document, place, seed), and joined exactly. Only texts that the sieve of the hits' documents lets
pass are then shuffled, once, to their hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.llm.store import drop, save

#: Word places that each mask reads; the places between are ignored.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 9), (0, 2, 3, 5, 8, 9))
SPAN = 10
#: Items with fewer words than this are no evidence and are not looked for.
SHORTEST = 5
#: Items from this size on are found with one substituted word anywhere. Those below ``SPAN`` are
#: looked up by their first and last ``HALF`` words, one of which a single substitution leaves alone.
TOLERANT = 8
HALF = 4
LEAST = 12
PENALTY = 2
#: Bits of the sieve: a table of 2 MB.
SIEVE_BITS = 24


def enough(size: Column) -> Column:
    """Score at which an item of so many words is found: all of a short one; one substitution's loss less, 12 at most."""
    return F.when(size < TOLERANT, size).otherwise(F.least(F.lit(LEAST), size - 1 - PENALTY))


def _words(text: Column) -> Column:
    """Lower-cased words, split at ASCII white space."""
    return F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), r"[\x20\x09-\x0D]+")


def _seeds(masks: list[tuple[int, ...]], words: str, at: Column) -> Column:
    """One hash per mask at word place ``at``."""
    return F.array(*[F.xxhash64(F.lit(str(m)), *[F.get(F.col(words), at + k) for k in m]) for m in masks])


def _sieve(keys: DataFrame, name: str) -> Column:
    """A bit table of the hashes in column ``name``: an array of 2^SIEVE_BITS / 64 longs, whatever their number."""
    words = 1 << SIEVE_BITS - 6
    bits = keys.groupBy(F.expr(f"{name} & {words - 1}").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright({name}, {SIEVE_BITS - 6}) & 63 AS int))")).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("w"))
    table = every.join(bits, "w", "left").agg(F.array_sort(F.collect_list(F.struct(
        "w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("table"))
    return save(table.select(F.col("table.bits").alias("table")), "sieve").scalar()


def _passes(sieve: Column, name: str) -> Column:
    """Whether a hash may be among the sieve's (always, if it is)."""
    words = 1 << SIEVE_BITS - 6
    word = F.get(sieve, F.expr(f"cast({name} & {words - 1} AS int)"))
    bit = F.expr(f"shiftleft(1L, cast(shiftright({name}, {SIEVE_BITS - 6}) & 63 AS int))")
    return word.bitwiseAND(bit) != 0


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct items that are long enough, with a key of their own."""
    text = F.col("text").cast("string")
    items = benchmark.select("item_id", text.alias("text")).dropDuplicates(["item_id", "text"])
    items = items.select("item_id", F.xxhash64(F.col("item_id").cast("string"), F.col("text"), F.col("item_id").isNull())
                         .alias("item_key"), _words(F.col("text")).alias("item_words"))
    return items.where(F.size("item_words") >= SHORTEST)


def _item_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(seed, item_key, item_at): three masks everywhere in an item; a short item whole, or its two halves."""
    n, at = F.size("item_words"), F.col("item_at")
    place = F.explode(F.sequence(F.lit(0), n - HALF)).alias("item_at")
    seeds = (items.select("item_key", "item_words", place)
             .select("item_key", "item_at", n.alias("n"), F.posexplode(_seeds(masks, "item_words", at)).alias("mask", "seed")))
    fits = F.lit(False)
    for i, m in enumerate(masks):
        span = m[-1] + 1
        if i < len(MASKS):
            fit = at + span <= F.col("n")
        elif span == HALF:
            fit = (F.col("n") >= TOLERANT) & (F.col("n") < SPAN) & ((at == 0) | (at == F.col("n") - HALF))
        else:
            fit = (F.col("n") == span) & (at == 0)
        fits = F.when(F.col("mask") == i, fit).otherwise(fits)
    return seeds.where(fits).select("seed", "item_key", "item_at")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in documents.

    Returns one row per document and item: doc_id, text_hash (xxhash64 of the
    text, to tell rows of one id apart), item_id, score (best stretch), at
    (first word of the item's diagonal in the document; negative if the start is
    missing), item_size. Null texts hold nothing; null ids are kept as they are;
    repeated documents give one row, and so do repeated items. Items below five words are not looked for.
    """
    items = save(_items(benchmark), "items")
    sizes = sorted(r[0] for r in items.where(F.size("item_words") < SPAN)
                   .select(F.size("item_words")).distinct().collect())  # at most SPAN - SHORTEST numbers
    short = [tuple(range(n)) for n in sizes if n < TOLERANT]
    halves = [tuple(range(HALF))] if any(n >= TOLERANT for n in sizes) else []
    masks = [*MASKS, *short, *halves]
    seeds = save(_item_seeds(items, masks), "item-seeds")

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    named = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    places = named.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - HALF, F.lit(0)))).alias("place"))
    hashed = places.select("doc_id", "text_hash", "place", F.explode(_seeds(masks, "words", F.col("place"))).alias("seed"))
    # a sieve lets what it holds pass: the joins behind it are exact
    passed = hashed.where(_passes(_sieve(seeds, "seed"), "seed"))
    hits = passed.join(seeds.hint("merge"), "seed").select("doc_id", "text_hash", "item_key", (F.col("place") - F.col("item_at")).alias("at"))
    hits = save(hits.distinct(), "hits")
    held = named.where(_passes(_sieve(hits.select("text_hash"), "text_hash"), "text_hash"))
    at = hits.join(items, "item_key").withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    aligned = held.join(at.hint("merge"), same).select("doc_id", "text_hash", "item_id", *_diagonal())
    score = F.aggregate(
        F.zip_with("part", "item_part", lambda a, b: a.eqNullSafe(b)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, same: _step(s, same), lambda s: s["best"])
    scored = aligned.withColumn("score", score).where(F.col("score") >= enough(F.col("item_size")))
    found = (scored.groupBy("doc_id", "text_hash", "item_id", "item_size")
             .agg(F.max(F.struct("score", F.negative("at").alias("back"))).alias("top"))
             .select("doc_id", "text_hash", "item_id", F.col("top.score").alias("score"),
                     F.negative("top.back").alias("at"), "item_size"))
    drop(seeds)
    return found


def _diagonal() -> list[Column]:
    """Words of both sides along the diagonal, as far as the item lies in the document."""
    at, size = F.col("at"), F.size("item_words")
    low = F.greatest(F.lit(0), -at)
    high = F.least(size, F.size("words") - at)
    return [F.slice("words", at + low + 1, high - low).alias("part"),
            F.slice("item_words", low + 1, high - low).alias("item_part"), at, size.alias("item_size")]


def _step(s: Column, same: Column) -> Column:
    now = F.greatest(F.lit(0), s["now"] + F.when(same, 1).otherwise(-PENALTY))
    return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns as they are, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("hash") == F.col("leak_hash"))
    return named.join(found, same, "left_anti").select("row.*")
