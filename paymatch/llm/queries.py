"""Registered queries of the thirteen operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paymatch.llm import (conversations, decontaminate, licenses, line_dedup, merkle, mixing, near_dups, nn_descent, pieces,
                          pii_crf, quality, sharding, warc)

#: Model file of the tokenizer that op13 applies, among those of the ``public_tokenizers`` module.
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    # a null text has no bytes, and so the checksum of none
    marked = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    placed = sharding.shards(marked, keep=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.array("source"), keep=["doc_id", "source"])
    targets = F.broadcast(mixing.source_targets(docs))  # one row per source
    return (mixed.join(targets, F.col("source").eqNullSafe(F.col("name")), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("uses") * F.col("size")).alias("taken")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.size("removed").cast("long")
    # the places are those of the text as it was: what is left and what went
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    left = F.when((F.col("text") == "") & (removed > 0), 0).otherwise(left)
    return clean.select("doc_id", (left + removed).alias("n_lines"), removed.alias("n_removed"),
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("pii")).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).select("doc_id", "line", "license", "dice")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, merkle.leaf_of(merkle.lowered(F.col("text"))))
    manifest = merkle.build(docs, {"changed": changed})
    return merkle.verify(manifest, manifest.leaves)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damage(rows))
    summary = fixed.summary.withColumnRenamed("conv_id", "_summed")
    digests = conversations.digests(fixed.turns).withColumnRenamed("conv_id", "_hashed")
    ids = rows.select("conv_id").distinct()
    found = (ids.join(summary, F.col("conv_id").eqNullSafe(F.col("_summed")), "left")
             .join(digests, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.Model(public_tokenizers.path(PIECES))
    encoded = pieces.encode(_read(spark, sf_dir, "documents"), model, ["doc_id"])
    decoded = pieces.decode(encoded, model, ["doc_id", "ids", "spans"])
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                          F.sha2("spans", 256).alias("spans_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE, "op6_licenses": licenses.oracle()}
