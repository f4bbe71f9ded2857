"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, licenses, media, neardup, packing, pii, quality, secrets, sharding, token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_found(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    return digest(found, [*pii.KINDS, *(f"crf_{k}" for k in pii.KINDS)], 4, "kind")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.read_media(media.write_media(documents(spark, sf_dir))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), 40, "rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def joined(kinds: list[str], order: str, base_only: bool) -> F.Column:
    """kind:start:end of spans, comma-joined; order: by kind as listed and then start, or by start and then kind."""
    spans = F.filter("spans", lambda s: s["base"]) if base_only else F.col("spans")
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct((place(s) if order == "kind" else s["start"]).alias("first"), (s["start"] if order == "kind" else place(s)).alias("second"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, kinds: list[str], n_base: int, order: str) -> DataFrame:
    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds[:n_base]]
    return found.select("doc_id", *counts, F.sha2(joined(kinds, order, True), 256).alias("base_sha256"), joined(kinds, order, False).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return digest(found, [r.kind for r in secrets.RULES], 3, "start")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_packing, op3_personal_data, op4_media, op5_quality, op6_sharding, op7_decontamination, op8_token_counts, op9_secrets, op10_near_duplicates)}
ORACLES: dict[str, str] = {}
