"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, language, lm, manifest, merkle, mixing, pii, quality, sharding, simhash, spelling, substrings, warc
from lectern.llm.common import read
from lectern.llm.sql import oracle_sql  # noqa: F401  part of this module's interface


def byte_bpe() -> bytes:
    """The vocabulary file's content; read on the driver, where the package is installed."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang_pred is the nearest learned language even where the distance rejects it; rejected says so."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe()).drop("text")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *quality.METRICS, "base_failed", "kept", "host_docs", "host_rejected"]
    return quality.scores(read(spark, sf_dir, "documents")).select(*columns)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write(read(spark, sf_dir, "pages"))
    return warc.read(manifest, folder).drop("payload", "url")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the spans of the rules, as base_sha256 does; n_added those that the tagger adds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    all_ = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(all_).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the id's crc32, the text's A to Z are in lower case when the row is held against its proof."""
    docs = read(spark, sf_dir, "documents").select(*manifest.COLUMNS)
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    text = F.translate("text", spelling.UPPER, spelling.LOWER)
    return manifest.verified(docs, changed, [text if c == "text" else F.col(c) for c in manifest.COLUMNS])


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_bpe, op3_substrings, op4_sharding, op5_lm, op6_mixing, op7_merkle, op8_quality, op9_warc, op10_simhash, op11_pii, op12_spelling, op13_manifest)}
