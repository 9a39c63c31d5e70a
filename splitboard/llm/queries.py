"""The registered queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .byte_bpe import encode_bytes
from .chat import rotate_perspectives
from .common import remainder, table
from .exact_dedup import content_sort
from .filter_audit import audit_filters
from .fingerprint import successor_fingerprints
from .licenses import scan_licenses
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import quality
from .sharding import shard_records
from .term_audit import audit_sources
from .toxicity import toxicity

#: Remainders of crc32(doc_id) that are held out of learning: (modulus, remainder).
TOXIC_HELD_OUT, QUALITY_HELD_OUT = (4, 2), (5, 0)


def held_out(fold: tuple[int, int]):
    return remainder("doc_id", fold[0]) == fold[1]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(TOXIC_HELD_OUT))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="max")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source and language. The table has no file names, so
    none is a licence file that speaks for its directory: a document has the licence that
    it declares itself, and the steps over directories are left out."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), inherit=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successor_fingerprints(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(QUALITY_HELD_OUT))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_bytes(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_exact_dedup,
        op3_minhash,
        op4_licenses,
        op5_mixing,
        op6_sharding,
        op7_fingerprints,
        op8_quality,
        op9_bpe,
        op10_chat,
        op11_divergence,
        op12_byte_bpe,
        op13_filter_audit,
    )
}
