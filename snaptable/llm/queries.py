"""The operators over their whole tables, with production parameters; registered by __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import ORACLE as CHAT_SQL
from .chat import rotation_rows
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import audit
from .jpeg import encode_media, media_digest
from .licenses import license_digest, scan_licenses
from .mixing import ORACLE as MIXING_SQL
from .mixing import mixed_rows
from .near_dedup import ORACLE as NEAR_SQL
from .near_dedup import linked
from .packing import pack
from .pieces import token_pieces
from .pitman_yor import score_rows
from .scratch import Scratch
from .slice_codes import ORACLE as CODES_SQL
from .slice_codes import compress
from .token_counts import count_tokens
from .token_files import read_documents, write_token_files
from .toxicity import toxicity_rows
from .vp_search import nearest


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch.path("files"), tokenizer("word_bpe_49k.json"), end_id=2)
    return read_documents(scratch.table(manifest, "manifest"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(Scratch(spark, "op2"), table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return pack(Scratch(spark, "op3"), pieces)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_rows(Scratch(spark, "op4"), table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_rows(Scratch(spark, "op5"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_rows(table(spark, sf_dir, "conversations"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(Scratch(spark, "op7").table(encode_media(table(spark, sf_dir, "documents")), "media"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(Scratch(spark, "op9"), table(spark, sf_dir, "documents"))


def op10_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(Scratch(spark, "op10"), table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, factor=5.0)


def op11_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(Scratch(spark, "op11"), table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op13_fp_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(Scratch(spark, "op13"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_pitman_yor, op3_packing, op4_mixing, op5_toxicity, op6_chat_rotation, op7_progressive_jpeg, op8_token_counts, op9_near_dedup, op10_vp_search, op11_slice_codes, op12_license_scan, op13_fp_divergence)
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": MIXING_SQL, "op6_chat_rotation": CHAT_SQL, "op9_near_dedup": NEAR_SQL, "op11_slice_codes": CODES_SQL, "op13_fp_divergence": DIVERGENCE_SQL}
