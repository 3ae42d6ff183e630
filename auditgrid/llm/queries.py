"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import scratch_path, table
from .funnel import Funnel

FUNNELS = [
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
]


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file is on this machine; files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_bundles, write_bundles

    path = scratch_path(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_bundles(spark, path, payload=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import rate

    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digests, token_starts, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_digests(spark, path).join(token_starts(spark, path).drop("doc_id"), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch_path(spark, "tiered-index"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op13_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .funnel import ordered_funnels

    return ordered_funnels(table(spark, sf_dir, "clicks"), FUNNELS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_join": op2_ngram_join,
    "op3_contamination": op3_contamination,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_top_k": op7_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_ranked_search": op11_ranked_search,
    "op12_neighbours": op12_neighbours,
    "op13_funnels": op13_funnels,
}

from . import sql as _sql  # noqa: E402  (its texts hold the queries' parameters)

SQL: dict[str, str] = {name: sql for name, sql in vars(_sql).items() if name[:2] == "op"}
