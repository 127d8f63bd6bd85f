"""A corpus pipeline: reject poor texts, drop repeated lines, keep one of near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of `documents`. Line dedup keeps every row, with a text that may become empty; near-dedup keeps one of the empty
ones; the mix drops texts without words, and repeats rows of sources whose target is above their size.

Defined cases: a null text counts as empty and is rejected by the first stage, as is a text without words; texts are used
whole at any length; a null doc_id, lang or source is kept as a value of its own; of equal rows the first stages keep
both, and near-dedup one; extra columns are carried along as they are, also those named like a column that an operator adds
inside a stage; an empty table passes through all stages. The last stage returns doc_id, lang and source, as far as they are
there, with the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import lines, mixing, pieces, quality, simhash
from weftgraph.llm.common import Scratch


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ("bad_posterior", "score", "kept")
    own = {c: f"_weft_own_{c}" for c in docs.columns if c in added}
    judged = quality.classify(docs.withColumnsRenamed(own)).where("kept").drop(*added)
    return judged.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedupe(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As op3, over 3-word shingles within 3 bits; few pairs of similarity 0.8 over five-word shingles are that near (README)."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    known = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return out.select(*known, "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_texts),
    ("line dedup", distinct_lines),
    ("simhash near-dedup", distinct_documents),
    ("source mix", mixed_sources),
    ("sentencepiece", encoded),
]

#: EM, hashed scoring, XXH64 fingerprints and SentencePiece have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
