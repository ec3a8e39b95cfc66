"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    align,
    chat_format,
    exact_dedup,
    licenses,
    mixing,
    neighbours,
    packing,
    piece_codec,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    vector_codes,
)
from strandline.llm.shared import prepare

#: Place of the public vocabularies; a parameter of the operators.
VOCABULARIES = os.environ.get("STRANDLINE_VOCABULARIES") or public_tokenizers.path("")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op2_exact_dedup",
    """SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
       FROM (SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                    sha256(coalesce(text, '')) AS text_sha256
             FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"), digest_all=True)


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    segments = token_files.write(docs, os.path.join(VOCABULARIES, "word_bpe_49k.json"), end_id=1)
    rows = token_files.read(segments).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    start = (F.col("shard_start") + F.col("start_in_shard")).alias("start")
    return rows.join(token_files.shard_starts(segments), "shard").select("doc_id", start, "n_tokens", "ids_crc32")


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces, moves = packing.pack(docs, os.path.join(VOCABULARIES, "byte_bpe_50k.json"), end_id=1)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digests, moves)


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = os.path.join(VOCABULARIES, "piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = piece_codec.decode(piece_codec.encode(docs, model, end_id=2), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, secret_scan.KINDS),
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
        "layers",
    )


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.write_segments(conversations.unionByName(own)))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, _ = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op7_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


@query("op10_license_scan", licenses.sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_align")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (os.path.join(VOCABULARIES, f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = align.align(table(spark, sf_dir, "documents"), a, b)
    kept = {c: F.col(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return align.count_links(aligned, {**kept, "groups_sha256": digest})


@query("op12_mixing", mixing.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op13_vector_codes", vector_codes.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, books = vector_codes.trained(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    coded = vector_codes.with_label_error(vector_codes.encode(blocks, books))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("code")
    digest = F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    return coded.select("vec_id", code, "error", "label_error", digest)
