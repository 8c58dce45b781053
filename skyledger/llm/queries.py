"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm import bpe, licenses, packing, pii, quality, restaurants, runs, sharding, simhash, topk, toxicity, unigram, whitening
from skyledger.llm.common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scores(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(~toxicity.in_training(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.detect(docs, pii.train(docs))

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def rank(s):
        return F.array_position(F.array(*[F.lit(k) for k in pii.KINDS]), s["kind"])

    both = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                        .when(rank(a) != rank(b), (rank(a) - rank(b)).cast("int")).otherwise(a["end"] - b["end"]))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        line(both).alias("spans"), F.size("added").cast("long").alias("n_added"))


@query
def op7_min_cost_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.reshard(spark, f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                       F.col(rows.columns[-2]).alias("shard"), F.col(rows.columns[-1]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLES["op10_threshold_topk"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, 65)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restaurants.fit_and_score(documents(spark, sf_dir))


def planted_period(doc, words: list) -> list:
    """Documents that a checksum of the id picks repeat a stretch of their own words up to their end."""
    import zlib

    h = zlib.crc32(str(doc).encode())
    n = len(words)
    if doc is None or h % 10 or not n:
        return words
    start = h // 10 % n
    period = 1 + (n - start) // (3 + h // 10 % 8)
    block = words[start:start + period]
    return words[:start] + (block * ((n - start) // period + 1))[:n - start]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(documents(spark, sf_dir), rewrite=planted_period)
    # Runs are sorted by start and period, so the first of equal exponents stays.
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("most", most)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
                        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detect(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
                        F.array_max("places").alias("last_word"), F.array_join("labels", ",").alias("base_labels"),
                        F.array_join("all_labels", ",").alias("labels"), "score")


ORACLES["op13_license_scan"] = licenses.oracle()
