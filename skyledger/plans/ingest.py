"""Queries for readers, writers and streaming jobs; outputs go to the staging folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from skyledger.functions import exprs as x
from skyledger.operators import fit
from skyledger.plans.arrays import PIX, spectra
from skyledger.plans.registry import query
from skyledger.plans.tables import r, round_all, table
from skyledger.session import staging_folder
from skyledger.sources import datasets, models, tables, writers
from skyledger.sources.datasets import lookup
from skyledger.streaming import jobs


def fresh(spark) -> str:
    return f"{staging_folder(spark)}/{uuid.uuid4().hex}"


@query("column_scan", f"SELECT l_orderkey, l_linenumber, {r('l_quantity')} AS l_quantity FROM lineitem")
def column_scan(spark, sf):
    return round_all(tables.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]))


@query("scalar_scan", "SELECT vec_id, label FROM embeddings")
def scalar_scan(spark, sf):
    return tables.scalar_columns(table(spark, sf, "embeddings"), "vec_id")


@query("optional_columns", """SELECT l_orderkey AS sdss_id, l_quantity AS snr, l_linenumber AS spectrum_flags, NULL::DOUBLE AS zeropoint, true AS spectrum_ok FROM lineitem""")
def optional_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sdss_id"), F.col("l_quantity").alias("snr"),
                                             F.col("l_linenumber").alias("spectrum_flags"))
    return tables.spectra_metadata(li)


@query("result_catalog", f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, {r('l_quantity')} AS plx,
  {r('l_tax')} AS e_plx, {r('l_discount')} AS plx_sp, {r('l_tax')} AS err_sp, true AS train, l_returnflag AS sample FROM lineitem""")
def result_catalog(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("fold", F.concat(F.lit("  "), "l_returnflag", F.lit(" ")))
    out = tables.result_catalog(li, {"plx": "l_quantity", "e_plx": "l_tax", "plx_sp": "l_discount", "err_sp": "l_tax", "sample": "fold"},
                                row_id=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return round_all(out)


@query("head_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def head_rows(spark, sf):
    return tables.head(table(spark, sf, "customer").select("c_custkey", "c_name"), 100, ["c_custkey"])


@query("membership_text", f"SELECT 4000000000000000000 + l_orderkey AS member_id, {r('l_quantity / 50')} AS prob, count(*) AS n FROM lineitem GROUP BY 1, 2")
def membership_text(spark, sf):
    li = table(spark, sf, "lineitem")
    path = fresh(spark)
    line = F.concat_ws("  ", (F.lit(4000000000000000000) + F.col("l_orderkey")).cast("string"), F.col("l_tax").cast("string"),
                       (F.col("l_quantity") / 50).cast("string"), F.when(F.col("l_linenumber") == 1, "# note 7"))
    li.select(line.alias("value")).union(spark.createDataFrame([("# id x prob",)], "value string")).write.text(path)
    out = tables.membership_text(spark, path)
    return round_all(out.groupBy("member_id", "prob").agg(F.count(F.lit(1)).alias("n")))


@query("write_and_read_back", f"SELECT o_orderkey, {r('o_totalprice', 2)} AS o_totalprice FROM orders")
def write_and_read_back(spark, sf):
    path = fresh(spark)
    writers.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path)
    return round_all(tables.scan(spark, path), 2)


@query("write_per_cluster", "SELECT l_suppkey::INT AS cluster, count(*) AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1")
def write_per_cluster(spark, sf):
    path = fresh(spark)
    li = table(spark, sf, "lineitem")
    writers.write_per_cluster(li.withColumnRenamed("l_suppkey", "cluster"), path, rows_per_task=200)
    return spark.read.parquet(path).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("compact_files", f"""SELECT 'row' AS what, l_orderkey, l_linenumber, l_partkey, {r('l_extendedprice', 2)} AS price FROM lineitem
  UNION ALL SELECT 'files', (SELECT count(*) FROM lineitem) // 5000, 5000, NULL, NULL""")
def compact_files(spark, sf):
    path = fresh(spark)
    writers.compact(spark, f"{sf}/lineitem.parquet", path, rows_per_file=5000)
    back = spark.read.parquet(path)
    full = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).where("n = 5000")
    sizes = full.agg(F.lit("files").alias("what"), F.count(F.lit(1)).alias("l_orderkey"), F.lit(5000).alias("l_linenumber"),
                     F.lit(None).cast("long").alias("l_partkey"), F.lit(None).cast("double").alias("price"))
    rows = back.select(F.lit("row").alias("what"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    return round_all(rows.unionByName(sizes), 2)


@query("quarantine", f"""SELECT CASE WHEN c_acctbal >= 0 THEN 'ok' ELSE 'failed' END AS part, c_custkey, {r('c_acctbal', 2)} AS c_acctbal,
  {r('CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END')} AS balance_log FROM customer""")
def quarantine(spark, sf):
    ok, failed = fresh(spark), fresh(spark)
    c = table(spark, sf, "customer").withColumn("balance_log", F.when(F.col("c_acctbal") >= 0, F.log1p("c_acctbal")))
    writers.write_with_quarantine(c, F.col("balance_log").isNotNull(), ok, failed, ["c_custkey", "c_acctbal"])
    good = spark.read.parquet(ok).select(F.lit("ok").alias("part"), "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"),
                                         F.round("balance_log", 6).alias("balance_log"))
    bad = spark.read.parquet(failed).select(F.lit("failed").alias("part"), "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    return good.unionByName(bad, allowMissingColumns=True)


@query("model_round_trip", f"""WITH p AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT i::INT AS feature, {r('avg(v)')} AS mu, {r('stddev_pop(v)')} AS sd, {r('i / 7.0 - 3')} AS theta, 'dr17' AS dataset FROM p GROUP BY i""")
def model_round_trip(spark, sf):
    from skyledger.operators.spectra import feature_stats
    mu, sd, _ = feature_stats(table(spark, sf, "embeddings"), "embedding")
    path = fresh(spark)
    models.save_linear(spark, path, {"all": fit.LinearModel(np.arange(-1, 64) / 7.0 - 3, mu, sd)}, good=np.ones(64, bool), frac_sigma=0.08,
                       dataset=lookup("dr17"), config={"lam": 1.0})
    back = models.load_linear(spark, path)
    m = back["models"]["all"]
    out = spark.createDataFrame([(i, float(a), float(b), float(t), back["dataset"]["name"])
                                 for i, (a, b, t) in enumerate(zip(m.mu, m.sd, m.theta[1:]))],
                                "feature int, mu double, sd double, theta double, dataset string")
    return round_all(out)


# --- streaming -----------------------------------------------------------------
@query("stream_ingest", f"SELECT event_id, event_type, {r('ln(1 + value)')} AS log_value FROM events WHERE value > 5")
def stream_ingest(spark, sf):
    schema = table(spark, sf, "events").schema
    target, checkpoint = fresh(spark), fresh(spark)

    def work(df):
        return round_all(df.filter("value > 5").select("event_id", "event_type", F.log1p("value").alias("log_value")))

    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(spark, jobs.table_source(f"{sf}/events.parquet"), schema, target, checkpoint, work, {"min_value": 5}).awaitTermination()
    return spark.read.schema("event_id long, event_type string, log_value double").parquet(target)


@query("stream_members_scored", f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (1, 3, 5))
  SELECT vec_id, {r('exp(0.2 + sum(v * ((i * 7 % 11) - 5) / 10.0::DOUBLE))', 5)} AS plx_sp FROM e GROUP BY vec_id""")
def stream_members_scored(spark, sf):
    e = table(spark, sf, "embeddings")
    members = e.filter(F.col("label").isin(1, 3, 5)).select("vec_id")
    theta = np.concatenate([[0.2], [((i * 7 % 11) - 5) / 10.0 for i in range(1, 65)]])
    stream = jobs.file_stream(spark, jobs.table_source(f"{sf}/embeddings.parquet"), e.schema).withColumnRenamed("embedding", "features")
    target = fresh(spark)
    scored = jobs.members_scored(stream, members, "vec_id", fit.LinearModel(theta, np.zeros(64), np.ones(64)), ["vec_id"])
    (scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", fresh(spark))
     .trigger(availableNow=True).start().awaitTermination())
    return round_all(spark.read.schema(scored.schema).parquet(target), 5)


@query("stream_running_counts", "SELECT event_type, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark, sf):
    stream = jobs.file_stream(spark, jobs.table_source(f"{sf}/events.parquet"), table(spark, sf, "events").schema)
    state = fresh(spark)
    jobs.running_counts(stream, ["event_type"], F.col("value") > 50, state, fresh(spark)).awaitTermination()
    return jobs.latest_counts(spark, state)


@query("stream_pixel_counts", f"WITH {PIX} SELECT telescope, p::INT AS pixel, sum((flag <> 0)::INT)::BIGINT AS hits, count(*) AS n FROM px GROUP BY 1, 2")
def stream_pixel_counts(spark, sf):
    source, state = fresh(spark), fresh(spark)
    flagged = spectra(spark, sf).select("telescope", "pixel_flags")
    flagged.repartition(4).write.parquet(source)
    stream = jobs.file_stream(spark, source, flagged.schema, files_per_batch=2)
    jobs.running_pixel_counts(stream, state, fresh(spark)).awaitTermination()
    return jobs.latest_pixel_counts(spark, state)


# --- schema checks, labels, anchors, datasets ------------------------------------------
_WANTED = ["l_orderkey", "flux", "l_comment_id"]


@query("missing_columns", """WITH li AS (SELECT l_orderkey, CASE WHEN l_quantity < 0 THEN 1 END AS l_comment_id FROM lineitem)
  SELECT 'lines' AS "table", count(*) AS n_rows, 'flux' AS lacks, CASE WHEN count(l_comment_id) = 0 THEN 'l_comment_id' ELSE '' END AS empty FROM li
  UNION ALL SELECT 'orders', count(*), 'l_orderkey,flux,l_comment_id', '' FROM orders""")
def missing_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 0, 1).alias("l_comment_id"))
    gaps = tables.column_gaps({"lines": li, "orders": table(spark, sf, "orders")}, _WANTED)
    return gaps.select("table", "n_rows", F.array_join("lacks", ",").alias("lacks"), F.array_join("empty", ",").alias("empty"))


@query("labelled_files", f"SELECT l_returnflag AS cluster, l_orderkey, {r('l_quantity')} AS l_quantity FROM lineitem")
def labelled_files(spark, sf):
    li, folder = table(spark, sf, "lineitem"), fresh(spark)
    for flag in [row[0] for row in li.select("l_returnflag").distinct().collect()]:  # three flags
        writers.write_table(li.filter(F.col("l_returnflag") == flag), f"{folder}/{flag}_matched.parquet")
    # A folder stands for a member file here, so its name is taken one level up.
    got = spark.read.parquet(f"{folder}/*").select("l_orderkey", "l_quantity", F.regexp_extract(
        "_metadata.file_path", "([^/]*)_matched\\.parquet/", 1).alias("cluster"))
    return round_all(got)


@query("anchor_table", f"SELECT s_suppkey AS sdss_id, {r('s_acctbal')} AS mu, {r('abs(s_acctbal) / 100')} AS mu_err, s_name AS \"group\" FROM supplier")
def anchor_table(spark, sf):
    path = f"{fresh(spark)}.csv"
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sdss_id"), F.col("s_acctbal").alias("mu"),
                                            (F.abs("s_acctbal") / 100).alias("mu_err"), F.col("s_name").alias("group"))
    s.write.option("header", True).csv(path)
    return round_all(tables.anchors(spark, path))


# Saved models name their dataset, or only list its bands, or list bands that no dataset has, or neither.
_BANDS = list(lookup("dr17")["bands"])
_MODELS_SQL = f"""models AS (SELECT vec_id, CASE label % 4 WHEN 0 THEN 'dr17' WHEN 1 THEN 'gone' END AS name,
    CASE label % 4 WHEN 0 THEN ['x'] WHEN 1 THEN {_BANDS} WHEN 2 THEN {_BANDS[:2]} END AS bands,
    CASE WHEN label % 3 = 0 THEN 'dr17' ELSE 'dr99' END AS target FROM embeddings)"""


def _models(spark, sf):
    kind = F.col("label") % 4
    bands = F.when(kind == 0, F.array(F.lit("x"))).when(kind == 1, F.array(*map(F.lit, _BANDS))).when(kind == 2, F.array(*map(F.lit, _BANDS[:2])))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.when(kind == 0, "dr17").when(kind == 1, "gone").alias("name"), bands.alias("bands"),
        F.when(F.col("label") % 3 == 0, "dr17").otherwise("dr99").alias("target"))


@query("dataset_resolution", f"""WITH {_MODELS_SQL} SELECT vec_id, CASE WHEN name = 'dr17' OR bands = {_BANDS} THEN 'dr17' WHEN bands IS NOT NULL THEN 'legacy' END AS dataset,
  array_to_string(CASE WHEN name = 'dr17' THEN {_BANDS} ELSE bands END, ',') AS bands FROM models""")
def dataset_resolution(spark, sf):
    found = datasets.resolve(_models(spark, sf), datasets.dataset_table(spark))
    return found.select("vec_id", "dataset", F.array_join("dataset_bands", ",").alias("bands"))


@query("foreign_bands", f"""WITH {_MODELS_SQL} SELECT vec_id, coalesce(target <> 'dr17' OR bands <> {_BANDS}, true) AS refused FROM models""")
def foreign_bands(spark, sf):
    return datasets.foreign_models(_models(spark, sf), datasets.dataset_table(spark)).select("vec_id", "refused")


@query("prefixed_ids", """SELECT c_custkey, '2M' || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS id FROM customer
  WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 5 = 0""")
def prefixed_ids(spark, sf):
    """Ids as bytes, some with the prefix in either case, some blank."""
    k = F.col("c_custkey")
    plain = F.when(k % 3 == 0, F.col("c_name")).otherwise(k.cast("string"))
    raw = F.when(k % 5 == 0, " ").when(k % 2 == 0, F.concat(F.lit(" 2m"), plain)).otherwise(F.concat(plain, F.lit("  ")))
    return table(spark, sf, "customer").select("c_custkey", x.prefixed_id(F.encode(raw, "UTF-8")).alias("id"))
