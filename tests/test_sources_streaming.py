import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import selection
from skyledger.operators.fit import LinearModel
from skyledger.operators.calibrate import interpolate, recalibration_factor
from skyledger.operators.spectra import hit_counts
from skyledger.session import clear_staged, stage
from skyledger.sources import models, tables, writers
from skyledger.functions import exprs
from skyledger.sources import datasets
from skyledger.sources.datasets import feature_names, lookup, spec
from skyledger.streaming import jobs


def test_membership_files_name_their_cluster(spark, tmp_path):
    big = 5853498713160606720
    (tmp_path / "NGC_3201.txt").write_text(f"# id ra prob\n{big}  1.5 0.97\n  {big + 1} 2.5\t0.10  # far\n\n")
    (tmp_path / "M 67.txt").write_text("12 0.5\n")
    got = {(r["cluster"], r["member_id"]): r["prob"] for r in tables.membership_text(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {("NGC_3201", big): 0.97, ("NGC_3201", big + 1): 0.10, ("M 67", 12): 0.5}


def test_labels_from_parquet_names(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name in ("NGC_1_astra_matched", "M5_astra_matched"):
        pq.write_table(pa.table({"sdss_id": [1, 2], "extra": [[1.0], [2.0]]}), tmp_path / f"{name}.parquet")
    df = tables.labelled_parquet(spark, str(tmp_path / "*.parquet"), ["sdss_id"], suffix="_astra_matched.parquet")
    assert {r["cluster"] for r in df.collect()} == {"NGC_1", "M5"} and df.count() == 4


def test_missing_columns_are_listed(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match=r"lacks columns \['flux'\]"):
        tables.require_columns(df, ["id", "flux"])
    with pytest.raises(ValueError):
        tables.scalar_columns(df, "sdss_id")


def test_scan_reads_only_the_columns(spark, sf):
    df = tables.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and "l_comment" not in plan and "l_quantity" not in plan


def test_cuts_reach_the_parquet_scan(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    df = selection.range_view(li, l_quantity=(10, 20)).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThan(l_quantity,10.0)" in pushed and "LessThan(l_quantity,20.0)" in pushed
    best = selection.membership_cut(li, "l_tax", 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_tax,0.05)" in best


def test_staged_tables_can_be_cleared(spark):
    path = stage(spark.range(3)).inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    clear_staged(spark)
    assert not os.path.exists(path)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_anchors(spark, tmp_path, kind):
    df = spark.createDataFrame([(5, 10.88, 0.05, "M4")], "sdss_id long, mu double, mu_err double, group string")
    path = str(tmp_path / f"anchors.{kind}")
    df.write.csv(path, header=True) if kind == "csv" else df.write.parquet(path)
    assert [tuple(r) for r in tables.anchors(spark, path).collect()] == [(5, 10.88, 0.05, "M4")]
    bad = str(tmp_path / f"bad.{kind}")
    df.drop("mu").write.csv(bad, header=True) if kind == "csv" else df.drop("mu").write.parquet(bad)
    with pytest.raises(ValueError, match="mu"):
        tables.anchors(spark, bad)


def test_dataset_resolution():
    known = lookup("dr17")
    assert lookup("dr17", ["x"]) is known and lookup(None, known["bands"]) is known
    assert lookup("gone", ["a", "b"]) == spec("legacy", ("a", "b"))
    aux = spec("aux", ("j", "h"), replaced={"j": "vj"}, flagged=True)
    assert feature_names(aux) == ["j", "h", "survey_ind"] and feature_names(known)[-1] == "extinction"
    with pytest.raises(KeyError):
        lookup("gone")


def test_model_table_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    fitted = {f: LinearModel(rng.normal(size=4), rng.normal(size=3), np.ones(3)) for f in ("all", "A", "B")}
    path = str(tmp_path / "model")
    models.save_linear(spark, path, fitted, good=np.array([True, False]), frac_sigma=0.09, dataset=lookup("dr17"),
                       config={"lam": 1.0, "seed": 42}, masks={"apo25m": np.array([True, False])})
    back = models.load_linear(spark, path)
    for f, m in fitted.items():
        np.testing.assert_array_equal(back["models"][f].theta, m.theta)
    assert back["config"] == {"lam": 1.0, "seed": 42} and list(back["masks"]["apo25m"]) == [True, False]
    # An older table without the dataset name resolves by its bands.
    old = str(tmp_path / "old")
    spark.read.parquet(path).drop("dataset", "photometry", "config").write.parquet(old)
    again = models.load_linear(spark, old)
    assert again["dataset"]["name"] == "dr17" and again["photometry"] == list(lookup("dr17")["bands"])


def test_quarantined_rows_feed_back_in(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 1.0), (2, 11.0, None)], "id long, ra double, result double")
    ok, failed = str(tmp_path / "ok"), str(tmp_path / "failed")
    writers.write_with_quarantine(df, F.col("result") > 0, ok, failed, ["id", "ra"])
    assert [tuple(r) for r in spark.read.parquet(failed).collect()] == [(2, 11.0)]
    assert spark.read.parquet(ok).count() == 1


def test_empty_clusters_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "cluster string, id long").filter("id = 1")
    writers.write_per_cluster(df, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("cluster=*")] == ["cluster=a"]


def test_small_clusters_end_in_one_file_each(spark, tmp_path):
    rows = [(f"c{i % 60}", i) for i in range(1200)]
    df = spark.createDataFrame(rows + [("big", i) for i in range(3000)] + [(None, 1)], "cluster string, id long")
    writers.write_per_cluster(df, str(tmp_path / "out"), rows_per_task=5)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").glob("cluster=*")}
    assert files.pop("cluster=big") > 1
    assert set(files.values()) == {1} and len(files) == 60
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("cluster", "id").collect())) == sorted(
        rows + [("big", i) for i in range(3000)])


def test_ingest_resumes_and_guards_its_settings(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "state"))
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema

    def run(settings):
        jobs.ingest(spark, source, schema, target, checkpoint, lambda df: df.filter("id % 2 = 0"), settings).awaitTermination()

    run({"radius": 0.3})
    run({"radius": 0.3})
    assert spark.read.parquet(target).count() == 5
    spark.range(10, 20).write.mode("append").parquet(source)
    run({"radius": 0.3})
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(0, 20, 2))
    with pytest.raises(jobs.SettingsChanged):
        run({"radius": 0.5})


@pytest.mark.parametrize("name", ["stream_members_scored", "stream_ingest", "stream_running_counts"])
def test_streams_read_tables_of_one_file_and_of_many(spark, sf, tmp_path, name):
    from skyledger.plans.queries import QUERIES
    for t in ("embeddings", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    one, many = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert one and one == many


def test_running_counts_equal_the_batch_result_across_a_restart(spark, tmp_path):
    rows = [("a" if i % 3 else "b", [i % 2, 0, 1 if i == 5 else 0] + ([1] if i % 3 == 0 else [])) for i in range(30)] + [(None, [1])]
    df = spark.createDataFrame(rows, "telescope string, pixel_flags array<int>")
    source, state, checkpoint = (str(tmp_path / c) for c in ("in", "state", "cp"))

    def run():
        stream = jobs.file_stream(spark, source, df.schema, files_per_batch=2)
        jobs.running_pixel_counts(stream, state, checkpoint).awaitTermination()

    def as_set(d):
        return {(r["telescope"], r["pixel"], r["hits"], r["n"]) for r in d.collect()}

    df.repartition(5).write.parquet(source)
    run()
    assert as_set(jobs.latest_pixel_counts(spark, state)) == as_set(hit_counts(df))
    # A new query takes the state up where the last one left it; only telescope a has news.
    df.where("telescope = 'a'").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert as_set(jobs.latest_pixel_counts(spark, state)) == as_set(hit_counts(df.unionByName(df.where("telescope = 'a'"))))


def test_recalibration_recovers_a_known_factor(spark):
    rng = np.random.default_rng(7)
    n = 4000
    err = 0.02 + 0.02 * rng.random(n)
    sp = 1.0 + 2.5 * err * rng.normal(size=n)
    df = spark.createDataFrame([(float(s), 1.0, 0.001, float(e)) for s, e in zip(sp, err)],
                               "plx_sp double, plx double, e_plx double, err_sp double")
    got = recalibration_factor(df, [])[()]
    lo, hi = 1e-3, 100.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        chi = (sp - 1.0) / np.sqrt(0.001 ** 2 + (mid * err) ** 2)
        lo, hi = (mid, hi) if 1.48 * np.median(np.abs(chi - np.median(chi))) > 1 else (lo, mid)
    assert got == pytest.approx(lo, rel=1e-8) and 2.3 < got < 2.7


def test_interpolation_is_flat_outside_the_knots(spark):
    knots = [(1.0, 10.0), (2.0, 20.0), (4.0, 0.0)]
    values = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(interpolate("v", knots)).collect()]
    np.testing.assert_allclose(got, np.interp(values, [k[0] for k in knots], [k[1] for k in knots]))


def test_networks_come_back_as_saved(spark, tmp_path):
    from skyledger.operators.scoring import TwoHeadNet
    rng = np.random.default_rng(2)
    net = TwoHeadNet(body=[(rng.normal(size=(3, 2)), rng.normal(size=2))], head_mu=(rng.normal(size=(2, 1)), rng.normal(size=1)),
                     head_log_sigma=(rng.normal(size=(2, 1)), rng.normal(size=1)), mu=rng.normal(size=3), sd=np.ones(3), std_factor=1.5)
    path = str(tmp_path / "net")
    models.save_network(spark, path, net, dataset=lookup("dr17"), config={"beta": 0.5})
    back = models.load_network(spark, path)
    assert back["dataset"] is lookup("dr17") and back["config"] == {"beta": 0.5} and back["net"].std_factor == 1.5
    np.testing.assert_array_equal(back["net"].body[0][0], net.body[0][0])
    np.testing.assert_array_equal(back["net"].head_mu[1], net.head_mu[1])
    old = str(tmp_path / "old")
    spark.read.parquet(path).where("name <> 'dataset'").write.parquet(old)
    assert models.load_network(spark, old)["dataset"] is lookup("dr17")


def test_models_resolve_by_name_then_by_bands(spark):
    known = datasets.dataset_table(spark, [spec("one", ["g", "r"]), spec("two", ["j", "k"]), spec("zwei", ["j", "k"])])
    rows = [(1, "one", ["x"]), (2, "gone", ["j", "k"]), (3, None, ["k", "j"]), (4, "gone", None), (5, "zwei", None), (5, "zwei", None)]
    resolved = datasets.resolve(spark.createDataFrame([(*r, "one") for r in rows], "id int, name string, bands array<string>, target string"), known)
    got = sorted((r["id"], r["dataset"] or "", r["dataset_bands"]) for r in resolved.collect())
    assert got == [(1, "one", ["g", "r"]), (2, "two", ["j", "k"]), (3, "legacy", ["k", "j"]), (4, "", None),
                   (5, "zwei", ["j", "k"]), (5, "zwei", ["j", "k"])]
    refused = datasets.foreign_models(spark.createDataFrame(
        [(1, ["g", "r"], "one"), (2, ["r", "g"], "one"), (3, ["g", "r"], "none"), (4, None, "one")], "id int, bands array<string>, target string"), known)
    assert {r["id"]: r["refused"] for r in refused.collect()} == {1: False, 2: True, 3: True, 4: True}


def test_ids_are_decoded_and_prefixed_once(spark):
    raw = [b"2M001", b" 2m002 ", b"003", b"", None, "2\u039c".encode()]
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(raw)], "i int, id binary")
    got = [r[0] for r in df.orderBy("i").select(exprs.prefixed_id("id")).collect()]
    assert got == ["2M001", "2M002", "2M003", None, None, "2M2\u039c"]
    assert spark.range(5, 6).select(exprs.prefixed_id("id")).first()[0] == "2M5"


def test_column_gaps(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    got = {r["table"]: r for r in tables.column_gaps({"t": df, "none": df.limit(0)}, ["a", "b", "c"]).collect()}
    assert (got["t"]["n_rows"], got["t"]["lacks"], got["t"]["empty"]) == (1, ["c"], ["b"])
    assert (got["none"]["n_rows"], got["none"]["empty"]) == (0, ["a", "b"])


def test_files_are_numbered_over_many_partitions(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, n in enumerate([5, 1, 0, 9, 3, 30, 2, 2, 11]):
        spark.range(100 * i, 100 * i + n).coalesce(1).write.mode("append").parquet(source)
    rows = spark.read.parquet(source).select(F.col("_metadata.file_path").alias("__f"))
    starts = {r["__f"]: r["__start"] for r in writers._file_starts(rows).collect()}
    sizes = {r["__f"]: r["count"] for r in rows.groupBy("__f").count().collect()}
    at = 0
    for name in sorted(sizes):
        assert starts[name] == at
        at += sizes[name]
    writers.compact(spark, source, target, rows_per_file=7)
    back = spark.read.parquet(target)
    counts = sorted(r["count"] for r in back.groupBy(F.col("_metadata.file_path")).count().collect())
    assert counts == [63 % 7 or 7] + [7] * 8 and sorted(r[0] for r in back.collect()) == sorted(r[0] for r in spark.read.parquet(source).collect())
