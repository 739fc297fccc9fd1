"""Loading, sinks, maintenance, retrieval and models on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import normal_tokens
from sparkloom.functions.validate import errors, number_error
from sparkloom.operators import crud, metrics, models, search, similarity
from sparkloom.operators.tfidf import norms, tfidf
from sparkloom.sources import sinks, tables
from sparkloom.streaming.running import running_counts

POWER = T.StructType([T.StructField("Date", T.StringType()), T.StructField("Voltage", T.DoubleType())])


def test_csv_with_marks_and_spaces(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿Date ; Voltage\n1/1/2020;220.5\n2/1/2020;?\n".encode())
    got = tables.load_csv(spark, str(path), POWER, ["Date"], sep=";", null="?")
    assert [tuple(r) for r in got.collect()] == [("1/1/2020", 220.5), ("2/1/2020", None)]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(tables.MissingFileError):
        tables.load_csv(spark, str(tmp_path / "no.csv"), POWER)
    (tmp_path / "b.csv").write_text("Date\n1\n")
    with pytest.raises(tables.SchemaError):
        tables.load_csv(spark, str(tmp_path / "b.csv"), POWER)
    (tmp_path / "c.csv").write_text("Date,Voltage\n1,abc\n")
    with pytest.raises(tables.LoadError):
        tables.load_csv(spark, str(tmp_path / "c.csv"), POWER)
    (tmp_path / "d.csv").write_text("Date,Voltage\n")
    with pytest.raises(tables.SchemaError):
        tables.load_csv(spark, str(tmp_path / "d.csv"), POWER)


def test_encodings_are_told_apart(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes("Date,Voltage\ncaf\u00e9,1\n".encode("latin-1"))
    got = tables.load_csv(spark, str(path), POWER, encodings=("UTF-8", "ISO-8859-1")).first()
    assert got["Date"] == "caf\u00e9"
    with pytest.raises(tables.MalformedFileError):
        tables.load_csv(spark, str(path), POWER)
    path.write_bytes("Date,Voltage\ncaf\u00e9,1\n".encode())
    assert tables.load_csv(spark, str(path), POWER, encodings=("UTF-8", "ISO-8859-1")).first()["Date"] == "caf\u00e9"


def test_a_bad_cell_far_down(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("Date,Voltage\n" + "1,1.5\n" * 50 + "1,abc\n")
    with pytest.raises(tables.MalformedFileError):
        tables.load_csv(spark, str(path), POWER)
    assert tables.load_csv(spark, str(path), POWER, check=False).columns == ["Date", "Voltage"]


def test_checked_writes_leave_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_checked(spark.range(5), path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_checked(bad, path)
    assert spark.read.parquet(path).count() == 5
    assert sinks.write_checked(spark.range(7), path) == 7 and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sinks.write_checked(spark.read.parquet(path).filter("id > 1"), path) == 5  # reads what it replaces


def test_backups_both_sinks_and_history(spark, tmp_path):
    assert sinks.backup(spark, str(tmp_path / "none"), str(tmp_path / "b"), "1") == []
    spark.range(3).write.parquet(str(tmp_path / "t"))
    for v in range(7):
        kept = sinks.backup(spark, str(tmp_path / "t"), str(tmp_path / "b"), str(v), 3)
    assert kept == ["version=4", "version=5", "version=6"]
    sinks.write_both(spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>"), str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x.csv")).first()["t"] == "a,b"
    assert spark.read.json(str(tmp_path / "x.json")).first()["t"] == ["a", "b"]
    sinks.append_history(spark.range(20).withColumnRenamed("id", "ts"), str(tmp_path / "h"))
    assert sinks.cap_history(spark, str(tmp_path / "h"), ["ts"], 4) == 4
    assert sorted(r["ts"] for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [16, 17, 18, 19]
    sinks.clear_history(spark, str(tmp_path / "h"))
    assert not (tmp_path / "h").exists()


def test_fingerprints_of_raw_bytes(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 9000
    (tmp_path / "raw").write_bytes(data)
    got = tables.fingerprint(spark, str(tmp_path / "raw")).first()
    assert (got["length"], got["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())


@pytest.mark.parametrize("k", [0, -1, True, 2.0, "3", None])
def test_k_has_to_be_a_whole_number(spark, k):
    rows = spark.createDataFrame([(1, 2, 0.5)], "q int, i int, score double")
    with pytest.raises(ValueError):
        similarity.top_k(rows, "q", "i", k)


def test_dense_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, 1.0]) for i in range(40)], "id int, v array<double>")
    asked = rows.filter("id % 3 = 0")
    one = similarity.dense_top_k(rows, "id", "v", asked, 4).collect()
    many = similarity.dense_top_k(rows, "id", "v", asked, 4, block=5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 14 * 4


def test_saved_features_weigh_other_documents(spark, tmp_path):
    from sparkloom.operators import tfidf as T_

    docs = spark.createDataFrame([(1, "red fish"), (2, "red boat"), (3, "blue fish boat")], "id int, t string")
    tokens = normal_tokens(F.col("t"))
    known = T_.vocabulary(docs, "id", tokens, (1,))
    T_.save(known, T_.weighted(docs, "id", tokens, known, (1,)), str(tmp_path / "f"))
    again, triples = T_.load(spark, str(tmp_path / "f"))
    assert {tuple(r) for r in triples.collect()} == {tuple(r) for r in tfidf(docs, "id", tokens, (1,)).collect()}
    other = spark.createDataFrame([(9, "red red unseen")], "id int, t string")
    assert [(r["term"], r["weight"]) for r in T_.weighted(other, "id", tokens, again, (1,)).collect()] == [("red", 1.0)]


def test_text_models_learn_and_are_chosen(spark):
    import random

    from sparkloom.operators.metrics import multiclass_metrics, stratified_fold

    rng = random.Random(1)
    words = {"sea": ["wave", "boat", "fish", "salt"], "sky": ["wind", "bird", "cloud", "sun"]}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(6)), k) for i in range(60) for k in [rng.choice(["sea", "sky"])]]
    rows = spark.createDataFrame(data, "id int, t string, k string")
    train, test = models.hash_split(rows, F.col("id"), 0.3)
    grid = {n: c for n, c in models.text_grid().items() if n in ("naive_bayes n=2 smoothing=1", "logistic n=1 reg=0.01")}
    chosen = models.select_text_model(stratified_fold(train, "k", "id", 2), "t", "k", grid)
    assert [r["f1_macro"] for r in chosen.collect()] == sorted((r["f1_macro"] for r in chosen.collect()), reverse=True)
    name, model = models.refit_best(train, "t", "k", chosen, grid)
    assert name in grid
    assert multiclass_metrics(models.text_scored(model, test), "k", "said").first()["accuracy"] == 1.0


def test_margins_become_probabilities(spark):
    import random

    rng = random.Random(2)
    data = [(i, rng.gauss(2.0 * (i % 2), 1.0), i % 2) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, x double, y int")
    scored = models.probabilities(models.calibrated(rows, ["x"], "y"), rows).collect()
    assert all(0 <= r["probability"] <= 1 for r in scored)
    by_margin = sorted(scored, key=lambda r: r["margin"])
    assert [r["probability"] for r in by_margin] == sorted(r["probability"] for r in scored)
    high = [r["y"] for r in scored if r["probability"] > 0.8]
    assert len(high) > 20 and sum(high) / len(high) > 0.75


def test_missing_table(spark, tmp_path):
    with pytest.raises(tables.MissingFileError):
        tables.load(spark, str(tmp_path), "orders")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["t"] == "a,b"
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["t"] == ["a", "b"]
    assert sinks.write_checked(df, str(tmp_path / "p")) == 1
    for v in "abcdefg":
        kept = sinks.write_version(df, str(tmp_path / "v"), v)
    assert len(kept) == 5 and kept[-1] == "version=g"
    for i in range(3):
        sinks.append_history(spark.createDataFrame([(i,)], "ts int"), str(tmp_path / "h"))
    assert [r["ts"] for r in sinks.read_history(spark, str(tmp_path / "h"), ["ts"], 2).collect()] == [2, 1]
    assert tables.fingerprint(spark, str(tmp_path / "csv")).filter("length > 0").count() >= 1


def test_maintenance(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([("c",)], "name string")
    assert {tuple(r) for r in crud.append_with_id(df, new, "id").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert crud.next_id(df.limit(0), "id").first()[0] == 1
    changed = crud.update_by_id(df, "id", 2, {"name": F.lit("z"), "nothing": F.lit(1)})
    assert [tuple(r) for r in crud.changes(df, changed, "id").collect()] == [(2, "name", "b", "z")]
    rows = spark.createDataFrame([(2, " A "), (3, "n")], "id long, name string")
    assert {tuple(r) for r in crud.upsert(df, rows, "id", "name").collect()} == {(1, "a"), (2, "b"), (3, "n")}


def test_search_skips_unknown_fields(spark):
    df = spark.createDataFrame([("Alice", "NYC"), ("Bob", "LA")], "Name string, City string")
    assert search.matching_all(df, {"Name": " ali ", "Age": "3"}).count() == 1
    assert search.matching(df, "City", "la", exact=True).first()["Name"] == "Bob"


def test_tfidf_and_similarity(spark):
    docs = spark.createDataFrame(
        [(1, "action sci-fi thriller"), (2, "animation children comedy"), (3, "adventure sci-fi"), (4, "crime drama"),
         (5, "crime drama"), (6, "adventure drama")], "id int, t string",
    )
    triples = tfidf(docs, "id", normal_tokens(F.col("t"))).cache()
    assert norms(triples, "id").filter("not is_unit").count() == 0
    best = similarity.similar_items(triples, "id", [4], 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in best][0] == (5, 1.0)
    assert similarity.similar_items(triples, "id", [2], 3).count() == 0  # no term of it is kept
    fill = similarity.similar_items(triples, "id", [4], 5).orderBy("rank").collect()
    assert fill[-1]["score"] == 0.0 and len({r["id"] for r in fill}) == len(fill)


def test_metrics_of_undefined_ratios(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "b")], "y string, p string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in metrics.class_report(rows, "y", "p").collect()}
    assert got == {"a": (1, 0.0, 0.0), "b": (1, 0.5, 1.0)}


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(rows, F.col("y"), F.col("s")).first()["auc"] == 0.875


def test_model_survives_saving(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(20)], "id int, x double, y double")
    model = models.fit(rows, ["x"], "y", models.regressors()["linear"])
    again = models.reloaded(model, str(tmp_path / "m"))
    assert models.same_predictions(model.transform(rows), again.transform(rows), "id").first()["largest"] == 0
    got = {r["feature"]: r["coefficient"] for r in models.coefficients(model, ["x"], spark).collect()}
    assert got["x"] == pytest.approx(2.0) and got["(intercept)"] == pytest.approx(1.0)


def test_running_counts(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, "a", 1.0), (i, "b", 3.0)], "id int, kind string, value double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, kind string, value double").parquet(str(tmp_path / "in"))
    job = running_counts(stream, "kind", "value").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    job.processAllAvailable()
    job.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2, 1.0), ("b", 2, 3.0)}


def test_insert_refuses_what_is_wrong(spark):
    df = spark.createDataFrame([("aaaaaaaa", "50")], "Record_ID string, Attendance string")
    rows = spark.createDataFrame([("40",), ("140",)], "Attendance string")
    found, refused = crud.insert_validated(df, rows, "Record_ID", errors(number_error(F.col("Attendance"), "Attendance", 0, 100)))
    assert sorted(r["Attendance"] for r in found.collect()) == ["40", "50"]
    assert [r["errors"] for r in refused.collect()] == [["Attendance: above 100"]]
    assert all(len(r["Record_ID"]) == 8 for r in found.collect())


def test_text_and_refresh(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    sinks.write_text(df, str(tmp_path / "t"), F.format_string("%d: %s", "id", "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1: a"
    df.write.parquet(str(tmp_path / "p"))
    assert sinks.refreshed(spark, str(tmp_path / "p")).count() == 1
