import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from cadenza.operators import curves as K
from cadenza.operators import seasons
from cadenza.operators.estimators import EfficiencyEstimator, EfficiencyModel
from cadenza.sources import raw
from cadenza.streaming import totals

BANDS = seasons.BANDS


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    held = spark.range(300).select(i.alias("activity_id"), F.date_add(F.lit("2022-11-01").cast("date"), (i % 90).cast("int")).alias("date"), (i % 37 * 100.0).alias("distance_m"), (i % 11 * 3.0).alias("elevation_gain_m"), F.when(i % 4 != 0, 1.0 + i % 9 / 10.0).alias("power_to_hr"))
    return held.withColumns({b: F.when(F.col("activity_id") % 13 != 0, (F.col("activity_id") * (k + 2) % 50).cast("double")) for k, b in enumerate(BANDS)})


def told(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def same(spark, rows, folder):
    days = totals.totals(spark, folder)
    for kind in ("week", "month"):
        assert told(seasons.average_gradient(days, kind)) == told(seasons.average_gradient(rows, kind))
        assert told(seasons.gradient_map(days, kind)) == told(seasons.gradient_map(rows, kind))
        assert told(totals.power_to_hr(days, kind)) == told(seasons.power_to_hr_bins(rows, kind))
    assert told(seasons.season_gradient(days)) == told(seasons.season_gradient(rows))
    ends = seasons.annual_cumulative(rows, "distance_m").filter("ord > 0").groupBy("year", "x").agg(F.max("y").alias("y"), F.first("total").alias("total"))
    assert told(totals.annual_days(days, "distance_m")) == told(ends)


@pytest.mark.parametrize("batches", [1, 4])
def test_any_cut_into_batches_gives_the_whole(spark, rows, tmp_path, batches):
    folder = f"file://{tmp_path}/days"
    for b in range(batches):
        totals.merge_batch(folder, rows.filter(F.pmod(F.xxhash64("activity_id"), F.lit(batches)) == b), b)
        if b:
            totals.merge_batch(folder, rows.filter(F.pmod(F.xxhash64("activity_id"), F.lit(batches)) == b), b)  # replayed after a failure
    same(spark, rows, folder)
    assert len(totals.versions(folder)) <= totals.KEPT and totals.totals(spark, folder).agg(F.sum("n")).first()[0] == 300


def test_a_draft_of_a_state_does_not_count(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/days"
    totals.merge_batch(folder, rows, 0)
    (tmp_path / "days" / "batch-1").mkdir()
    assert totals.versions(folder) == [0]
    same(spark, rows, folder)
    with pytest.raises(FileNotFoundError):
        totals.totals(spark, f"file://{tmp_path}/none")


def test_stopped_stream_goes_on_where_it_was(spark, rows, tmp_path):
    folder, state = f"file://{tmp_path}/days", f"{tmp_path}/state"
    for part in (0, 1):
        rows.filter(F.col("activity_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        totals.keep_totals(stream, folder, state).awaitTermination()
    same(spark, rows, folder)


def test_undated_empty_and_null_summaries(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/days"
    totals.merge_batch(folder, rows.limit(0), 0)
    assert totals.totals(spark, folder).count() == 0
    odd = rows.limit(3).withColumns({"date": F.lit(None).cast("date"), "distance_m": F.lit(None).cast("double")})
    totals.merge_batch(folder, rows.unionByName(odd), 1)
    days = totals.totals(spark, folder)
    assert days.filter("date is null").select("n", "distance_m").first()[:] == (3, None)
    assert told(totals.annual_days(days, "distance_m")) == told(totals.annual_days(totals.day_partials(rows), "distance_m"))


@pytest.fixture(scope="module")
def split_rows(spark):
    return spark.range(600).select((F.col("id") % 3).alias("activity_id"), F.col("id").alias("split_id"), (8.0 + F.col("id") % 5).alias("speed"), (F.col("id") * 7 % 400 - 200.0).alias("elevation_gain"), (130.0 + F.col("id") % 30).alias("heartrate"))


def test_estimator_predicts_as_the_functions_do_and_survives_saving(spark, split_rows, tmp_path):
    model = EfficiencyEstimator(perBucket=40, minFlat=5, predictionCol="level").fit(split_rows)
    wanted = K.predict_nearest(split_rows, K.equi_depth_curve(K.with_efficiency(split_rows, least_flat=5), 40))
    columns = ["activity_id", "split_id"]
    assert told(model.transform(split_rows).select(*columns, "level")) == told(wanted.select(*columns, "gap"))
    model.write().overwrite().save(f"{tmp_path}/model")
    again = EfficiencyModel.load(f"{tmp_path}/model")
    assert again.uid == model.uid and again.getOrDefault("perBucket") == 40 and again.getPredictionCol() == "level"
    assert told(again.transform(split_rows).select(*columns, "level")) == told(wanted.select(*columns, "gap"))
    assert told(again.curve()) == told(model.curve())
    with pytest.raises(ValueError, match="level"):
        model.transform(split_rows.withColumn("level", F.lit(0.0)))


def test_estimator_in_a_pipeline_and_cross_validation(spark, split_rows, tmp_path):
    stage = EfficiencyEstimator(minFlat=5)
    pipeline = Pipeline(stages=[stage])
    pipeline.write().overwrite().save(f"{tmp_path}/pipeline")
    fitted = Pipeline.load(f"{tmp_path}/pipeline").fit(split_rows)
    fitted.write().overwrite().save(f"{tmp_path}/fitted")
    assert PipelineModel.load(f"{tmp_path}/fitted").transform(split_rows).count() == 600
    grid = ParamGridBuilder().addGrid(stage.perBucket, [20, 200]).build()
    judge = RegressionEvaluator(predictionCol="gap", labelCol="speed", metricName="rmse")
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(split_rows)
    assert len(found.avgMetrics) == 2 and all(m > 0 for m in found.avgMetrics)
    assert found.bestModel.stages[0].getOrDefault("perBucket") in (20, 200)


def test_nothing_to_learn(spark, split_rows):
    for nothing in (split_rows.limit(0), split_rows.withColumn("heartrate", F.lit(None).cast("double"))):
        with pytest.raises(K.NothingToLearn):
            EfficiencyEstimator().fit(nothing)


def test_payloads_are_decoded_or_told_why_not(spark):
    good = '{"time":{"data":[0,1]},"distance":{"data":[0,2.5]},"altitude":{"data":[1,null]},"heartrate":{"data":[100,101]},"cadence":{"data":[1]}}'
    texts = {
        1: good,
        2: good.replace(',"heartrate":{"data":[100,101]}', ""),
        3: good.replace("[100,101]", "[100]"),
        4: good.replace('"altitude"', '"height"'),
        5: good[:-1],
        6: None,
        7: "",
        8: "[]",
        9: good.replace("[0,1]", '"soon"'),
        10: good.replace("[100,101]", "7"),
        11: '{"time":{"data":[]},"distance":{"data":[]},"altitude":{"data":[]}}',
    }
    df = spark.createDataFrame(list(texts.items()), "activity_id long, payload string")
    errors = {r["activity_id"]: r["error"] for r in raw.payload_errors(df).collect()}
    assert errors == {3: "uneven", 4: "no altitude", 5: "not JSON", 6: "not JSON", 7: "not JSON", 8: "no time", 9: "no time", 10: "no heartrate"}
    rows = sorted(tuple(r) for r in raw.decode_payloads(df).collect())
    assert rows == [(1, 0, 0, 0.0, 1.0, 100.0), (1, 1, 1, 2.5, None, 101.0), (2, 0, 0, 0.0, 1.0, None), (2, 1, 1, 2.5, None, None)]
    assert raw.decode_payloads(df.limit(0)).count() == raw.payload_errors(df.limit(0)).count() == 0
