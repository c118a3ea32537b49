"""End to end: CSV folders -> features -> labels -> search -> final fit -> save -> latest model -> scores."""

import glob
import tempfile
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.plans import jobs
from tripsense.sources.csv import read_csv_folder, read_experiments
from tripsense.sources.tables import lineitem_trips, trip_labels

SF = "/root/testdata/sf0.001"


def test_train_then_predict(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tripsense-job-")
    trips = lineitem_trips(spark, SF).withColumnRenamed("l_suppkey", S.KEY)
    trips.select(S.KEY, *S.RAW_CHANNELS).repartition(3).write.option("header", True).csv(f"{root}/features")
    labels = trip_labels(spark, SF).withColumnRenamed("doc_id", S.KEY)
    labels = labels.join(trips.select(S.KEY).distinct(), S.KEY)
    extra = trips.select(S.KEY).distinct().filter(F.col(S.KEY) % 2 == 0).withColumn(S.LABEL, F.lit(1))
    labels.unionByName(extra).write.option("header", True).csv(f"{root}/labels")

    telemetry = read_csv_folder(spark, f"{root}/features")
    lab = read_csv_folder(spark, f"{root}/labels", S.LABEL_SCHEMA, with_file_order=True)
    assert telemetry.count() == trips.count() and lab.filter("_block = 0").count() == lab.count()
    monkeypatch.setattr(jobs, "FEATURES", list(S.TOP_100_FEATURES[:6]))
    jobs.main(["-m", "training", "-if", f"{root}/features", "-il", f"{root}/labels", "-md", f"{root}/models",
               "--trials", "1", "--rounds", "2", "--scale_pos_weight", "2", "--families", "gbt,forest"])
    assert glob.glob(f"{root}/models/gbt/*/model") and glob.glob(f"{root}/models/forest/*/model")
    jobs.main(["-m", "predict", "-if", f"{root}/features", "-o", f"{root}/out2", "-md", f"{root}/models", "--family", "forest"])
    pred = jobs.predict(spark, telemetry, f"{root}/models", f"{root}/out")
    assert pred.count() == sum(len(pd.read_csv(f)) for f in glob.glob(f"{root}/out2/*.csv"))
    out = pd.concat(pd.read_csv(f) for f in glob.glob(f"{root}/out/*.csv"))
    assert list(out.columns) == [S.KEY, "probability"]
    assert len(out) == trips.select(S.KEY).distinct().count()
    assert out["probability"].between(0, 1).all()

    # the experiment table over the same folders: two of the eight runs, written as CSV and ranked
    monkeypatch.setattr(jobs, "ALL_FEATURES", list(S.TOP_100_FEATURES[:6]))
    monkeypatch.setattr(jobs, "EXPERIMENTS", (jobs.EXPERIMENTS[0], replace(jobs.EXPERIMENTS[4], top=2)))
    run = jobs.run_experiments
    monkeypatch.setattr(jobs, "run_experiments", lambda *a, **k: run(*a, **k, folds=2, params={"forest": {"maxDepth": 2.0}}))
    ranked = jobs.experiments(spark, telemetry, lab, f"{root}/runs", ["forest"], rounds=2).collect()
    table = read_experiments(spark, f"{root}/runs").collect()
    assert [(r["experiment_id"], r["changes"]) for r in table] == [(1, "more features"), (5, "top 50 features")]
    assert {r["experiment_id"] for r in ranked} == {1, 5} and min(r["rank"] for r in ranked) == 1
    with pytest.raises(SystemExit):
        jobs.main(["-m", "experiments", "-if", f"{root}/features", "-o", f"{root}/x"])
