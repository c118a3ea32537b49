"""The batch job (S8): ``training``, ``predict`` and ``experiments`` modes for ``spark-submit``.

    spark-submit -m tripsense.plans.jobs -m training -if <features folder> -il <labels folder> -md <model root>
    spark-submit -m tripsense.plans.jobs -m predict  -if <features folder> -o <output> -md <model root>
    spark-submit -m tripsense.plans.jobs -m experiments -if <features folder> -il <labels folder> -o <output>
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession

from tripsense import schema as S
from tripsense.operators.labels import drop_unlabelled, join_labels, last_label
from tripsense.plans.experiments import EXPERIMENTS, ranked_experiments, run_experiments
from tripsense.plans.features import trip_features_for
from tripsense.plans.modeling import (
    SPACES,
    TRIALS,
    cross_validate,
    fit_final,
    latest_model_path,
    load_model,
    save_model,
    score,
)
from tripsense.session import ensure_checkpoint_dir, get_session
from tripsense.sources.csv import read_csv_folder, write_csv, write_predictions

FEATURES = list(S.TOP_100_FEATURES)
#: what the experiments choose from
ALL_FEATURES = list(S.feature_names())


def labelled_features(spark: SparkSession, telemetry: DataFrame, labels: DataFrame, names,
                      label_order=("_file", "_block", "_row")) -> tuple[DataFrame, int]:
    """Features and last label of every labelled trip, computed once and stored in the shared folder, and how many trips
    have no label."""
    order = [c for c in label_order if c in labels.columns]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    join_labels(trip_features_for(telemetry, names), last_label(labels, S.KEY, S.LABEL, order)).write.parquet(path)
    return drop_unlabelled(spark.read.parquet(path))


def train(spark: SparkSession, telemetry: DataFrame, labels: DataFrame, model_root: str,
          families=("gbt", "gbt2"), trials: int = TRIALS, rounds: int | None = None, scale_pos_weight: float = 1.0
          ) -> dict[str, dict]:
    """Features -> last label per trip -> (search by 5-fold AUC -> final fit -> save) for each family."""
    data, unlabelled = labelled_features(spark, telemetry, labels, FEATURES)
    out = {}
    for family in families:
        results = cross_validate(data, FEATURES, family, trials=trials, rounds=rounds, scale_pos_weight=scale_pos_weight)
        best, best_auc = max(results, key=lambda r: r[1])
        model, _ = fit_final(data, FEATURES, best, family, rounds=rounds, scale_pos_weight=scale_pos_weight)
        saved = save_model(model, f"{model_root.rstrip('/')}/{family}", best)
        out[family] = {"path": saved, "cv_auc": best_auc, "params": best, "unlabelled": unlabelled}
    return out


def predict(spark: SparkSession, telemetry: DataFrame, model_root: str, output: str | None = None,
            family: str = "gbt") -> DataFrame:
    """Features of every trip scored by the latest saved model; written as CSV when ``output``."""
    model = load_model(latest_model_path(f"{model_root.rstrip('/')}/{family}"))
    pred = score(model, trip_features_for(telemetry, FEATURES), FEATURES)
    if output:
        write_predictions(pred, output)
    return pred


def experiments(spark: SparkSession, telemetry: DataFrame, labels: DataFrame, output: str, families=("gbt", "gbt2"),
                rounds: int | None = None) -> DataFrame:
    """The table of all experiments, written as one CSV file; returns its runs by falling AUC."""
    data, _ = labelled_features(spark, telemetry, labels, ALL_FEATURES)
    table = run_experiments(data, ALL_FEATURES, EXPERIMENTS, families, rounds=rounds)
    write_csv(table, output)
    return ranked_experiments(table)


def main(argv=None):
    p = argparse.ArgumentParser()
    p.add_argument("-m", "--mode", required=True, choices=["training", "predict", "experiments"])
    p.add_argument("-if", "--input_features_folder", required=True)
    p.add_argument("-il", "--input_label_folder")
    p.add_argument("-o", "--output_path")
    p.add_argument("-md", "--model_root", default="models")
    p.add_argument("--trials", type=int, default=TRIALS)
    p.add_argument("--rounds", type=int, help="boosting rounds or trees (default: 1000 and 500)")
    p.add_argument("--scale_pos_weight", type=float, default=1.0)
    p.add_argument("--families", default="gbt,gbt2", help="the models that are trained (gbt, gbt2, forest)")
    p.add_argument("--family", default="gbt", choices=sorted(SPACES), help="the model that predicts")
    args = p.parse_args(argv)
    spark = get_session("tripsense-job")
    telemetry = read_csv_folder(spark, args.input_features_folder)
    if args.mode != "predict" and not args.input_label_folder:
        raise SystemExit(f"{args.mode} needs --input_label_folder")
    if args.mode != "training" and not args.output_path:
        raise SystemExit(f"{args.mode} needs --output_path")
    if args.mode == "predict":
        predict(spark, telemetry, args.model_root, args.output_path, args.family)
        return
    labels = read_csv_folder(spark, args.input_label_folder, S.LABEL_SCHEMA, with_file_order=True)
    if args.mode == "experiments":
        experiments(spark, telemetry, labels, args.output_path, args.families.split(","), args.rounds).show(100, truncate=False)
    else:
        print(train(spark, telemetry, labels, args.model_root, families=args.families.split(","), trials=args.trials, rounds=args.rounds,
                    scale_pos_weight=args.scale_pos_weight))


if __name__ == "__main__":
    main()
