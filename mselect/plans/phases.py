"""Which phase of a run an event belongs to, per training method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event to phase, per method.
PHASES_OF_EVENTS = {
    "ctq": {
        "Between-End fit_transition clearing-End inside fit_transition": "exiting",
        "Between-End fit_transition initialization-Start fit_transition training": "initialization",
        "Between-End fit_transition model hopping-End fit_transition initialization": "initialization",
        "Between-End fit_transition training-Start fit_transition clearing": "exiting",
        "Between-End inside fit_transition-Start inside fit_transition": "data_transmission",
        "Between-End inside fit_transition-Start inside internal_keras_eval_transition": "idle",
        "Between-End inside internal_keras_eval_transition-Start inside fit_transition": "idle",
        "Between-End inside internal_keras_eval_transition-Start inside internal_keras_eval_transition": "data_transmission",
        "Between-End internal_keras_eval_transition evaluate-End inside internal_keras_eval_transition": "exiting",
        "Between-End internal_keras_eval_transition initialization-Start internal_keras_eval_transition evaluate": "initialization",
        "Between-End internal_keras_eval_transition model hopping-End internal_keras_eval_transition initialization": "initialization",
        "Between-Start fit_transition clearing-End fit_transition clearing": "exiting",
        "Between-Start fit_transition initialization-End fit_transition initialization": "initialization",
        "Between-Start fit_transition initialization-Start fit_transition model hopping": "initialization",
        "Between-Start fit_transition model hopping-End fit_transition model hopping": "model_hopping",
        "Between-Start fit_transition training-End fit_transition training": "train_valid",
        "Between-Start inside fit_transition-Start fit_transition initialization": "initialization",
        "Between-Start inside internal_keras_eval_transition-Start internal_keras_eval_transition initialization": "initialization",
        "Between-Start internal_keras_eval_transition evaluate-End internal_keras_eval_transition evaluate": "train_valid",
        "Between-Start internal_keras_eval_transition initialization-End internal_keras_eval_transition initialization": "initialization",
        "Between-Start internal_keras_eval_transition initialization-Start internal_keras_eval_transition model hopping": "initialization",
        "Between-Start internal_keras_eval_transition model hopping-End internal_keras_eval_transition model hopping": "model_hopping",
    },
    "ma": {
        "Between-End fit_transition clearing-End inside fit_transition": "exiting",
        "Between-End fit_transition initialization-Start fit_transition training": "initialization",
        "Between-End fit_transition training-Start fit_transition clearing": "exiting",
        "Between-End inside fit_transition-Start inside fit_transition": "data_transmission",
        "Between-End inside fit_transition-Start inside internal_keras_eval_transition": "merge",
        "Between-End inside internal_keras_eval_transition-Start inside fit_transition": "merge",
        "Between-End inside internal_keras_eval_transition-Start inside internal_keras_eval_transition": "data_transmission",
        "Between-End internal_keras_eval_transition evaluate-End inside internal_keras_eval_transition": "exiting",
        "Between-End internal_keras_eval_transition initialization-Start internal_keras_eval_transition evaluate": "initialization",
        "Between-Start fit_transition clearing-End fit_transition clearing": "exiting",
        "Between-Start fit_transition initialization-End fit_transition initialization": "initialization",
        "Between-Start fit_transition training-End fit_transition training": "train_valid",
        "Between-Start inside fit_transition-Start fit_transition initialization": "initialization",
        "Between-Start inside internal_keras_eval_transition-Start internal_keras_eval_transition initialization": "initialization",
        "Between-Start internal_keras_eval_transition evaluate-End internal_keras_eval_transition evaluate": "train_valid",
        "Between-Start internal_keras_eval_transition initialization-End internal_keras_eval_transition initialization": "initialization",
    },
    "udaf": {
        "Between-End fit_transition clearing-End inside fit_transition": "exiting",
        "Between-End fit_transition initialization-Start fit_transition training": "initialization",
        "Between-End fit_transition training-Start fit_transition clearing": "exiting",
        "Between-End inside fit_transition-Start inside fit_transition": "data_transmission",
        "Between-End inside fit_transition-Start inside internal_keras_eval_transition": "model_hopping",
        "Between-End inside internal_keras_eval_transition-Start inside internal_keras_eval_transition": "data_transmission",
        "Between-End internal_keras_eval_transition evaluate-End inside internal_keras_eval_transition": "exiting",
        "Between-End internal_keras_eval_transition initialization-Start internal_keras_eval_transition evaluate": "initialization",
        "Between-Start fit_transition clearing-End fit_transition clearing": "exiting",
        "Between-Start fit_transition initialization-End fit_transition initialization": "initialization",
        "Between-Start fit_transition training-End fit_transition training": "train_valid",
        "Between-Start inside fit_transition-Start fit_transition initialization": "initialization",
        "Between-Start inside internal_keras_eval_transition-Start internal_keras_eval_transition initialization": "initialization",
        "Between-Start internal_keras_eval_transition evaluate-End internal_keras_eval_transition evaluate": "train_valid",
        "Between-Start internal_keras_eval_transition initialization-End internal_keras_eval_transition initialization": "initialization",
        "Between-End inside internal_keras_eval_transition-Start inside fit_transition": "idle",
    },
    "ctq_old": {
        "Between-End fit_transition clearing-End inside fit_transition": "initialization",
        "Between-End fit_transition initialization-Start fit_transition training": "initialization",
        "Between-End fit_transition training-Start fit_transition clearing": "exiting",
        "Between-End inside fit_transition-Start inside fit_transition": "data_transmission",
        "Between-End inside fit_transition-Start inside internal_keras_eval_transition": "data_transmission",
        "Between-End inside internal_keras_eval_transition-Start inside fit_transition": "idle",
        "Between-End inside internal_keras_eval_transition-Start inside internal_keras_eval_transition": "data_transmission",
        "Between-End internal_keras_eval_transition evaluate-End inside internal_keras_eval_transition": "exiting",
        "Between-End internal_keras_eval_transition initialization-Start internal_keras_eval_transition evaluate": "initialization",
        "Between-Start fit_transition clearing-End fit_transition clearing": "exiting",
        "Between-Start fit_transition initialization-End fit_transition initialization": "initialization",
        "Between-Start fit_transition training-End fit_transition training": "train_valid",
        "Between-Start inside fit_transition-Start fit_transition initialization": "initialization",
        "Between-Start inside internal_keras_eval_transition-Start internal_keras_eval_transition initialization": "initialization",
        "Between-Start internal_keras_eval_transition evaluate-End internal_keras_eval_transition evaluate": "train_valid",
        "Between-Start internal_keras_eval_transition initialization-End internal_keras_eval_transition initialization": "initialization",
    },
    "standalone": {
        "Between-PRELOAD_COMPLETED-TRAIN_LAUNCHED": "idle",
        "Between-TRAIN_COMPLETED-TRAIN_LAUNCHED": "idle",
        "Between-TRAIN_COMPLETED-VALID_LAUNCHED": "idle",
        "Between-TRAIN_LAUNCHED-TRAIN_COMPLETED": "train_valid",
        "Between-VALID_COMPLETED-VALID_LAUNCHED": "idle",
        "Between-VALID_LAUNCHED-VALID_COMPLETED": "train_valid",
        "Between-VALID_COMPLETED-TRAIN_LAUNCHED": "idle",
    },
    "ddp": {
        "Between-End MST-End exp": "exiting",
        "Between-End MST-Start MST": "exiting",
        "Between-End initilizing model-Start training-train": "initialization",
        "Between-End loading data-End training-train": "train_valid",
        "Between-End loading data-Start loading data": "initialization",
        "Between-End training-train-Start training-valid": "exiting",
        "Between-End training-valid-End MST": "exiting",
        "Between-End training-valid-Start training-train": "exiting",
        "Between-Start MST-Start initilizing model": "initialization",
        "Between-Start exp-Start MST": "initialization",
        "Between-End initilizing model-Start MST": "initialization",
        "Between-Start initilizing model-End initilizing model": "initialization",
        "Between-Start loading data-End loading data": "data_transmission",
        "Between-Start training-train-End training-train": "train_valid",
        "Between-Start training-train-Start loading data": "initialization",
        "Between-Start training-valid-End training-valid": "train_valid",
        "Between-Start exp-Start initilizing model": "initialization",
    },
}

# Which line style a method's log has.
LINE_STYLE = {"standalone": "unix", "ddp": "ddp"}


def phase_table(spark: SparkSession, method: str) -> DataFrame:
    """The (event, phase) rows of a method."""
    return spark.createDataFrame(list(PHASES_OF_EVENTS[method].items()), "event STRING, phase STRING")
