"""Adapter stores on disk: configurations and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions.paths import path_parts
from runledger.operators.adapters import CONFIG_FILE
from runledger.sources.listing import list_files
from runledger.sources.reports import plain_path

# Fixed value: the task of adapters that do not name one.
DEFAULT_TASK = "CAUSAL_LM"


def scan_adapter_configs(spark: SparkSession, root: str, name_glob: str = CONFIG_FILE) -> DataFrame:
    """One row per adapter configuration below ``root``; ``malformed`` marks bad files.

    The adapter is named by the folder of its file.
    """
    configs = (
        spark.read.schema(f"{schemas.ADAPTER_CONFIG}, _corrupt_record string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_glob)
        .json(root)
    )
    file = plain_path(F.col("_metadata.file_path"))
    return configs.select(
        F.try_element_at(path_parts(file), F.lit(-2)).alias("adapter_id"),
        "r", "lora_alpha", "lora_dropout", "target_modules", "bias",
        F.coalesce("task_type", F.lit(DEFAULT_TASK)).alias("task_type"),
        F.col("base_model_name_or_path").alias("base_model"),
        F.col("_corrupt_record").isNotNull().alias("malformed"),
    )


def list_adapter_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below ``root``, empty ones too; contents are not read."""
    return list_files(spark, root)
