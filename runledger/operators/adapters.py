"""Audit of an adapter store from its file listing.

Layout: config and weights in ``<base>/<id>/<id>/``, optimizer state in ``<base>/<id>/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.paths import BASE_MODEL, path_parts
from runledger.operators.requests import requests_by_adapter

# File names of the store.
CONFIG_FILE = "adapter_config.json"
WEIGHT_FILES = ("adapter_model.bin", "adapter_model.safetensors")
OPTIMIZER_FILE = "optimizer.pt"


def adapter_completeness(files: DataFrame) -> DataFrame:
    """What each stored adapter has, and so what it can be used for.

    servable: config and weights.  resumable: these and the optimizer state.
    first_run: no config, so a training job would start it afresh.
    """
    parts = path_parts(F.col("path"))
    named = files.select(
        F.try_element_at(parts, F.lit(-1)).alias("name"),
        F.try_element_at(parts, F.lit(-2)).alias("adapter_id"),
        F.try_element_at(parts, F.lit(-3)).alias("parent"),
    ).filter(F.col("adapter_id").isNotNull())
    inner = F.coalesce(F.col("adapter_id") == F.col("parent"), F.lit(False))
    found = named.groupBy("adapter_id").agg(
        F.bool_or(inner & (F.col("name") == CONFIG_FILE)).alias("has_config"),
        F.bool_or(inner & F.col("name").isin(*WEIGHT_FILES)).alias("has_weights"),
        F.bool_or(~inner & (F.col("name") == OPTIMIZER_FILE)).alias("has_optimizer"),
    )
    servable = F.col("has_config") & F.col("has_weights")
    return found.withColumns({
        "servable": servable,
        "resumable": servable & F.col("has_optimizer"),
        "first_run": ~F.col("has_config"),
    })


def adapter_demand(catalogue: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored adapters against requested ones: which are unservable, which unused."""
    asked = (
        requests_by_adapter(requests).filter(F.col("adapter_id") != BASE_MODEL)
        .groupBy("adapter_id").agg(F.sum("requests").alias("requests"))
    )
    both = catalogue.select("adapter_id", "servable").join(asked, "adapter_id", "full")
    servable = F.coalesce("servable", F.lit(False))
    return both.select(
        "adapter_id",
        F.coalesce("requests", F.lit(0)).alias("requests"),
        F.col("servable").isNotNull().alias("stored"),
        (F.col("requests").isNotNull() & ~servable).alias("requested_unservable"),
        F.col("requests").isNull().alias("stored_unused"),
    )


def orphan_adapters(catalogue: DataFrame, keep: DataFrame) -> DataFrame:
    """Stored adapters that no row of ``keep`` (adapter_id) names."""
    return catalogue.select("adapter_id").join(keep.select("adapter_id"), "adapter_id", "left_anti")
