"""Adapter ids from adapter paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name shown for requests that use no adapter.
BASE_MODEL = "Base Model"


def path_parts(path: Column) -> Column:
    """The components of a path, without empty and '.' ones."""
    return F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))


def last_component(path: Column) -> Column:
    """Last component of the normalised path; '..' takes back the one before it."""
    # Only a path that ends in '..', or has no other component, needs the walk.
    plain = F.substring_index(F.regexp_replace(path, r"(/\.?)+$", ""), "/", -1)
    return F.when(plain.isin("", ".", ".."), _walked_component(path)).otherwise(plain)


def _walked_component(path: Column) -> Column:
    step = F.aggregate(
        F.reverse(path_parts(path)),
        F.struct(F.lit(0).alias("skip"), F.lit(None).cast("string").alias("name")),
        lambda acc, part: F.when(acc["name"].isNotNull(), acc)
        .when(part == "..", F.struct((acc["skip"] + 1).alias("skip"), acc["name"].alias("name")))
        .when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["name"].alias("name")))
        .otherwise(F.struct(acc["skip"].alias("skip"), part.alias("name"))),
    )
    return (
        F.when(step["name"].isNotNull(), step["name"])
        .when(path.startswith("/"), F.lit(""))
        .when(step["skip"] > 0, F.lit(".."))
        .otherwise(F.lit("."))
    )


def adapter_id(path: Column) -> Column:
    """Adapter id of a request's adapter path; no path means the base model."""
    return F.when(path.isNull() | (path == ""), F.lit(BASE_MODEL)).otherwise(last_component(path))
