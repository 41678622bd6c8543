"""What several operators share.

Python runs over the rows of a column in small pieces, so that a worker's memory stays small:
Arrow batches hold thousands of rows; only ``rows`` of them at a time become Python objects.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Rows = Callable[..., Sequence[Sequence]]


def map_rows(df: DataFrame, make: Rows, schema: str, rows: int = 256) -> DataFrame:
    """``make(*columns)`` gets lists of up to ``rows`` values for each column of ``df`` and
    returns a list for each column of ``schema``."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    fields = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, fields)], schema=fields)

    return df.mapInArrow(run, schema)


def map_text(make: Callable[[list], Sequence[Sequence]], schema: str, column: str | Column, rows: int = 256) -> Column:
    """A column of ``schema`` from a text column; ``make`` as in map_rows.  A single field
    gives its values, several a struct.

    To Spark it isn't deterministic: a filter by a column that is also returned would else run
    it twice, in two Python workers for each task."""
    kind = _parse_datatype_string(schema)
    fields = to_arrow_schema(kind)
    single = len(fields) == 1

    @F.arrow_udf(kind[0].dataType if single else kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [[pa.array(v, f.type) for v, f in zip(make(batch.slice(at, rows).to_pylist()), fields)]
                     for at in range(0, len(batch), rows)]
            columns = [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], f.type) for i, f in enumerate(fields)]
            yield columns[0] if single else pa.StructArray.from_arrays(columns, fields=list(fields))

    return run.asNondeterministic()(column)


def once(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a Python worker for each key.  Code that is
    shipped by value has no module of its own to keep it in."""
    name = "_runledger_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """``wanted``, with underscores until no column of ``taken`` has that name in any case."""
    known = {name.lower() for name in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


#: Keys with more than one in so many rows are joined apart; there can't be more of them.
MOST_HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``keyed``: one row for each key, with the number ``n`` of its rows among
    ``total``, that does not stay.

    Keys with more than their share of all rows, ``MOST_HOT`` at most, are sent to all tasks, so
    that none gets more than that share of rows with one key.  They are looked up by the first
    column of ``key``, a bigint, which Spark keeps in a small table.
    """
    first, rest = key[0], key[1:]
    often = F.broadcast(keyed.filter(F.col("n") > total / MOST_HOT).select(first).distinct())
    usual = rows.join(often, first, "left_anti").join(keyed, key)
    hot = F.broadcast(keyed.join(often, first, "left_semi").withColumnsRenamed({c: f"__{c}" for c in rest}))
    met = rows.join(hot, first)
    for c in rest:
        met = met.filter(F.col(c) == F.col(f"__{c}"))
    return met.drop(*[f"__{c}" for c in rest]).unionByName(usual).drop("n")
