"""Secret scans over all versions of all files, each content scanned once.

A text is addressed by its SHA-256.  The ledger holds what was found in each blob by each
version of the rules.  A scan takes the blobs of all given versions, drops those that the
ledger has for these rules, scans the rest and adds them; findings are then joined back
to every path and version that holds the blob.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import scratch_dir

FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Parts that the rows of one blob are dealt to in the last join.
PARTS = 16
LEDGER = f"blob string, rule_version string, found {FOUND}"

# The base rules.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so the shorter ones need no match
BASE = ("assign", "access", "hex")

_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_END = re.compile(r"(?=(-----END [A-Z ]*PRIVATE KEY-----))")
_RUN = re.compile(r"[A-Za-z0-9_-]++")


def _pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """A header of a private key, with all up to the next footer if there is one."""
    ends = [m.span(1) for m in _END.finditer(text)]
    starts, free = [s for s, _ in ends], 0
    for m in _BEGIN.finditer(text):
        if m.start() >= free:
            i = bisect_left(starts, m.end())
            free = ends[i][1] if i < len(ends) else m.end()
            yield m.start(), free


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{16,}`: three runs with
    a dot between them."""
    at = text.find("eyJ")
    while at >= 0:
        one = _RUN.match(text, at)
        two = _RUN.match(text, one.end() + 1) if text[one.end():one.end() + 4] == ".eyJ" else None
        three = _RUN.match(text, two.end() + 1) if two and text[two.end():two.end() + 1] == "." else None
        if three and min(len(one[0]), len(two[0])) >= 11 and len(three[0]) >= 16:
            yield at, three.end()
            at = text.find("eyJ", three.end())
        else:
            at = text.find("eyJ", one.end())  # what follows this run is the same from every place in it


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind: the base rules, then PEM keys
    and web tokens."""
    found = []
    low = text.lower()  # may differ in length; only asked what it holds
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", *span) for span in _pem_keys(text)]
    if "eyJ" in text:
        found += [("jwt", *span) for span in _web_tokens(text)]
    kinds = [*BASE, "pem", "jwt"]
    return sorted(found, key=lambda f: (f[1], kinds.index(f[0])))


class Rules(NamedTuple):
    """A version name, to be changed with the rules, and the function that applies them."""
    version: str = "1"
    find: object = find_secrets


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(versions: DataFrame, ledger: DataFrame, rules: Rules) -> DataFrame:
    """New ledger rows: the blobs of ``versions`` (text) that ``ledger`` lacks for these rules."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    known = ledger.filter(F.col("rule_version") == rules.version).select("blob")
    unseen = blobs.dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    find, version = rules.find, rules.version

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch["text"]]
            yield pd.DataFrame({"blob": batch["blob"], "rule_version": version, "found": found})

    return unseen.mapInPandas(scan, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; a missing one is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, rules: Rules = Rules()) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the whole ledger.

    Spark commits an append whole or not at all; a run that fails is simply run again.
    """
    spark = versions.sparkSession
    scan_blobs(versions, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules: Rules = Rules()) -> DataFrame:
    """(path, version, blob, found) for every row of ``versions`` (path, version, text).

    Null texts count as empty.  Repeated rows and null paths keep their rows.  Without a
    ``ledger_path`` the ledger is a new one in the shared folder.  An empty table gives
    no rows; other columns are not read.  Ledger rows that two runs wrote at the same
    time count once.
    """
    path = ledger_path or scratch_dir(versions.sparkSession)
    ledger = update_ledger(versions, path, rules).filter(F.col("rule_version") == rules.version)
    keyed = versions.select("path", "version", blob_id(F.col("text")).alias("blob"))
    # most blobs hold nothing; one that does is repeated for each of the parts that its rows are dealt to
    found = ledger.filter(F.size("found") > 0).groupBy("blob").agg(F.first("found").alias("found")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("path", "version"), F.lit(PARTS)).cast("int"))
    none = F.array().cast(FOUND)
    return dealt.join(found, ["blob", "part"], "left").select("path", "version", "blob", F.coalesce("found", none).alias("found"))
