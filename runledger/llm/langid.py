"""Language ID with string kernels.

Two texts are compared by the n-grams of 1 to 4 bytes that both hold, whatever their
counts: k(x, y) = |x and y| / sqrt(|x| |y|), over n-grams hashed to ``BUCKETS`` numbers.
A bounded sample of labelled texts trains kernel ridge regression, one output for each
language against the rest, in the space that some landmark texts span (Nystroem).  The
normal equations are summed over tasks.  As the kernel is linear in the n-grams, the
landmarks and their coefficients fold into one matrix, and a batch of texts is scored
by one product with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.batches import map_rows, map_text
from runledger.session import write_scratch

BUCKETS = 1 << 16
_LENGTHS = (1, 2, 3, 4)
_OTHER = re.compile(r"[\W\d_]+")

UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Grams:
    """N-grams of a text as sorted bucket numbers."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, bool)

    def __call__(self, text: str, piece: int = 1 << 20) -> np.ndarray:
        raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), np.uint8)
        for at in range(0, len(raw), piece):  # bounded memory for very long texts
            part = raw[at:at + piece + _LENGTHS[-1] - 1].astype(np.uint32)
            code = part
            for n in _LENGTHS:
                if n > 1:
                    code = (code[:-1] << np.uint32(8)) | part[n - 1:]
                mixed = (code + np.uint32(n * 0x9E3779)) * np.uint32(2654435761)
                self.seen[mixed >> np.uint32(16)] = True
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


class Model(NamedTuple):
    """``weights`` (buckets x labels): a text's outputs are the sums over its n-grams,
    divided by the root of their number.  ``known`` (labels x buckets / 8, bits): the
    n-grams of each label's texts; ``bars``: the share of them that a text needs."""
    labels: list[str]
    weights: np.ndarray
    known: np.ndarray
    bars: np.ndarray

    def shares(self, label: int, texts: list[np.ndarray]) -> list[float]:
        """The share of each text's n-grams that the label's texts hold."""
        known = np.unpackbits(self.known[label]).view(bool)
        return [float(known[g].mean()) if len(g) else 0.0 for g in texts]

    def outputs(self, texts: list[np.ndarray], batch: int = 32) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(texts), batch):
            part = texts[at:at + batch]
            present = np.zeros((len(part), BUCKETS), np.float32)
            for row, grams in zip(present, part):
                row[grams] = 1
            size = np.sqrt([max(1, len(g)) for g in part])
            out[at:at + batch] = (present @ self.weights) / size[:, None]
        return out


def _kernel(texts: list[np.ndarray], landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kernel values of texts with landmarks (buckets x landmarks, 0 or 1)."""
    shared = np.array([landmarks[g].sum(0, dtype=np.int64) for g in texts], np.float64).reshape(len(texts), len(sizes))
    own = np.sqrt([max(1, len(g)) for g in texts])
    return shared / own[:, None] / np.sqrt(sizes)[None, :]


def _bars(known: np.ndarray, least: np.ndarray, marks: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
    """For each label the share halfway between its own texts and those of other labels.

    ``least`` is what nearly all of the label's texts reach, each held out from the
    n-grams it is measured with.  The other end is the median of the other labels, each
    with the median of its landmarks; for a single label the share that chance gives.
    """
    bars = np.zeros(len(known))
    for i, bits in enumerate(known):
        own = np.unpackbits(bits).view(bool)
        shares = np.array([own[g].mean() if len(g) else 0.0 for g in marks])
        others = [np.median(shares[owner == j]) for j in range(len(known)) if j != i and (owner == j).any()]
        bars[i] = least[i] - max(0.0, least[i] - max(own.mean(), np.median(others) if others else 0.0)) / 2
    return bars


def train(
    labelled: DataFrame,
    label: str = "lang",
    text: str = "text",
    per_label: int = 600,
    landmarks_per_label: int = 64,
    most_landmarks: int = 4096,
    ridge: float = 0.1,
) -> Model:
    """Fit a model on ``per_label`` distinct texts of each label, or all of fewer.

    The texts are those with the smallest hashes; copies count once.  Null labels and texts
    without a letter are left out.  All labels are learned.  Landmarks are what the driver and
    every task hold: ``most_landmarks`` in total, spread evenly over the labels, at least
    one and at most ``landmarks_per_label`` for each; more labels than that are an error.  No
    rows give a model that knows no language.
    """
    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).filter(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # a task hands on per_label hashes of a label at most
    smallest = Window.partitionBy("label").orderBy("hash")
    chosen = write_scratch(hashed.select("label", "hash").distinct().withColumn("no", F.row_number().over(smallest)).filter(
        F.col("no") <= per_label))
    labels = sorted(r.label for r in chosen.select("label").distinct().limit(most_landmarks + 1).collect())
    if len(labels) > most_landmarks:
        raise ValueError(f"more than {most_landmarks} labels; raise most_landmarks")
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, BUCKETS // 8), np.uint8), np.zeros(0))
    landmarks_per_label = min(landmarks_per_label, most_landmarks // len(labels))

    def grams(names: list, hashes: list, texts: list) -> list:
        get = Grams()
        return [names, hashes, [get(t).tobytes() for t in texts]]

    sample = write_scratch(map_rows(
        # at most per_label rows for each of most_landmarks labels
        hashed.join(F.broadcast(chosen.select("label", "hash")), ["label", "hash"], "left_semi")
        .dropDuplicates(["label", "hash"]).select("label", "hash", "text"), grams,
        "label string, hash bigint, grams binary"))
    spark = sample.sparkSession
    wanted = chosen.filter(F.col("no") <= landmarks_per_label).select("label", "hash")  # most_landmarks at most
    landmarks = sample.join(wanted, ["label", "hash"]).orderBy("label", "hash").collect()
    marks = [np.frombuffer(r.grams, np.int32) for r in landmarks]
    table = np.zeros((BUCKETS, len(marks)), np.uint8)
    for i, g in enumerate(marks):
        table[g, i] = 1
    sizes = np.array([max(1, len(g)) for g in marks], np.float64)
    spot = {name: i for i, name in enumerate(labels)}

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, c = len(sizes), len(spot)
        left, right = np.zeros((m, m)), np.zeros((m, c))
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at:at + 64]
                k = _kernel([np.frombuffer(g, np.int32) for g in part["grams"]], shared.value, sizes)
                y = np.full((len(part), c), -1.0)
                y[np.arange(len(part)), [spot[x] for x in part["label"]]] = 1
                left += k.T @ k
                right += k.T @ y
        yield pd.DataFrame({"a": [left.tobytes()], "b": [right.tobytes()]})

    def vocabulary(texts: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.int32) for g in texts["grams"]]
        times = np.zeros(BUCKETS, np.int32)
        for g in grams:
            times[g] += 1
        least = 1 + len(grams) // 200  # a few wrong labels teach nothing
        without = times > least  # still known without the text itself
        shares = [float(without[g].mean()) if len(g) else 0.0 for g in grams]
        return pd.DataFrame({"label": [texts["label"].iloc[0]], "known": [np.packbits(times >= least).tobytes()],
                             "least": [float(np.quantile(shares, 0.01))]})

    shared = spark.sparkContext.broadcast(table)  # most_landmarks times 64 kB at most
    sums = sample.repartition(spark.sparkContext.defaultParallelism).mapInPandas(equations, "a binary, b binary").collect()
    m, c = len(marks), len(labels)
    left = sum(np.frombuffer(r.a).reshape(m, m) for r in sums)
    right = sum(np.frombuffer(r.b).reshape(m, c) for r in sums)
    among = _kernel(marks, table, sizes)
    beta = np.linalg.solve(left + ridge * among + 1e-6 * len(marks) * np.eye(m), right)
    scaled = (beta / np.sqrt(sizes)[:, None]).astype(np.float32)
    weights = np.concatenate([part.astype(np.float32) @ scaled for part in np.array_split(table, 64)])
    taught = {r.label: r for r in sample.groupBy("label").applyInPandas(  # 8 kB for each label
        vocabulary, "label string, known binary, least double").collect()}
    known = np.stack([np.frombuffer(taught[x].known, np.uint8) for x in labels])
    owner = np.array([spot[r.label] for r in landmarks])
    return Model(labels, weights, known, _bars(known, np.array([taught[x].least for x in labels]), marks, owner))


def classify(model: Model, texts: DataFrame, column: Column) -> Column:
    """A struct (lang, score, taught) for a text column of ``texts``.

    ``und`` with score 0 if the text is null or has no letter, or the model knows no
    language.  The score maps the best output from [-1, 1] to [0, 1].  It only compares the
    languages; ``taught`` tells whether the text is in the best one at all: the share of its
    n-grams that this language's texts hold reaches the language's bar, less one over the
    root of their number.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # 64 kB x 4 for each label

    def best(batch: list) -> list:
        get, known = Grams(), shared.value
        lang, score, taught = [UNKNOWN] * len(batch), [0.0] * len(batch), [False] * len(batch)
        asked = [i for i, t in enumerate(batch) if has_letter(t)] if known.labels else []
        grams = [get(batch[i]) for i in asked]
        members: dict[int, list[int]] = {}
        for spot, (i, row) in enumerate(zip(asked, known.outputs(grams))):
            j = int(row.argmax())
            lang[i], score[i] = known.labels[j], min(1.0, max(0.0, (float(row[j]) + 1) / 2))
            members.setdefault(j, []).append(spot)
        for j, spots in members.items():
            for spot, share in zip(spots, known.shares(j, [grams[s] for s in spots])):
                taught[asked[spot]] = share + max(1, len(grams[spot])) ** -0.5 >= known.bars[j]
        return [lang, score, [bool(t) for t in taught]]

    return map_text(best, "lang string, score double, taught boolean", column)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Learns from documents that have an id and are not held out.  Repeated rows keep their
    rows; an empty table gives none; other columns are not read.
    """
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), **options)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        classify(model, docs, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
