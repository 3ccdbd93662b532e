"""A quality classifier learned from preference pairs: Bradley-Terry scores, cut at a score quantile.

A document's worth is linear in features of its whole text. Of a pair with one document marked good and one
marked bad, the good one is preferred with the logistic of the difference of their worths; the weights
maximise that likelihood over the pairs. The cut is the quantile of the learned worths at the share of bad
documents, and the reported score is a logistic that takes the value ``cut`` there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import hashing
from pageloom.session import stage

# so many labelled documents of a kind are paired with each other; of more, groups of about as many
LABELLED = 5_000
GROUP_RARE = 50
PAIRS_EACH = 8
RIDGE = 1e-3
CUT = 0.3

_CLASSES = 36
_BYTE_CLASS = np.zeros(256, dtype=np.int64)
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_BYTE_CLASS[_PUNCTUATION] = np.arange(len(_PUNCTUATION)) % 32
for _place, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c")):
    _BYTE_CLASS[list(_bytes)] = 32 + _place
_BYTE_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 35
_BYTE_CLASS[128:] = 35
_BYTE_CLASS[[b for b in range(32) if b not in b" \t\n\r\x0b\x0c"] + [127]] = 33
FEATURES = _CLASSES + 5


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers per text, from all of it: shares of kinds of characters, word lengths and repetition."""
    data, bounds = hashing.bytes_of(texts)
    word, begins = hashing.words(texts)
    kinds = _BYTE_CLASS[data]
    out = np.zeros((len(texts), FEATURES))
    for row, (low, high, a, b) in enumerate(zip(bounds[:-1], bounds[1:], begins[:-1], begins[1:], strict=True)):
        size, count = int(high - low), int(b - a)
        if not size:
            continue
        shares = np.bincount(kinds[low:high], minlength=_CLASSES) / size
        ink = size * (1 - shares[34])
        own = np.sort(word[a:b])
        heads = np.flatnonzero(np.concatenate([[count > 0], own[1:] != own[:-1]]))
        repeats = np.diff(np.append(heads, count))
        out[row, :_CLASSES] = np.sqrt(shares)
        out[row, _CLASSES:] = (
            np.log1p(size) / 10,
            ink / max(1, count) / 10,
            len(repeats) / max(1, count),
            repeats.max() / count if count else 0,
            np.log1p(count) / 10,
        )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cut: float  # the worth at which the score is CUT

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1, the higher the likelier good."""
        if not self.weights.any():
            return np.full(len(rows), 0.5)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights - self.cut + np.log(CUT / (1 - CUT)), -500, 500)))


def _wins(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Feature differences of pairs of a good and a bad row, every row in ``PAIRS_EACH`` or more."""
    draws = np.random.Generator(np.random.PCG64(11))
    count = PAIRS_EACH * max(len(good), len(bad))
    return good[np.arange(count) % len(good)] - bad[draws.permutation(count) % len(bad)]


def _sums(wins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope and curve of the likelihood over pairs, as one row of numbers."""
    chance = 1 / (1 + np.exp(-np.clip(wins @ weights, -30, 30)))
    curve = (wins * (chance * (1 - chance))[:, None]).T @ wins
    return np.concatenate([wins.T @ (1 - chance), curve.ravel()])


def _climb(sums: Callable[[np.ndarray], np.ndarray], count: int) -> np.ndarray:
    """The weights of the greatest likelihood, by the sums over all ``count`` pairs at given weights."""
    weights = np.zeros(FEATURES)
    for _ in range(30):
        told = sums(weights)
        slope = RIDGE * weights - told[:FEATURES] / count
        curve = told[FEATURES:].reshape(FEATURES, FEATURES) / count + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float) -> Model:
    """Bradley-Terry weights from pairs of a good and a bad row; all zero where one kind is missing."""
    if not len(good) or not len(bad):
        return Model(np.zeros(FEATURES), 0.0)
    wins = _wins(good, bad)
    weights = _climb(lambda w: _sums(wins, w), len(wins))
    worths = np.concatenate([good @ weights, bad @ weights])
    shares = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(worths)
    below = min(max(int(np.searchsorted(np.cumsum(shares[order]), bad_share - 1e-9)), 0), len(order) - 2)
    return Model(weights, float(worths[order[below : below + 2]].mean()))


def _matrix(flat: bytes) -> np.ndarray:
    return np.frombuffer(flat).reshape(-1, FEATURES)


def _grouped(rows: DataFrame, counts: list[int], most: int) -> DataFrame:
    """(good, bad): the features of all rows (id, quality, features) in groups of about ``most`` of the commoner kind, as bytes.

    Rows of the rarer kind go to so many groups that each has some ``GROUP_RARE``, or all there are.
    """
    groups = -(-max(counts) // most)
    rare = int(counts[1] < counts[0])
    copies = min(groups, max(1, -(-GROUP_RARE * groups // counts[rare])))
    spread = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == rare, copies - 1).otherwise(0)))
    placed = rows.withColumn("_copy", spread).withColumn("_group", F.pmod(F.xxhash64("id") + F.col("_copy"), F.lit(groups)))

    def packed(group):
        import pandas as pd

        group = group.sort_values("id")
        kinds = [np.array(group.features[group.quality == q].tolist()).reshape(-1, FEATURES).tobytes() for q in (1, 0)]
        return pd.DataFrame([kinds], columns=["good", "bad"])

    return placed.groupBy("_group").applyInPandas(packed, "good BINARY, bad BINARY")


def _cut(worths: DataFrame, counts: list[int], bad_share: float) -> float:
    """The value of the worths (quality, worth) below which the share of bad documents lies."""
    tallied = worths.groupBy("worth").agg(*(F.count_if(F.col("quality") == q).alias(f"n{q}") for q in (0, 1)))
    parts = stage(tallied.repartitionByRange("worth").withColumn("part", F.spark_partition_id()), "worths")

    def passed(table, before):
        return (before[0] + table.n0.cumsum()) * bad_share / counts[0] + (before[1] + table.n1.cumsum()) * (1 - bad_share) / counts[1]

    whole = parts.groupBy("part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("part").toPandas()
    place = min(int(np.searchsorted(passed(whole, (0, 0)), bad_share - 1e-9)), len(whole) - 1)
    before = whole[:place][["n0", "n1"]].sum().tolist()
    table = parts.filter(F.col("part") == int(whole.part[place])).orderBy("worth").toPandas()  # one of the range's parts
    row = min(int(np.searchsorted(passed(table, before), bad_share - 1e-9)), len(table) - 1)
    worth = float(table.worth[row])
    following = parts.filter(F.col("worth") > worth).agg(F.min("worth")).scalar()
    ends = worths.sparkSession.range(1).select(following.alias("after"), parts.filter(F.col("worth") < worth).agg(F.max("worth")).scalar().alias("before")).first()
    other = ends.after if ends.after is not None else ends.before
    return worth if other is None else (worth + other) / 2


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = LABELLED) -> Model:
    """Learn from all ``labels`` (id, quality 1 or 0); other labels are left out.

    With more than ``most`` documents of a kind they are dealt into groups by their id, pairs are drawn in each group and the likelihood is
    summed over all groups. A repeated label counts once, contradicting ones both count; labels without a document and documents
    without a label play no part.
    """
    marked = labels.filter("quality IN (0, 1)").select(F.col(id_column).alias("id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter("id IS NOT NULL").distinct()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    labelled = {row.quality: row["count"] for row in marked.groupBy("quality").count().collect()}
    bad_share = labelled.get(0, 0) / max(1, sum(labelled.values()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "features"])

    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])
    # numbers and not texts are joined; one row of them per label, whatever the number of rows with its id
    found = texts.filter("id IS NOT NULL").mapInArrow(measured, schema).join(marked, "id")
    rows = stage(found.groupBy("id", "quality").agg(F.min("features").alias("features")), "labelled")
    sizes = {row.quality: row["count"] for row in rows.groupBy("quality").count().collect()}
    counts = [sizes.get(q, 0) for q in (0, 1)]
    if max(counts) <= most:
        told = rows.orderBy("id", "quality").collect()  # bounded by the parameter
        bad, good = (np.array([row.features for row in told if row.quality == q]).reshape(-1, FEATURES) for q in (0, 1))
        return fit_pairs(good, bad, bad_share)
    if not min(counts):
        return Model(np.zeros(FEATURES), 0.0)
    groups = stage(_grouped(rows, counts, most), "groups")

    def summed(weights: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + FEATURES + FEATURES**2)
            for batch in batches:
                for good, bad in zip(batch.column(0), batch.column(1), strict=True):
                    good, bad = _matrix(good.as_py()), _matrix(bad.as_py())
                    if len(good) and len(bad):
                        wins = _wins(good, bad)
                        total += np.concatenate([[len(wins)], _sums(wins, weights)])
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        # a row of fixed length per task, added up in the order of their values, so that a run is like the next
        return np.sum(sorted(row.sums for row in groups.mapInArrow(work, "sums ARRAY<DOUBLE>").collect()), axis=0)

    weights = _climb(lambda w: summed(w)[1:], int(summed(np.zeros(FEATURES))[0]))
    worth = F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights.tolist())), lambda x, w: x * w), F.lit(0.0), lambda x, y: x + y)
    return Model(weights, _cut(rows.select("quality", worth.alias("worth")), counts, bad_share))


def score_quality(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score of each row's whole text (a null text counts as empty).

    Every row keeps its place, repeated ones too. An existing column with the added name is replaced, other
    columns may have any names. An empty table gives no rows. Without labels of both kinds all scores are 0.5.
    """
    model_text = F.col(text_column).cast("string")

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(features(pa.array(texts, pa.large_string(), from_pandas=True))))

    return docs.withColumn(name, scored(model_text))
