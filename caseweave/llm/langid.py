"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 40
# The sample and the landmarks of all languages together; with more languages each has fewer.
SAMPLE_ROWS = 16_000
LANDMARKS = 2_000
# Languages that are learned: those with most labelled documents.
LANGUAGES = 1_000
RIDGE = 1e-3
PART_GROUPS = 64
UNKNOWN = "und"
_BATCH = 128


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letters as themselves, every other code point as a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[not chr(i).isalpha() for i in range(0x110000)]] = 32
    return table


def presence(texts: list[str]) -> np.ndarray:
    """Row by row, which hashed character n-grams of orders 1 to 3 occur in the lower-cased text."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = _letters()[np.frombuffer(b"".join(raw), "<u4")]
    lengths = np.array([len(r) // 4 for r in raw])
    base = np.repeat(np.arange(len(texts)) * BUCKETS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters from here to the text's end
    found = np.zeros(len(texts) * BUCKETS, bool)
    code = np.zeros(len(points), np.uint32)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for order in range(1, max(ORDERS) + 1):
        size = len(points) - order + 1
        if size <= 0:
            break
        code = code[:size] * np.uint32(0x01000193) + points[order - 1 :] + np.uint32(order)
        inside = left[:size] >= order
        spread = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        spread = ((spread ^ (spread >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> shift
        found[(base[:size] + spread)[inside]] = True
    return found.reshape(len(texts), BUCKETS)


@dataclass
class Model:
    """``landmarks``: presence of the n-grams ``columns`` in each landmark; ``coefficients``: landmark by language."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    coefficients: np.ndarray
    intercept: np.ndarray

    def kernel(self, found: np.ndarray) -> np.ndarray:
        """Shared n-grams with every landmark over the root of both counts, for a batch by one matrix product."""
        shared = found[:, self.columns].astype(np.float32) @ self.landmarks.T
        size = np.maximum(found.sum(1, dtype=np.int64), 1).astype(np.float32)
        return shared / np.sqrt(size)[:, None] / self.norms

    def scores(self, found: np.ndarray) -> np.ndarray:
        return self.kernel(found) @ self.coefficients + self.intercept


def fit(found: np.ndarray, languages: list[str], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """Ridge regression of +1 / -1 targets on Nyström features of the kernel."""
    if not len(found):
        return None
    names = sorted(set(languages))
    per_language = max(1, min(per_language, LANDMARKS // len(names)))
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == i)[:per_language] for i in range(len(names))])
    columns = np.flatnonzero(found[chosen].any(0))
    marks = found[chosen][:, columns].astype(np.float32)
    norms = np.sqrt(np.maximum(found[chosen].sum(1), 1)).astype(np.float32)
    model = Model(names, columns, marks, norms, np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(found[chosen]).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    features = np.hstack([model.kernel(found).astype(float) @ root, np.ones((len(found), 1))])
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = ridge * len(found) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    model.coefficients = (root @ weights[:-1]).astype(np.float32)
    model.intercept = weights[-1].astype(np.float32)
    return model


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of rows that have a letter, at most ``_BATCH`` rows and about 4 million characters at a time."""
    rows, size = [], 0
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            rows.append(i)
            size += len(text)
            if len(rows) == _BATCH or size > 4 << 20:
                yield rows, [texts[k] for k in rows]
                rows, size = [], 0
    if rows:
        yield rows, [texts[k] for k in rows]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id counts as not held out, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from a bounded sample: of every language the ``rows`` ids with the smallest hashes, one text for each.

    Many languages share ``SAMPLE_ROWS`` rows and ``LANDMARKS`` landmarks, and of more than ``LANGUAGES`` labels those with most
    documents are learned (ties: the first in code point order), so junk labels cannot fill the driver.
    The sample is chosen on distinct (doc_id, lang) alone, and of rows that repeat one the text with the least hash
    is taken, of those that have a letter; the texts become bit rows of 4 kB on the executors, so the driver gets
    ``SAMPLE_ROWS`` times 4 kB at most. Null for a table without labelled, lettered texts.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    labels = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES + 1).collect()
    if len(labels) > LANGUAGES:
        usable = usable.filter(F.col("lang").isin([r.lang for r in labels[:LANGUAGES]]))
    rows = max(1, min(rows, SAMPLE_ROWS // max(1, min(len(labels), LANGUAGES))))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    # The smallest of each group of input parts first, so that a hot language is no single task.
    chosen = usable.select("doc_id", "lang", (F.spark_partition_id() % PART_GROUPS).alias("parts")).distinct()
    chosen = chosen.withColumn("place", F.row_number().over(W.partitionBy("lang", "parts").orderBy(*order)))
    chosen = chosen.filter(F.col("place") <= rows).select("doc_id", "lang").distinct()
    chosen = chosen.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= rows)
    texts = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])
    # Partial minima come before the shuffle, so that a hot id is no single task.
    lettered = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    least = F.min(F.struct((~lettered).alias("none"), F.xxhash64("text").alias("hash"), "text"))
    texts = texts.groupBy("lang", "place").agg(least["text"].alias("text"))

    def bits(batches):
        for batch in batches:
            table = batch.to_pydict()
            for numbers, texts in _batches(table["text"]):
                packed = np.packbits(presence(texts), axis=1)
                yield pa.RecordBatch.from_pydict({
                    "lang": [table["lang"][i] for i in numbers],
                    "place": pa.array([table["place"][i] for i in numbers], pa.int32()),
                    "bits": [row.tobytes() for row in packed],
                })

    found = texts.select("lang", "place", "text").mapInArrow(bits, "lang string, place int, bits binary")
    found = sorted(found.collect(), key=lambda r: (r.lang, r.place, r.bits))
    if not found:
        return None
    matrix = np.unpackbits(np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1), axis=1)
    return fit(matrix.astype(bool), [r.lang for r in found])


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is not None:
        for numbers, part in _batches(texts):
            values = model.scores(presence(part))
            best = values.argmax(1)
            for i, b, v in zip(numbers, best, values.max(1)):
                languages[i] = model.languages[b]
                scores[i] = float(min(1.0, max(0.0, (1.0 + float(v)) / 2.0)))
    return languages, scores


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the winner's regression value from -1 to 1, rescaled) to every row.

    The model sees whole texts only. A null text, or one without a letter, is ``und`` with score 0, and so is
    every row if there is nothing to learn from. Columns of these names in the input are replaced;
    all others pass through unchanged. Repeated rows stay; an empty table stays empty.
    """
    model = model or train(docs)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = kept.index("text")

    def predict(batches):
        for batch in batches:
            languages, scores = predict_batch(model, batch.column(text_at).to_pylist())
            columns = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(predict, schema)


def score_floor(languages: int, margin: float) -> float:
    """The score that lies ``margin`` of the way from the least a winner can have to 1.

    The values of all languages sum to 2 - ``languages``, so the winner's score is never below 1 / ``languages``, and a text
    that no landmark resembles comes close to that.
    """
    floor = 1 / languages
    return floor + margin * (1 - floor)


def identified_only(docs: DataFrame, margin: float) -> DataFrame:
    """Documents in one of the learned languages with a score of at least ``score_floor``; columns as they came.

    Documents without a letter go. If there is nothing to learn from, no document can be judged and all stay, and with a
    single language its texts cannot be told from others, so all with a letter stay. Repeated rows are judged alike,
    an empty table stays empty, and extra columns of any name pass through.
    """
    model = train(docs)
    if model is None:
        return docs
    least = score_floor(len(model.languages), margin) if len(model.languages) > 1 else 0.0
    names, schema = docs.columns, docs.schema

    def keep(batches):
        for batch in batches:
            languages, scores = predict_batch(model, batch.column(names.index("text")).to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in zip(languages, scores)], pa.bool_()))

    return docs.mapInArrow(keep, schema)
