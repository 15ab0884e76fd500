"""Language identification with a string kernel.

Kernel: blended spectrum of presence. A text is the set of its character n-grams for n = 1, 2, 3
(lower case, everything but letters as one space), hashed to 4 096 places; the kernel of two texts
is the number of shared n-grams over the geometric mean of their sizes. Nyström: kernel values
against landmark texts, whitened by the landmarks' own kernel matrix, are the features. One ridge
regression per language (one against the rest) is fitted on them, so scoring a batch of texts is
two matrix products.

Bounds: training takes at most 20 000 labelled rows, 300 per language or fewer if there are many
languages, those with the smallest hashes; only their n-gram sets (512 bytes each) reach the
driver. 128 landmarks. Everything else runs over all rows, on whole texts.

Defined results: NULL texts and texts without a letter are ``und`` with score 0. Without any
labelled row everything is ``und``. Rows with NULL labels are not learned from but predicted like
others; repeated rows are predicted one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.llm.batches import copied, tidy
from tableprobe.llm.words import mix

PLACES = 4096
LANDMARKS = 128
PER_LABEL = 300
MAX_ROWS = 20_000
RIDGE = 1.0
SHARPNESS = 4.0
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
BATCH = 256
ROWS_AT_ONCE = 512


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(text: str | None) -> np.ndarray:
    """Which of the hashed n-grams a text has."""
    out = np.zeros(PLACES, bool)
    if text:
        clean = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
        c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        low, shift = np.uint64(PLACES - 1), np.uint64(21)
        codes = np.zeros(0, np.uint64)
        for n in range(3):
            codes = c if n == 0 else (codes[:-1] << shift) | c[n:]
            out[mix(np.unique(codes) * np.uint64(3) + np.uint64(n)) & low] = True
    return out


def bits(texts: list[str | None]) -> np.ndarray:
    """Presence of a batch as a matrix of 0.0 and 1.0."""
    return np.stack([presence(t) for t in texts]).astype(np.float32) if texts else np.zeros((0, PLACES), np.float32)


class Model:
    """Landmarks and one weight vector per language."""

    def __init__(self, labels: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.labels, self.landmarks, self.weights = labels, landmarks, weights
        self.sizes = np.sqrt(np.maximum(landmarks.sum(axis=1), 1.0))

    def kernel(self, sets: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(sets.sum(axis=1), 1.0))
        return (sets @ self.landmarks.T) / (sizes[:, None] * self.sizes[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score between 0 and 1 of every text."""
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [n for n, text in enumerate(texts) if self.labels and has_letter(text)]
        for at in range(0, len(known), BATCH):
            some = known[at : at + BATCH]
            margins = self.kernel(bits([texts[n] for n in some])).astype(np.float64) @ self.weights
            power = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
            share = power.max(axis=1) / power.sum(axis=1)
            for n, best, score in zip(some, margins.argmax(axis=1).tolist(), share.tolist()):
                labels[n], scores[n] = self.labels[best], round(score, 6)
        return labels, scores


def fit_sets(sets: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of the sets and one ridge regression per label."""
    names = sorted(set(labels.tolist()))
    if not names:
        return Model([], np.zeros((0, PLACES), np.float32), np.zeros((0, 0)))
    # The same number of landmarks per label, in the order of the rows.
    place = np.zeros(len(labels), np.int64)
    for name in names:
        mine = labels == name
        place[mine] = np.arange(mine.sum())
    chosen = np.lexsort((labels, place))[:landmarks]
    model = Model(names, sets[chosen], np.zeros((0, 0)))
    inner = model.kernel(sets[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = model.kernel(sets).astype(np.float64) @ whiten
    targets = np.where(labels[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Every label weighs the same, however many rows it has.
    weight = 1.0 / np.array([(labels == name).sum() for name in labels])
    weight *= len(labels) / weight.sum()
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    model.weights = whiten @ np.linalg.solve(gram, features.T @ (targets * weight[:, None]))
    return model


def held_out(key: Column) -> Column:
    """Rows that are never learned from: a fifth by the checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL, max_rows: int = MAX_ROWS) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    rows = df.select(
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("hash_"),
        F.col(f"`{text}`").cast("string").alias("text_"),
        F.col(f"`{label}`").cast("string").alias("label_"),
        held_out(F.col(f"`{key}`")).alias("held_"),
    ).where(~F.col("held_") & F.col("text_").isNotNull() & F.col("label_").isNotNull())
    # The last hash that is taken per label: a few rows per label and task are compared.
    place = F.row_number().over(W.partitionBy("label_").orderBy("hash_"))
    last = rows.select("label_", "hash_").withColumn("place_", place).where(F.col("place_") <= per_label)
    cuts = last.groupBy("label_").agg(F.max("hash_").alias("cut_")).limit(max_rows).collect()
    share = max(1, max_rows // max(1, len(cuts)))
    if share < per_label:
        return fit(df, key, text, label, share, max_rows)
    if not cuts:
        return fit_sets(np.zeros((0, PLACES), np.float32), np.zeros(0, object))
    table = df.sparkSession.createDataFrame([(r.label_, r.cut_) for r in cuts], "name_ string, cut_ long")
    taken = rows.join(F.broadcast(table), F.col("label_") == F.col("name_")).where(F.col("hash_") <= F.col("cut_"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in copied(batches, ROWS_AT_ONCE):
            sets = [np.packbits(presence(t.as_py())).tobytes() for t in batch.column("text_")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash_"), batch.column("label_"), pa.array(sets, pa.binary())], names=["hash_", "label_", "set_"]
            )

    taken = taken.select("hash_", "label_", "text_").mapInArrow(tidy(features), "hash_ long, label_ string, set_ binary")
    found = sorted(tuple(r) for r in taken.limit(max_rows).collect())
    packed = np.frombuffer(b"".join(bytes(s) for *_, s in found), np.uint8).reshape(len(found), PLACES // 8)
    return fit_sets(np.unpackbits(packed, axis=1).astype(np.float32), np.array([name for _, name, _ in found], object))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key_, lang_ and score_ of every row."""
    rows = df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{text}`").cast("string").alias("text_"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key_"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in copied(batches, ROWS_AT_ONCE):
            labels, scores = shared.value.predict(batch.column("text_").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key_"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["key_", "lang_", "score_"],
            )

    return rows.mapInArrow(tidy(predict), f"key_ {kind}, lang_ string, score_ double")


def keep_identified(df: DataFrame, model: Model, text: str = "text", languages: set[str] | None = None) -> DataFrame:
    """The rows whose language is known (and one of ``languages``), with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in copied(batches, ROWS_AT_ONCE):
            labels, _ = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield batch.filter(
                pa.array([name != UNDETERMINED and (languages is None or name in languages) for name in labels], pa.bool_())
            )

    return df.mapInArrow(tidy(keep), df.schema)
