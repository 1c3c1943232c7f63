"""Quality classifier by compression.

Two zstandard dictionaries, one from text labelled good and one from text labelled bad, compress every text in
chunks; how much smaller the one result is than the other, normalised, becomes a calibrated score. Chunks are
compressed alone, so a long text is scored by the dictionaries and not by its own repetitions, and memory does
not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The fit reads at most this many labelled rows of each class, each of at most FIT_BYTES bytes: half of them
#: train the dictionaries, half the calibration. All labelled rows count for the share of each class.
FIT_ROWS, FIT_BYTES = 4000, 1 << 16
DICT_BYTES, CHUNK, LEVEL = 32 << 10, 500, 3


def features(sizes: np.ndarray) -> np.ndarray:
    """From columns (size with the bad dictionary, with the good one, bytes): the normalised differences, the
    compression rate, and their interplay with length."""
    bad, good, n = sizes.T.astype(float)
    by_bytes, by_size = (bad - good) / (n + 21), (bad - good) / (bad + good + 20)
    rate, log_n = (bad + good) / (2 * n + 42), np.log1p(n)
    return np.stack([np.ones(len(n)), by_bytes, by_size, rate, rate * rate, log_n, by_size * log_n, np.minimum(rate, 0.2)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class QualityModel:
    """dictionaries is (bad, good), None where a class had no rows: every score is then `share`."""

    dictionaries: tuple[bytes, bytes] | None
    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    chunk: int = CHUNK
    level: int = LEVEL

    def sizes(self, texts) -> np.ndarray:
        import zstandard

        coders = []
        for data in self.dictionaries:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=self.level)
            coders.append(zstandard.ZstdCompressor(dict_data=known, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        out = np.zeros((len(texts), 3), np.int64)
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            parts = [raw[at : at + self.chunk] for at in range(0, len(raw), self.chunk)] or [b""]
            out[i] = sum(len(coders[0].compress(p)) for p in parts), sum(len(coders[1].compress(p)) for p in parts), len(raw)
        return out

    def scores(self, texts) -> np.ndarray:
        if self.dictionaries is None or not len(texts):
            return np.full(len(texts), self.share)
        x = (features(self.sizes(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _dictionary(texts: list[str], size: int, chunk: int, level: int) -> bytes:
    import zstandard

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    samples = [r[at : at + chunk] for r in raw for at in range(0, len(r), chunk)]
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:  # too little text to train from: the text itself is the dictionary
        return b"".join(samples)[-size:] or b" " * 8


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, dict_bytes: int = DICT_BYTES, chunk: int = CHUNK, level: int = LEVEL) -> QualityModel:
    """Fit on labelled rows outside the held-out fold (crc32 of the id as text, modulo folds, is 0).

    The rows are those with the smallest md5 of the id, so a rerun picks the same ones; of an id's labels that differ
    the smaller counts, of its texts the first. Null labels and ids, labels without a document, null texts and texts
    over fit_bytes are left out. Without both classes the model is constant.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).withColumn("key", key).orderBy("key").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= fit_bytes))
    rows = sorted(tuple(r) for r in texts.join(F.broadcast(chosen), "doc_id").groupBy("key", "label").agg(F.min("text")).toLocalIterator())
    split: dict[tuple[int, int], list[str]] = {(label, half): [] for label in (0, 1) for half in (0, 1)}
    seen = [0, 0]
    for _, label, text in rows:
        split[label, seen[label] % 2].append(text)
        seen[label] += 1
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if not all(split.values()):
        return QualityModel(None, share)
    model = QualityModel(tuple(_dictionary(split[label, 0], dict_bytes, chunk, level) for label in (0, 1)), share, chunk=chunk, level=level)
    held = split[0, 1] + split[1, 1]
    y = np.repeat([0.0, 1.0], [len(split[0, 1]), len(split[1, 1])])
    weight = np.where(y == 1, share / len(split[1, 1]), (1 - share) / len(split[0, 1])) * len(y)
    x = features(model.sizes(held))
    model.mean, model.scale = x.mean(0), x.std(0)
    model.mean[0], model.scale[model.scale == 0] = 0, 1
    model.weights = _logistic((x - model.mean) / model.scale, y, weight)
    return model


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def score_column(model: QualityModel, text: Column) -> Column:
    """The score, 0 to 1, of a text column; null counts as empty."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [model.scores(texts.slice(at, 256).to_pylist()) for at in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(text)


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs in one narrow pass; only the text is scored.

    Null and empty texts get the score of an empty text, repeated rows equal scores; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), score_column(model, text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
