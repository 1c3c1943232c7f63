"""Fill-in-middle: a document's middle moves to its end, so that a model learns to write what stands between.

Every text becomes a UTF-32 array of code points. Comparing the classes of neighbouring code points gives the
places where one unit ends and the next begins; the drawn ranks index into these, and the pieces are slices of the
array, encoded again. Draws come from a digest of the document's id, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts that are taken apart at once.
BATCH_BYTES = 1 << 22


def _line_ends(points: np.ndarray) -> np.ndarray:
    """Starts of lines but the first: a line feed closes its line, whatever follows."""
    feed = points == 10
    return np.flatnonzero(feed[:-1]) + 1


def _word_starts(points: np.ndarray) -> np.ndarray:
    """Starts of words but the first: where white space (blank, \\t to \\r) meets something else."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    return np.flatnonzero(space[:-1] & ~space[1:]) + 1


def _every_point(points: np.ndarray) -> np.ndarray:
    return np.arange(1, len(points))


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _line_ends, "word": _word_starts, "character": _every_point}


def boundaries(text: str, unit: str = "line") -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and its n + 1 unit boundaries, 0 and the end among them; an empty text has the one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return points, np.zeros(1, np.int64)
    return points, np.concatenate([[0], UNITS[unit](points), [len(points)]])


def _moved(unit: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def of(points: np.ndarray) -> str:
            return points.tobytes().decode("utf-32-le", "surrogatepass")

        for batch in batches:
            sizes, at = batch.column(1).to_pylist(), 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                columns: tuple[list, ...] = ([], [], [], [], [])
                texts, one, two, forms = (batch.column(c).slice(at, end - at).to_pylist() for c in (2, 3, 4, 5))
                for text, a, b, form in zip(texts, one, two, forms, strict=True):
                    points, cuts = boundaries(text, unit)
                    n = len(cuts) - 1
                    if form == "plain":
                        row = n, "plain", None, None, text
                    else:
                        first, last = (int(cuts[k]) for k in sorted((a % (n + 1), b % (n + 1))))
                        prefix, middle, suffix = of(points[:first]), of(points[first:last]), of(points[last:])
                        text = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                        row = n, form, first, last - first, text
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                at = end

    return run


def fill_in_middle(docs: DataFrame, *, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of docs, in one narrow pass.

    Of 100 documents about `rate` are taken apart, about `spm` of 100 of those with the suffix first. Draws are the first
    four groups of 8 hexadecimal digits of the sha256 of `seed:id`. A text that is empty or null or holds one of the
    three markers stays plain, with null counts. Repeated rows are moved alike, as the id alone decides; a null id counts
    as an empty one. Very long texts are taken whole; an empty table gives an empty result; other columns are not read.
    """
    text = text_of(text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (draw[2] % 100 >= rate), "plain").when(draw[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).alias("bytes"), text.alias("text"), draw[0].alias("one"), draw[1].alias("two"), form.alias("form"))
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in (("n", long), ("form", string), ("prefix_chars", long), ("middle_chars", long), ("output", string))]])
    return rows.mapInArrow(_moved(unit), schema)


def restored(output: Column, form: Column) -> Column:
    """The original text, from an output and its form alone. A marker occurs once in an output that is not plain: texts
    that hold one stay plain, and none can arise where a marker meets a text."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substr(F.substring_index(head, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substr(F.substring_index(head, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
