"""Token counts: Arrow batches go through the tokenizer library and only lengths come back.

Batches are balanced by bytes inside each task, and a long text is cut at places where the tokenizer's
result cannot change, so that memory stays bounded whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 14


def _plain(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def cut_points(text: str, every: int = SPLIT_CHARS) -> list[str]:
    """Pieces of about `every` characters. A cut replaces one blank that stands between two ASCII letters or
    digits: the tokenizer puts its word mark in front of each piece, just where the blank's mark was, and no
    vocabulary entry spans a word mark. Where no such blank follows, the piece simply runs on."""
    pieces, at = [], 0
    while len(text) - at > every:
        cut = text.find(" ", at + every)
        while cut != -1 and not (cut + 1 < len(text) and _plain(text[cut - 1]) and _plain(text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        pieces.append(text[at:cut])
        at = cut + 1
    pieces.append(text[at:])
    return pieces


_LOADED: dict = {}


def _load(path: str):
    """The tokenizer, and whether its vocabulary allows cuts; kept for the life of a Python worker."""
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        safe = all(mark not in sp.id_to_piece(i).lstrip(mark) for i in range(sp.get_piece_size()))
        safe = safe and sp.encode("ab cd") == sp.encode("ab") + sp.encode("cd")
        _LOADED[path] = sp, safe
    return _LOADED[path]


def _counter(path: str, batch_bytes: int, split_chars: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sp, safe = _load(path)

        def lengths(texts: list[str]) -> list[int]:
            pieces: list[str] = []
            owner: list[int] = []
            for i, text in enumerate(texts):
                for piece in cut_points(text, split_chars) if safe else [text]:
                    pieces.append(piece)
                    owner.append(i)
            counts = [0] * len(texts)
            at = 0
            while at < len(pieces):  # a single long text is encoded in several calls
                end, size = at, 0
                while end < len(pieces) and (end == at or size < batch_bytes):
                    size += len(pieces[end])
                    end += 1
                for i, ids in zip(owner[at:end], sp.encode(pieces[at:end], num_threads=1), strict=True):
                    counts[i] += len(ids)
                at = end
            return counts

        for batch in batches:
            sizes = batch.column(1).to_pylist()
            texts = batch.column(2)
            counts: list[int] = []
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= batch_bytes):
                    size += sizes[end]
                    end += 1
                counts += lengths(texts.slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = BATCH_BYTES, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, one narrow pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are counted row by row; other
    columns are not read. The whole text counts: cutting a long one changes no token.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counter(model_path, batch_bytes, split_chars), schema).withColumn("over_limit", F.col("n_tokens") > limit)
