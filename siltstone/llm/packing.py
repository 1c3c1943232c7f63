"""Best-fit packing by the sum-of-squares rule.

Documents become pieces of at most `capacity` tokens; only a piece's length and checksum leave the tokenizer,
never its ids. Pieces are dealt at random into groups of bounded size and every group is packed on its own:
each piece goes where the squared counts of open sequences per residual gap sum to the least.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of

CAPACITY = 2048
#: Pieces of a group, about. A group's loss is a few open sequences, whatever its size.
GROUP_ROWS = 20_000
#: Parts of words that a Python worker keeps the ids of, about 50 MB.
CACHE_WORDS = 300_000

_LOADED: dict = {}


#: Letters whose lower-casing and normalising changes neither their number nor that they are letters, and a word of
#: them alone is one piece to the tokenizer; so is a run of ASCII punctuation.
LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"


class WordIds:
    """From texts to their ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before it looks for pieces and no rule of it looks across a blank, so a
    text's ids are its words' ids one after another; and a word of letters that ends in punctuation has the ids
    of both parts. The distinct parts of a batch are found by Arrow, encoded by the library once and kept for
    the life of the Python worker; the store is emptied when it is full. As the last id alone of a word of
    letters has the end-of-word mark, many of them go through the library in one call.
    """

    def __init__(self, path: str, most_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._single(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _parts(self, parts, letters: bool) -> list[bytes]:
        """Ids of distinct parts, an Arrow array."""
        names = parts.to_pylist()
        found = list(map(self.known.get, names))
        new = [i for i, ids in enumerate(found) if ids is None]
        encode, size = (self._together, 2_000) if letters else (self._single, 10_000)
        for at in range(0, len(new), size):
            some = new[at : at + size]
            for i, ids in zip(some, encode([names[i] for i in some]), strict=True):
                found[i] = self.known[names[i]] = ids
        return found

    def __call__(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.most_words:
            self.known.clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # small ASCII letters are what the tokenizer makes of them too; special strings keep their case
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy()
        stem = pc.utf8_rtrim(words, string.punctuation)
        plain = pc.match_substring_regex(stem, f"^{LETTERS}$")
        tail = pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), pc.if_else(pc.equal(words, ""), "", words))
        stem = pc.if_else(plain, stem, "").dictionary_encode()
        tail = tail.dictionary_encode()
        ids = self._parts(stem.dictionary, True) + self._parts(tail.dictionary, False)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        # each word is a stem and a tail, either of which may be empty
        part = np.empty(2 * len(word), np.int64)
        part[0::2] = stem.indices.to_numpy()[word]
        part[1::2] = tail.indices.to_numpy()[word] + len(stem.dictionary)
        length = size[part]
        until = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(start[part] - until[:-1], length) + np.arange(until[-1])
        raw = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = (4 * until[2 * (ends - ends[0])]).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _pieces(path: str, capacity: int, end_id: int, batch_bytes: int = 1 << 21) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import os
        import zlib

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            sizes, at = batch.column(1).to_pylist(), 0
            while at < len(sizes):
                upto, size = at, 0
                while upto < len(sizes) and (upto == at or size + sizes[upto] <= batch_bytes):
                    size += sizes[upto]
                    upto += 1
                owner, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(batch.column(2).slice(at, upto - at)), at):
                    ids += end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b : b + 4 * capacity]
                        owner.append(i)
                        piece.append(k)
                        start.append(b // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at = upto
        pa.default_memory_pool().release_unused()

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece. Pieces are placed from long to short, each so that the sum
    over gaps of squared counts of open sequences becomes smallest; of equal choices the tightest fit wins."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size >= capacity:
            sequence[i], made = made, made + 1
            continue
        # gap g - size gains one and gap g loses one; a full sequence (gap 0) counts no more
        gain = 2 * count[: capacity - size] + 1
        gain[0] = 0
        change = gain - 2 * count[size:capacity] + 1
        change[count[size:capacity] == 0] = 1 << 40
        best = int(change.argmin()) if len(change) else 0
        fresh = 2 * int(count[capacity - size]) + 1
        if len(change) and change[best] <= fresh:
            gap = best + size
            bin_id = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_id, made = capacity, made, made + 1
        sequence[i], offset[i] = bin_id, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_at[gap - size].append(bin_id)
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come, and any number of them
    falls into even groups. Very long texts are cut into pieces of the capacity. An empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("bytes"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    # the written number deals equal rows to different groups, and a retried task reads the same one again
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), schema).withColumn("pack_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(pieces.count() / group_rows))
    salt = F.pmod(F.xxhash64("pack_row", F.lit("pack")), F.lit(groups))

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sequence, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (int(key[0]) << 32) + sequence
        frame["offset"] = offset
        return frame.drop(columns=["pack_group", "pack_row"])

    placed = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.withColumn("pack_group", salt).groupBy("pack_group").applyInPandas(place, placed)
