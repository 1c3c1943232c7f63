"""Phrase collocations: count-min sketches first, exact counts of what survives them, then scores and subsumption.

First pass: tasks count the hashes of all n-grams of a chunk of text in a count-min sketch as wide as the corpus is long.
Only cells that a chunk touches are sent, block by block, and blocks are merged by sums. A cell never holds less than any of
its n-grams, so an n-gram one of whose cells stays below the least count is rare for certain. Second pass: n-grams all of
whose cells reached it are counted exactly, by their words. The cells that reached it travel as bitmaps of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of
from .shingles import _BASE, _BASE_INVERSE, _PLACES, mix

#: Rows of the sketch; each n-gram has one cell in each.
DEPTH = 2
#: Cells of a block, as a power of two: 16 MB where it is merged.
BLOCK_BITS = 24
#: Bits of a row's bitmap, as a power of two: 16 MB a row. Where the sketch is wider, cells share bits: more n-grams
#: survive then, and none is lost.
FILTER_BITS = 27
#: Text is read in blocks of about so many bytes; so many words make a chunk, about 100 MB of a task's memory.
READ_BYTES, CHUNK_WORDS = 1 << 20, 1_000_000
LONGEST = 4

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_CODE = np.arange(256)
_LOWER = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, _CODE).astype(np.uint8)
_BYTE = mix(_LOWER.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) | np.uint64(1)
_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        steps = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(max(n, READ_BYTES + (READ_BYTES >> 2)), base, np.uint64)
            x[0] = 1
            steps.append(np.cumprod(x))
        _UP, _DOWN = steps
    return _UP[:n], _DOWN[:n]


class Words:
    """Words of a block of bytes: where they start and end, their hashes, and numbers of their pieces."""

    def __init__(self, raw: bytes):
        code = np.frombuffer(raw, np.uint8)
        kind = _KIND[code]
        edge = np.diff(np.concatenate([[True], kind != 0, [True]]).astype(np.int8))
        self.raw = _LOWER[code].tobytes()
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(code))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(kind == 0, _BYTE[code], np.uint64(0)) * up)])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + size * np.uint64(_PLACES[7])) if len(size) else np.zeros(0, np.uint64)
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start]


def _spans(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about READ_BYTES that end between words. Each but the first starts with the last three
    words of the one before it, given as a number of words: n-grams that end in these were met already."""
    at, begin = 0, 0
    while at < len(raw):
        end = min(len(raw), at + READ_BYTES)
        while end < len(raw):
            apart = np.flatnonzero(_KIND[np.frombuffer(raw, np.uint8, min(1 << 16, len(raw) - end), end)])
            if len(apart):
                end += int(apart[0])
                break
            end = min(len(raw), end + (1 << 16))
        again = 0
        if at:
            for reach in (4096, at - begin):
                back = max(begin, at - reach)
                tail = Words(raw[back:at])
                if len(tail.start) >= LONGEST:  # the last three are whole
                    break
            again = min(LONGEST - 1, len(tail.start))
            begin = back + int(tail.start[-again]) if again else at
        yield raw[begin:end], again
        at = end


def _blocks(texts: list[bytes], langs: list[str]) -> Iterator[tuple[Words, int, np.ndarray, list[str]]]:
    """Words of blocks of whole short texts or of a part of a long one, the number of words met before, and for each
    word the place of its language in the list."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > READ_BYTES:
            for part, again in _spans(texts[at]):
                words = Words(part)
                yield words, again, np.zeros(len(words.start), np.int64), [langs[at]]
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= READ_BYTES) and len(texts[end]) <= READ_BYTES:
            size += len(texts[end]) + 1
            end += 1
        words = Words(b"\n".join(texts[at:end]))
        until = np.cumsum([len(t) + 1 for t in texts[at:end]])
        names = sorted(set(langs[at:end]))
        number = {x: k for k, x in enumerate(names)}
        place = np.array([number[x] for x in langs[at:end]], np.int64)
        yield words, 0, place[np.searchsorted(until, words.start, "right")], names
        at = end


def _salt(name: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(name.encode()))


def _ngrams(words: Words, again: int, lang: np.ndarray, names: list[str], most: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1 to `most` words, the places where n-grams start that lie in one piece and end in a new word, and their hashes."""
    salt = np.array([_salt(x) for x in names], np.uint64)[lang]
    total = salt
    n_words = len(words.hash)
    for n in range(1, most + 1):
        if n_words < n:
            return
        total = total[: n_words - n + 1] + words.hash[n - 1 :] * _PLACES[n - 1]
        start = np.flatnonzero(words.piece[: n_words - n + 1] == words.piece[n - 1 :])
        start = start[start >= again - n + 1]
        yield n, start, mix(total[start] + np.uint64(n))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of a row of the sketch, of which there are 2 ** bits."""
    return (hashes if row == 0 else mix(hashes ^ np.uint64(0x94D049BB133111EB * row & 0xFFFFFFFFFFFFFFFF))) >> np.uint64(64 - bits)


def _texts(batch) -> tuple[list[bytes], list[str]]:
    import pyarrow as pa

    return batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()


def _sliced(batches: Iterator) -> Iterator[tuple[Words, int, np.ndarray, list[str]]]:
    for batch in batches:
        at, sizes = 0, batch.column(2).to_pylist()
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= READ_BYTES):
                size += sizes[end]
                end += 1
            yield from _blocks(*_texts(batch.slice(at, end - at)))
            at = end


def _sketcher(bits: int, block_bits: int, least: int, chunk_words: int) -> Callable:
    """Sparse sketches of chunks: for each row and block the cells that the chunk touches, and their counts up to `least`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def sent(hashes: list[np.ndarray]) -> Iterator:
            found = np.sort(np.concatenate(hashes))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            count = np.minimum(np.diff(np.concatenate([first, [len(found)]])), least).astype(np.uint64)
            found = found[first]
            for row in range(DEPTH):
                # cell and count side by side, sorted together; counts of one cell are added up
                both = (_cells(found, row, bits) << np.uint64(16)) | count
                both.sort()
                cell, number = both >> np.uint64(16), both & np.uint64(0xFFFF)
                at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                cell, number = cell[at], np.minimum(np.add.reduceat(number, at), least)
                block = (cell >> np.uint64(block_bits)).astype(np.int64)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
                names = block[edge[:-1]]
                gaps, number, edge = _gaps((cell & np.uint64((1 << block_bits) - 1)).astype(np.int64), number, edge)
                for k in range(0, len(names), 256):
                    some = list(zip(edge[k : k + 256].tolist(), edge[k + 1 : k + 257].tolist(), strict=False))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int32()),
                            pa.array(names[k : k + 256], pa.int64()),
                            pa.array([gaps[x:y].tobytes() for x, y in some], pa.binary()),
                            pa.array([number[x:y].astype("u1" if least < 256 else "<u2").tobytes() for x, y in some], pa.binary()),
                        ],
                        names=["row", "block", "gaps", "counts"],
                    )

        held: dict[int, list] = {}
        words_held = 0
        for words, again, lang, names in _sliced(batches):
            for n, _, hashes in _ngrams(words, again, lang, names):
                held.setdefault(n, []).append(hashes)
            words_held += len(words.start) - again
            if words_held >= chunk_words:
                for n in list(held):
                    if sum(map(len, held[n])):
                        yield from sent(held.pop(n))
                held, words_held = {}, 0
        for n in list(held):
            if sum(map(len, held[n])):
                yield from sent(held.pop(n))

    return run


def _gaps(place: np.ndarray, number: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising places in blocks as gaps, with their numbers and the blocks' edges. Dense places take two bytes a gap; one
    that is wider is crossed by places of number 0. Sparse places take four."""
    before = np.concatenate([[-1], place[:-1]])
    before[edge[:-1]] = -1
    gap = place - before - 1
    steps = gap >> 16
    if steps.sum() > len(gap):
        return gap.astype("<u4"), number, edge
    last = np.cumsum(steps + 1)
    narrow, counts = np.full(last[-1], 65535, "<u2"), np.zeros(last[-1], number.dtype)
    narrow[last - 1], counts[last - 1] = gap & 65535, number
    return narrow, counts, np.concatenate([[0], last])[edge]


def _merged(block_bits: int, filter_bits: int, least: int) -> Callable:
    """One block of one row: its cells' sums, as a bitmap of the cells that reached `least`, folded to the filter's size."""

    def run(table):
        import pyarrow as pa

        sums = np.zeros(1 << block_bits, np.uint8 if least < 128 else np.uint32)
        kind = "u1" if least < 256 else "<u2"
        row, block = table.column("row")[0].as_py(), table.column("block")[0].as_py()
        for gaps, counts in zip(table.column("gaps"), table.column("counts"), strict=True):
            number = np.frombuffer(counts.as_buffer(), kind).astype(sums.dtype)
            gap = np.frombuffer(gaps.as_buffer(), f"<u{len(gaps.as_buffer()) // len(number)}")
            cell = np.cumsum(gap, dtype=np.int64) + np.arange(len(gap))
            sums[cell] = np.minimum(sums[cell] + number, least)
        bitmap = np.packbits(sums >= least, bitorder="little")
        folds = max(1, 1 << filter_bits - block_bits)
        return pa.table({"row": pa.array([row], pa.int32()), "part": pa.array([block % folds], pa.int64()), "bits": pa.array([bitmap.tobytes()], pa.binary())})

    return run


def _either(table):
    import pyarrow as pa

    bits = np.zeros(len(table.column("bits")[0].as_buffer()), np.uint8)
    for part in table.column("bits"):
        bits |= np.frombuffer(part.as_buffer(), np.uint8)
    return pa.table({"row": table.column("row").slice(0, 1), "part": table.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


class Survivors:
    """Which cells reached the least count, by row, folded to the filter's size."""

    def __init__(self, bits: int, filter_bits: int):
        self.bits, self.filter_bits = bits, min(bits, filter_bits)
        self.rows = np.zeros((DEPTH, max(1, (1 << self.filter_bits) >> 3)), np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        fold, kept = np.uint64((1 << self.filter_bits) - 1), np.ones(len(hashes), bool)
        for row in range(DEPTH):
            at = np.flatnonzero(kept)
            cell = (_cells(hashes[at], row, self.bits) & fold).astype(np.int64)
            kept[at] = self.rows[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1
        return kept


def _counter(shared, chunk_words: int) -> Callable:
    """Exact counts, by chunk, of the n-grams that survive, and of all words (a phrase of no words)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        survivors = shared.value
        totals: dict[str, int] = {}

        def rows(langs: list[str], sizes, phrases: list, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "words", "phrase", "f"],
            )

        def sent(held: list) -> Iterator:
            """held: for each block its text, starts and ends of words, languages and, by n, starts and hashes of survivors."""
            for n in range(1, LONGEST + 1):
                block = np.concatenate([np.full(len(found[n][0]), b, np.int32) for b, (*_, found) in enumerate(held)])
                start = np.concatenate([found[n][0] for *_, found in held])
                hashes = np.concatenate([found.pop(n)[1] for *_, found in held])
                if not len(hashes):
                    return
                order = np.argsort(hashes)
                hashes = hashes[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                count = np.diff(np.concatenate([first, [len(hashes)]]))
                block, start = block[order][first], start[order][first]
                for b, (raw, starts, ends, lang, names, _) in enumerate(held):
                    mine = np.flatnonzero(block == b)
                    if not len(mine):
                        continue
                    at = start[mine]
                    phrases = [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)]
                    if n > 1:  # words may stand further apart than by one blank
                        apart = starts[at[:, None] + np.arange(1, n)] - ends[at[:, None] + np.arange(n - 1)]
                        for k in np.flatnonzero((apart > 1).any(axis=1)).tolist():
                            phrases[k] = b" ".join(phrases[k].split())
                        if b"\t" in raw:
                            phrases = [p.replace(b"\t", b" ") for p in phrases]
                    yield rows([names[k] for k in lang[at].tolist()], np.full(len(at), n, np.int32), phrases, count[mine])

        held, words_held = [], 0
        for words, again, lang, names in _sliced(batches):
            for k, c in enumerate(np.bincount(lang[again:], minlength=len(names)).tolist()):
                totals[names[k]] = totals.get(names[k], 0) + c
            found = {n: (np.zeros(0, np.int32), np.zeros(0, np.uint64)) for n in range(1, LONGEST + 1)}
            alive = np.ones(len(words.start) + 1, bool)
            for n, start, hashes in _ngrams(words, 0, lang, names):
                if n > 1:  # a frequent n-gram's parts are frequent
                    inside = alive[start] & alive[start + 1]
                    start, hashes = start[inside], hashes[inside]
                kept = survivors.has(hashes)
                start, hashes = start[kept], hashes[kept]
                alive = np.zeros(len(words.start) + 1, bool)
                alive[start] = True
                new = start >= again - n + 1
                found[n] = start[new].astype(np.int32), hashes[new]
            held.append((words.raw, words.start.astype(np.int32), words.end.astype(np.int32), lang.astype(np.int32), names, found))
            words_held += len(words.start) - again
            if words_held >= chunk_words:
                yield from sent(held)
                held, words_held = [], 0
        if held:
            yield from sent(held)
        if totals:
            yield rows(list(totals), [0] * len(totals), [b""] * len(totals), list(totals.values()))

    return run


def count_phrases(docs: DataFrame, *, least: int = 30, block_bits: int = BLOCK_BITS, filter_bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words, phrase, f: every phrase of 1 to 4 words that occurs `least` times or more, counted exactly, and a
    language's number of words as its phrase of no words. See collocations for what a word is."""
    text = text_of(text_col)
    rows = docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.octet_length(text).cast("long").alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = max(block_bits, int(total).bit_length())
    filter_bits = max(block_bits, filter_bits)
    sketch = rows.mapInArrow(_sketcher(bits, block_bits, least, chunk_words), "row int, block long, gaps binary, counts binary")
    folded = "row int, part long, bits binary"
    blocks = sketch.groupBy("row", "block").applyInArrow(_merged(block_bits, filter_bits, least), folded)
    survivors = Survivors(bits, filter_bits)
    for r in blocks.groupBy("row", "part").applyInArrow(_either, folded).toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        survivors.rows[r["row"]][r["part"] * len(part) : (r["part"] + 1) * len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(survivors)
    found = rows.mapInArrow(_counter(shared, chunk_words), "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, percent: int = 80, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 4 words by score.

    Texts, A-Z lower-cased, are split at . , ; : ! ? and line ends into pieces and those into words at blanks and tabs. A
    phrase lies in one piece; overlapping occurrences count. a, l and r are the counts of a phrase and of its two parts at
    the cut with the lowest score floor(2000000 a / (l + r)), of equal ones the first; n counts all words of the language.
    A candidate is dropped if a longer one that contains it is at least `percent` as frequent, dropped itself or not. Ranks go
    by score, then a, then phrase in byte order, so that there are no ties. A null language is und; null and empty texts
    have no words, an empty table no rows; repeated rows count as often as they come. Very long texts are read in parts
    that overlap by three words. Inside a chunk n-grams are told apart by 64-bit hashes, beyond it by their words.
    """
    counts = materialize(count_phrases(docs, least=least, **options), "phrases")
    phrase, n = F.col("phrase"), F.col("words")
    parts = counts.where("words < 4 and words > 0").select("lang", "phrase", "f")
    cuts = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.call_function("substring_index", phrase, F.lit(" "), F.col("k")), "right": F.call_function("substring_index", phrase, F.lit(" "), F.col("k") - n)})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "cast({} as decimal(19,0))"
    score = F.expr(f"cast(2000000 as decimal(7,0)) * {wide.format('a')} div ({wide.format('l')} + {wide.format('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = counts.where("words > 2").select("lang", F.col("f").alias("longer"), F.explode(_inner(phrase, n)).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer is null or cast(100 as decimal(3,0)) * {wide.format('longer')} < cast({percent} as decimal(3,0)) * {wide.format('a')}"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "cut", rank.alias("rank")).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _inner(phrase, n):
    """The phrases of two words or more inside a phrase of three or four words."""

    def first(k):
        return F.call_function("substring_index", phrase, F.lit(" "), F.lit(k))

    def last(k):
        return F.call_function("substring_index", phrase, F.lit(" "), F.lit(-k))

    middle = F.call_function("substring_index", first(3), F.lit(" "), F.lit(-2))
    return F.when(n == 3, F.array(first(2), last(2))).otherwise(F.array(first(3), last(3), first(2), middle, last(2)))
