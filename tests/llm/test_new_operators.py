"""Collocations, fill-in-middle and pattern packing over awkward rows, against brute force and the libraries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import collocations, fill_middle, pattern_packing
from siltstone.llm.registry import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11
def grams(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        for n in range(1, 5):
            for i in range(len(words) - n + 1):
                yield n, " ".join(words[i : i + n])


def brute_collocations(texts, least, top, percent):
    f, total = defaultdict(Counter), Counter()
    for text, lang in texts:
        for n, phrase in grams(text):
            f[lang or "und"][phrase] += 1
            total[lang or "und"] += n == 1
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if c >= least and " " in p}
        longer = defaultdict(int)
        for p, c in found.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner = " ".join(w[i : i + size])
                    longer[inner] = max(longer[inner], c)
        rows = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            if 100 * longer[p] < percent * a:
                rows.append((-score, -a, p.encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return Counter(out)


@pytest.fixture(scope="module")
def prose(spark, rows):
    rnd = np.random.default_rng(5)
    words = "the of a new york city hall red\u00a0x \u00e9t\u00e9 don't".split(" ")
    texts = [(" ".join(words[k] for k in rnd.integers(0, len(words), 200)), "en") for _ in range(20)]
    texts += [("New  York\tCity, hall. NEW york city! hall\x0bnew york;city", x) for x in ("en", None, "und")] * 4
    texts += [(t, ("en", "fr", None)[k % 3]) for k, (_, t, _) in enumerate(rows)]
    texts += [(None, "en"), ("", None), (" . , \t", "de"), ("a b c d " * 3000, "fr"), ("x" * 5000 + " tail of it", "fr")]
    return texts


@pytest.mark.parametrize("least, options", [(3, {}), (2, {"block_bits": 6, "filter_bits": 8, "chunk_words": 40}), (300, {"block_bits": 10, "filter_bits": 4, "chunk_words": 1000})])
def test_collocations(spark, prose, least, options):
    df = spark.createDataFrame(prose, "text string, lang string").selectExpr("*", *[f"'clash' as {c}" for c in "phrase words f rank row block part cells counts score doc_id".split()])
    got = collocations.collocations(df.repartition(3), least=least, top=40, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_collocations(prose, least, 40, 80)


def test_collocations_of_empty_tables(spark, empty):
    assert collocations.collocations(empty, block_bits=10).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), block_bits=10).count() == 0


def test_long_texts_are_read_in_parts_without_loss(monkeypatch):
    """Each n-gram of a long text is met once, however the text is cut, words longer than a part among them."""
    rnd = np.random.default_rng(1)
    text = "".join(("word%d" % k if k % 9 else "y" * 300) + " \t.,\n"[c] * (1 + k % 2) for k, c in zip(rnd.integers(0, 40, 3000).tolist(), rnd.choice(5, 3000, p=[0.8, 0.05, 0.05, 0.05, 0.05]).tolist()))

    def counted(size):
        monkeypatch.setattr(collocations, "READ_BYTES", size)
        found = Counter()
        for words, again, lang, names in collocations._blocks([text.encode(), b"word1 word2"], ["en", "en"]):
            for n, _, hashes in collocations._ngrams(words, again, lang, names):
                found.update((n, h) for h in hashes.tolist())
        return found

    whole = counted(1 << 20)
    assert sum(whole.values()) == sum(1 for _ in grams(text)) + 3
    for size in (16, 100, 5000):
        assert counted(size) == whole


def test_hash_equals_words(monkeypatch):
    words = collocations.Words("The the, the\tThe of".encode())
    assert len(set(words.hash.tolist())) == 2
    assert words.piece.tolist() == [0, 0, 1, 1, 1]


def test_numbers_beyond_64_bits(spark, monkeypatch):
    big = 9 * 10**18
    counts = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 2), ("en", 2, "a b", big - 4), ("en", 3, "a b a", big // 5 * 4 - 4), ("en", 2, "b a", big // 5 * 4 - 4)]
    df = spark.createDataFrame(counts, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(collocations, "count_phrases", lambda docs, **_: df)
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.collocations(df).collect()}
    assert got == {
        "a b": (big, big - 2, 2_000_000 * (big - 4) // (2 * big - 2)),
        "a b a": min(((2_000_000 * (big // 5 * 4 - 4) // (x + y)), x, y) for x, y in ((big, big // 5 * 4 - 4), (big - 4, big)))[1:] + (2_000_000 * (big // 5 * 4 - 4) // (2 * big - 4),),
    }


# --- 12
def brute_middle(doc_id, text, unit, rate, spm):
    text = text or ""
    units = re.findall({"line": r"[^\n]*\n|[^\n]+", "character": r"(?s)."}[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


AWKWARD = [(900, "a\n\nb <P> c"), (901, "<<S\nS>\n<\nP>\nM>"), (902, "\n\n\n"), (903, "no feed"), (904, "<\n<\n>\nP>\n"), (905, "\r\nx\u2028y\n"), (906, "\U0001f600\n" * 40000), (907, "<M")]


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("line", 60, 0), ("character", 100, 100)])
def test_fill_in_middle(spark, docs, rows, empty, unit, rate, spm):
    extra = spark.createDataFrame([(i, t, "s") for i, t in AWKWARD], "doc_id long, text string, source string")
    df = docs.select("doc_id", "text", "source").unionByName(extra).withColumn("form", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = fill_middle.fill_in_middle(df, unit=unit, rate=rate, spm=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [brute_middle(i, t, unit, rate, spm) for i, t, *_ in [*rows, *AWKWARD]]
    assert Counter(tuple(r[:-1]) for r in got) == Counter(want)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t, *_ in [*rows, *AWKWARD])
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_words_as_units():
    points, cuts = fill_middle.boundaries(" two  words\n here ", "word")
    assert len(points) == 18 and cuts.tolist() == [0, 1, 6, 13, 18]
    assert fill_middle.boundaries("", "word")[1].tolist() == [0]


# --- 13
def placed(counts, capacity):
    packs, parts = defaultdict(list), defaultdict(list)
    for length, rank, number, shift, size, sequence, wide, offset in pattern_packing.plan(counts, capacity).tolist():
        for k in range(number):
            packs[sequence + k % wide].append((offset + k // wide * size, size))
            parts[length, rank + k].append((shift, size))
    return packs, parts


def test_every_plan_is_exact_and_full():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        capacity = int(rnd.choice([4, 16, 100, 2048]))
        counts = {int(n): int(c) for n, c in zip(rnd.integers(0, capacity, 20), rnd.integers(0, 40, 20))}
        packs, parts = placed(counts, capacity)
        assert set(parts) == {(n, k) for n, c in counts.items() if n for k in range(c)}
        for (n, _), p in parts.items():
            assert [a for a, _ in sorted(p)] == np.cumsum([0] + [s for _, s in sorted(p)])[:-1].tolist() and sum(s for _, s in p) == n
        for p in packs.values():
            size = sum(s for _, s in p)
            assert [a for a, _ in sorted(p)] == np.cumsum([0] + [s for _, s in sorted(p)])[:-1].tolist()
            assert size == capacity or size < capacity and size & (size - 1) == 0


def test_shortest_pack_first_cuts_few():
    """Lengths that fit whole stay whole: no more cuts than sequences."""
    lengths = np.minimum(2047, np.random.default_rng(3).lognormal(5, 1.2, 20_000).astype(int) + 1)
    packs, parts = placed(dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)])), 2048)
    assert sum(len(p) - 1 for p in parts.values()) <= len(packs)


def test_the_plan_does_not_grow_with_documents():
    counts = {n: 1 + 2048 // n for n in range(1, 2048)}
    sizes = [len(pattern_packing.plan({n: times * c for n, c in counts.items()})) for times in (1, 10**6, 10**12)]
    assert max(sizes) <= 1.5 * min(sizes)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pattern_packing(spark, docs, rows, empty, capacity):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = Counter((i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t, _ in rows)
    got = pattern_packing.pack_by_patterns(docs, path, capacity=capacity).collect()
    want, tokens = Counter(), sum(len(x) // 4 * c for (_, x), c in ids.items())
    by_id = defaultdict(set)
    for i, x in ids:
        by_id[i].add(x)
    pieces = Counter()
    for r in got:
        text = [x for x in by_id[r["doc_id"]] if len(x) == 4 * r["doc_tokens"] and zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]]
        assert len(text) == 1
        pieces.update((r["doc_id"], text[0], k) for k in range(r["start"], r["start"] + r["length"]))
    for (i, x), c in ids.items():
        want.update({(i, x, k): c for k in range(len(x) // 4)})
    assert pieces == want and sum(r["length"] for r in got) == tokens
    packs = defaultdict(list)
    for r in got:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in packs.values():
        size = sum(s for _, s in p)
        assert [a for a, _ in sorted(p)] == np.cumsum([0] + [s for _, s in sorted(p)])[:-1].tolist()
        assert size == capacity or size < capacity and size & (size - 1) == 0
    assert pattern_packing.pack_by_patterns(empty, path).count() == 0


def test_many_rows_of_one_length(spark):
    df = spark.range(9000).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, 'red stone', 'x') as text").repartition(5)
    got = pattern_packing.pack_by_patterns(df, tokenizer_path("word_bpe_49k.json"), capacity=16)
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("k"), F.count("*").alias("c"))
    assert by.where("n <> end or k <> c or not (n = 16 or bit_count(n) = 1)").count() == 0
    assert got.agg(F.sum("length")).first()[0] == 9000 * 2 + 3000
