"""Every operator over awkward rows, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bm25, exact_dedup, jaccard, line_dedup, mixing, packing, pii, quality, token_counts, url_filter
from siltstone.llm import registry
from siltstone.llm.registry import tokenizer_path

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def listed(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- 1
def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows)
    for split, size in ((1 << 14, 1 << 20), (50, 300)):
        assert listed(token_counts.count_tokens(docs, path, split_chars=split, batch_bytes=size), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, path).count() == 0


# --- 2
def brute_bm25(rows, queries, k, k1=1.2, b=0.75):
    docs = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t, _ in rows if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: round(10_000 * math.log(1 + (n - d + 0.5) / (d + 0.5))) for w, d in df.items()}
    out = Counter()
    for q, text in queries:
        terms = set(WORD.findall((text or "").translate(LOWER)))
        scored = [(-sum(idf[w] * round(10_000 * (c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean)))) for w in terms if w in c), i) for i, c in docs]
        for rank, (s, i) in enumerate(sorted(x for x in scored if x[0])[:k], 1):
            out[q, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("k, shard_docs, block_terms", [(1, 20, 900), (7, 3, 400), (7, 8192, 1_500_000)])
def test_bm25(docs, rows, empty, k, shard_docs, block_terms):
    asked = [(i, t) for i, t, _ in {r[0]: r for r in rows}.values() if i is not None and i % 3 == 0]
    queries = docs.where("doc_id % 3 = 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("query_id"), "text")
    got = bm25.bm25_topk(docs, queries, k=k, shard_docs=shard_docs, block_terms=block_terms)
    want = brute_bm25(rows, asked, k)
    assert Counter((r["query_id"], r["rank"], r["doc_id"], round(r["score"] * 1e8)) for r in got.collect()) == want


def test_bm25_of_empty_tables_and_named_ids(spark, docs, rows, empty):
    queries = docs.where("doc_id in (3, 6)").dropDuplicates(["doc_id"]).select(F.concat(F.lit("q"), "doc_id").alias("name"), F.col("text").alias("words"))
    assert bm25.bm25_topk(empty, queries, query_id_col="name", query_col="words").count() == 0
    assert bm25.bm25_topk(docs, queries.limit(0), query_id_col="name", query_col="words").count() == 0
    named = docs.where("doc_id is not null").withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    got = bm25.bm25_topk(named, queries, query_id_col="name", query_col="words", shard_docs=9)
    want = brute_bm25([(f"d{i:05d}", t, s) for i, t, s in rows if i is not None], [(f"q{i}", t) for i, t, _ in rows[:7] if i in (3, 6)], 10)
    assert Counter((r["query_id"], r["rank"], r["doc_id"], round(r["score"] * 1e8)) for r in got.collect()) == want


def test_block_bounds_prune_without_loss(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rnd.zipf(1.3, rnd.integers(1, 80)) if x < 500) for _ in range(700)]

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(bm25, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], names=["doc_id", "text"])
    (made,) = bm25._indexer(10_000, 1 << 30)(iter([batch]))
    row = {c: made.column(c)[0].as_py() for c in ("n", "lengths", "posting_doc", "posting_tf")} | {c: made.column(c)[0].values.to_numpy() for c in ("terms", "docs")}
    ids = made.column("ids")[0].values.to_numpy()
    terms = row["terms"]
    order = np.argsort(ids)
    asked = [np.sort(rnd.choice(terms, 12, replace=False)) for _ in range(40)]
    weights = dict(zip(terms.tolist(), rnd.integers(1, 50_000, len(terms)).tolist()))
    queries = bm25.Queries(pa.table({"query_id": range(40), "terms": [a.tolist() for a in asked], "rarity": pa.array([[weights[int(x)] for x in a] for a in asked], pa.list_(pa.int32()))}))

    def found(common, block, cells):
        monkeypatch.setattr(bm25, "COMMON", common)
        monkeypatch.setattr(bm25, "BLOCK_DOCS", block)
        monkeypatch.setattr(bm25, "TILE_CELLS", cells)
        hit, doc, points = bm25.Shard(row, 40.0, 1.2, 0.75).search(queries, 5, ids[order], np.argsort(order))
        return sorted(zip(queries.ids.to_numpy()[hit].tolist(), (-points).tolist(), ids[doc].tolist()))

    whole = found(2.0, 1024, 1 << 30)
    assert len(whole) == 200
    for common, block, cells in ((0.1, 8, 2000), (0.02, 1, 700), (0.5, 64, 10)):
        assert found(common, block, cells) == whole
    # floors leave what goes before them, by score and then by id, and nothing else
    places = {}
    for hit in whole:
        places.setdefault(hit[0], []).append(hit[1:])
    queries.raise_floors({i: (-h[2][0], h[2][1]) for i, h in places.items()})
    assert found(0.1, 8, 2000) == sorted((i, *x) for i, h in places.items() for x in h[:2])


def test_blocks_meet_only_queries_that_want_them(monkeypatch):
    """15 topics without common words: of 60 queries in a tile, a block's documents are multiplied with few."""

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
            out = getattr(ufunc, method)(*[x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs], **kwargs)
            cells.append(out.size if ufunc is np.matmul else 0)
            return out

    monkeypatch.setattr(bm25, "TaskContext", Context)
    rnd, cells = np.random.default_rng(4), []
    texts = [" ".join(f"t{i % 15}w{int(x)}" for x in rnd.integers(0, 12, 30)) for i in range(6000)]
    (made,) = bm25._indexer(10_000, 1 << 30)(iter([pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts)], names=["doc_id", "text"])]))
    row = {c: made.column(c)[0].as_py() for c in ("n", "lengths", "posting_doc", "posting_tf")} | {c: made.column(c)[0].values.to_numpy() for c in ("terms", "docs")}
    ids = made.column("ids")[0].values.to_numpy()
    (asked,) = bm25._query_terms(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts[:60])], names=["query_id", "text"])]))
    terms = asked.column(1).to_pylist()
    queries = bm25.Queries(pa.table({"query_id": range(60), "terms": terms, "rarity": pa.array([[9] * len(t) for t in terms], pa.list_(pa.int32()))}))
    shard = bm25.Shard(row, 30.0, 1.2, 0.75)
    shard.matrix, shard.rows = shard.matrix.view(Counted), shard.rows.view(Counted)
    order = np.argsort(ids)
    hit, doc, _ = shard.search(queries, 5, ids[order], np.argsort(order))
    assert len(hit) == 300 and (ids[doc] % 15 == queries.ids.to_numpy()[hit] % 15).all()
    assert 0 < sum(cells) < 0.3 * 60 * 6000


def test_ties_do_not_ship_more_hits_with_more_shards(spark, monkeypatch):
    """1,200 equal texts: waves after the first send only what goes before the k-th hit, by id."""
    df = spark.range(1200).selectExpr("id * 7919 % 1200 as doc_id", "'one stone river' as text").repartition(4)
    shipped = []
    searcher = bm25._searcher

    def counted(block, k, mean_words, k1, b):
        run = searcher(block, k, mean_words, k1, b)

        def both(batches):
            for batch in run(batches):
                hits.add(len(batch.column(1).values))
                yield batch

        return both

    monkeypatch.setattr(bm25, "_searcher", counted)
    for shard_docs in (75, 19):
        hits = spark.sparkContext.accumulator(0)
        got = bm25.bm25_topk(df, df.where("doc_id = 5").withColumnRenamed("doc_id", "query_id"), k=10, shard_docs=shard_docs)
        assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(10))
        shipped.append(hits.value)
    assert shipped[0] <= 160 and shipped[1] <= 200


# --- 3
def test_mixing_reaches_targets(docs, rows, empty):
    got = mixing.mix_sources(docs, bucket_rows=5).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    by_source = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source_size"], r["target"]].append(r["taken"])
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * total)
    for (size, target), taken in by_source.items():
        assert target <= 2 * size and sum(taken) == math.floor(target)
    assert Counter(got) == Counter(mixing.mix_sources(docs.repartition(7), bucket_rows=9, equal_rows=1).collect())
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_of_many_rows_without_an_id(spark):
    """Equal rows share their source's budget as rows of their own: brute force over sizes in order."""
    df = spark.range(5000).selectExpr("cast(null as long) as doc_id", "repeat('word ', cast(id % 3 as int)) as text", "'s' as source")
    got = sorted((r["size"], r["taken"]) for r in mixing.mix_sources(df, share=0.5, equal_rows=700).collect())
    sizes = sorted(i % 3 for i in range(5000))
    left, want = sum(sizes) // 2, []
    for size in sizes:
        want.append((size, min(size, left)))
        left -= min(size, left)
    assert got == sorted(want)


# --- 4
def brute_components(rows, width=4, percent=85):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return sets, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("stars", [0, 2])
def test_jaccard_components(docs, rows, empty, stars):
    sets, root = brute_components(rows)
    least = defaultdict(list)
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    want = Counter((i, len(s), min(least[r]) if least[r] else None) if s else (i, 0, i) for (i, _, _), s, r in zip(rows, sets, root))
    assert listed(jaccard.similar_components(docs, star_rounds=stars), "doc_id", "n_shingles", "component_id") == want
    if stars:
        assert jaccard.similar_components(empty).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_order_a_asks_for_no_more_than_any_link_shares(percent):
    for n in range(1, 260):
        need, posted = jaccard._needed(n, percent), jaccard._posted(n, percent)
        for m in range(1, 100 * n // percent + 2):
            for common in range(1, min(n, m) + 1):
                if 100 * common >= percent * (n + m - common):
                    # the tokens that only one of two sets holds come first in it, at worst
                    shared = min(common, posted - (n - common), jaccard._posted(m, percent) - (m - common))
                    assert 1 <= need <= shared, (n, m, common)


def test_short_texts_that_differ_by_a_word_at_the_edge(spark):
    rows = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(10)]
        rows += [(3 * k, " ".join(words), "s0"), (3 * k + 1, " ".join(words[:9] if k % 2 else words[1:]), "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs).collect()}
    assert got == {i: 3 * (i // 3) for i, _, _ in rows}


def test_shingles_do_not_depend_on_slices():
    from siltstone.llm import shingles

    text = "Ab  cd\tef gh ij kl " * 90_000
    assert [len(s) for s in shingles.shingle_sets([text, "a b", "A B", "", None, "a b c d e"])] == [6, 1, 1, 0, 0, 2]
    one, two = shingles.shingle_sets(["x " * 3 + text, "z"]), shingles.shingle_sets(["x x x " + text])
    assert np.array_equal(next(iter(one)), next(iter(two)))
    a, b = list(shingles.shingle_sets(["a b", "A B"]))
    assert np.array_equal(a, b)


# --- 5
def test_quality_learns_and_is_defined_everywhere(spark, docs, empty):
    good = [(i, " ".join(f"plain words of text number{(i * k) % 37}" for k in range(30)), 1) for i in range(300)]
    bad = [(i, " | ".join(f"JUNK!!{(i * k) % 41}###" for k in range(40)), 0) for i in range(300, 420)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1), (9999, 0)], "doc_id long, quality int"))
    model = quality.fit_quality(table.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r for r in quality.score_quality(table, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert sum(got[i]["predicted"] == (i < 300) for i in held) >= 0.95 * len(held)
    awkward = quality.score_quality(docs, model).collect()
    assert len(awkward) == docs.count() and all(0 <= r["score"] <= 1 for r in awkward)
    assert quality.score_quality(empty, model).count() == 0
    constant = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, constant).collect()} == {0.5}


def naive_quality(texts, labels, fold_of):
    """Scores by one's own reading of the method: dictionaries from every other labelled text of each class, sizes of
    500-byte chunks under both, and a logistic function of them fitted to the others."""
    import zstandard

    known = sorted((hashlib.md5(f"fit:{i}".encode()).hexdigest(), i, y) for i, y in labels.items() if fold_of(i) != 0)
    parts = {y: [texts[i] for _, i, label in known if label == y] for y in (0, 1)}

    def chunks(t):
        raw = t.encode()
        return [raw[a : a + 500] for a in range(0, len(raw), 500)] or [b""]

    coders = []
    for y in (0, 1):
        samples = [c for t in parts[y][0::2] for c in chunks(t) if c]
        try:
            data = zstandard.train_dictionary(32 << 10, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(samples)[-(32 << 10) :]
        coders.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), level=3, write_content_size=False, write_checksum=False, write_dict_id=False))

    def describe(t):
        bad, good = (sum(len(c.compress(p)) for p in chunks(t)) for c in coders)
        n = len(t.encode())
        rate, diff = (bad + good) / (2 * n + 42), (bad - good) / (bad + good + 20)
        return [1, (bad - good) / (n + 21), diff, rate, rate * rate, math.log1p(n), diff * math.log1p(n), min(rate, 0.2)]

    share = sum(y for *_, y in known) / len(known)
    x = np.array([describe(t) for y in (0, 1) for t in parts[y][1::2]])
    y = np.array([float(v) for v in (0, 1) for _ in parts[v][1::2]])
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale == 0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(60):  # reweighted least squares
        p = 1 / (1 + np.exp(-z @ w))
        curve = np.sqrt(weight * p * (1 - p))
        rows = np.vstack([z * curve[:, None], math.sqrt(1e-3) * np.eye(len(w))])
        aim = np.append(curve * (z @ w) + weight * (y - p) / np.maximum(curve, 1e-300), np.zeros(len(w)))
        w = np.linalg.lstsq(rows, aim, rcond=None)[0]
    return {i: 1 / (1 + math.exp(-float((np.array(describe(t)) - mean) / scale @ w))) for i, t in texts.items()}


def test_quality_scores_equal_a_naive_fit(spark):
    rnd = np.random.default_rng(4)
    plain, junk = [f"plain{k}" for k in range(60)], [f"JUNK!{k}#" for k in range(40)]
    texts = {i: " ".join(rnd.choice(plain if rnd.random() < (0.75 if i % 4 else 0.35) else junk) for _ in range(rnd.integers(5, 160))) for i in range(500)}
    labels = {i: int(i % 4 != 0) for i in texts}
    rows = [(i, t) for i, t in texts.items()]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    model = quality.fit_quality(frame(rows), table)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(rows), model).collect()}
    want = naive_quality(texts, labels, lambda i: zlib.crc32(str(i).encode()) % 5)
    assert max(abs(got[i] - want[i]) for i in texts) < 1e-5
    again = quality.fit_quality(frame(rows[::-1] + rows[:50]).repartition(5), table.union(table).repartition(3))
    assert (again.weights == model.weights).all() and again.dictionaries == model.dictionaries and again.share == model.share


# --- 6
def test_exact_dedup_of_many_frequent_texts(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "concat('t', case when id % 3 = 0 then 0 else id % 600 end) as text")
    got = exact_dedup.exact_dedup(df)
    want = Counter("t0" if i % 3 == 0 else f"t{i % 600}" for i in range(40_000))
    assert Counter(r["group_size"] for r in got.where("kept").collect()) == Counter(want.values())
    assert got.count() == 40_000


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups["".join(c for c in t or "" if c not in BLANKS)].append((-len(t or ""), i is None, i))
    for heavy in (1, 256):
        got = exact_dedup.exact_dedup(docs, heavy=heavy).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
        want = Counter()
        for text, members in groups.items():
            best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
            for m in members:
                want[m[2], best[2], len(members), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- 7
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else 0, "card": 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_pii_base_spans(spark, docs, rows, empty):
    texts = [r[1] for r in rows] + ["a@b.c@d.e x.y%a@b.co foo@bar", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 😀 4111111111111111", "9" * 5000, "a" * 50_000 + "@", "+1 (974) 555-3436, +12 3 call 974-555-3436 +++1 22", "bob [at] mail [dot] com", "@" * 500 + "a@b.c", "1 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        joined = ",".join(f"{n}:{s}:{e}" for s, _, e, n in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n, _ in BASE] == [sum(w[3] == n for w in want) for n, _ in BASE]
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii.find_pii(docs).count() == len(rows) and pii.find_pii(empty).count() == 0


def test_pii_estimates_reliabilities():
    belief, chances = pii.estimate({"+++": 90, "++0": 40, "---": 300, "-+-": 60, "+--": 10})
    assert belief["+++"] > 0.95 and belief["---"] < 0.05 and belief["+--"] < 0.5
    assert chances[0]["+"][0] > chances[0]["+"][1]


def test_pii_adds_what_the_labelers_agree_on(spark):
    rows = [(i, f"call phone 974-555-{i:04d} now or mail u{i}@mail.example.com; call phone +1 974 555 {i:04d} now") for i in range(200)]
    rows += [(1000 + i, f"part x/{i:03d}-{i:03d}-{i:04d}z of the set") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all("phone:11:23" in got[i] for i in range(200)) and not any(got[1000 + i] for i in range(100))


def test_pii_finds_planted_spans_beyond_the_base(spark):
    """Recall and precision of added spans on planted ones: spelled addresses, grouped numbers, secrets, and decoys."""
    rnd = np.random.default_rng(11)
    letters = "abcdef0123456789"

    def hexes(n):
        return "".join(rnd.choice(list(letters), n - 2)) + "a7"

    rows, want, decoys = [], {}, set()
    for i in range(600):
        words = [" ".join(rnd.choice("the river stone of green cloud and paper seven".split(), 6)) for _ in range(4)]
        spelled, grouped, secret = f"u{i}.x [at] mail{i % 7} [dot] org", f"974-555-{i:04d}", hexes(40)
        given = {0: ("mail ", spelled, "email", ""), 1: ("call ", grouped, "phone", ""), 2: ('token = "', secret, "secret", '"'), 3: ("", "", "", "")}[i % 4]
        text = f"{words[0]} {given[0]}{given[1]}{given[3]} {words[1]}"
        at = len(words[0]) + 1 + len(given[0])
        if given[1]:
            want[i] = f"{given[2]}:{at}:{at + len(given[1])}"
        else:
            text += f" part-of-speech-tagger-{i:02d}x-with/paths/in_it/{i}a order x{i:03d}-{i:03d}-{i:04d}y " + words[2]
            decoys.add(i)
        if i % 3 == 0:
            text += f" u{i}@mail.example.com and 84.26.86.{i % 200} " + words[3]
        rows.append((i, text))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(w in got[i]["spans"].split(",") for i, w in want.items()) >= 0.95 * len(want)
    assert sum(got[i]["n_spans"] > 2 * (i % 3 == 0) for i in decoys) <= 0.05 * len(decoys)


def test_pii_has_no_longest_candidate(spark):
    """Secrets and spelled addresses of any length are found, as the short ones beside them are."""
    rows, want = [], {}
    for i in range(300):
        secret, spelled = ("0123456789abcdef" * 40)[i % 16 :][: 40 if i % 3 else 500], "u" * (5 if i % 3 else 90) + f"{i} [at] mail [dot] org"
        given, kind, value = ('token = "', "secret", secret) if i % 2 else ("mail ", "email", spelled)
        rows.append((i, f"the river {given}{value}{'"' if i % 2 else ''} of stone"))
        want[i] = f"{kind}:{10 + len(given)}:{10 + len(given) + len(value)}"
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(want[i] in got[i].split(",") for i in want)


def test_many_matches_in_one_text_are_placed(spark):
    text = "😀 mail a.b@c.example.org now " * 20_000
    spans = spark.createDataFrame([(text,), ("",), ("x",)], "text string").select(pii.located(F.col("text"), pii.EMAIL).alias("s")).collect()
    assert [(s["start"], s["end"]) for s in spans[0]["s"]] == [m.span() for m in re.finditer(r"[a-z.]+@[a-z.]+", text)]
    assert spans[1]["s"] == [] and spans[2]["s"] == []


# --- 8
def brute_urls(urls, rules):
    out = Counter()
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out[(i, host, path, *(max(fits)[1:] if fits else (None, "allow")))] += 1
    return out


def test_url_cascade(spark):
    hosts = ["a.com", "www.a.com", "b.net", "WWW.B.NET", "x.y.b.net", "com", "other.org", "acom", ""]
    paths = ["", "/", "/en/", "/en", "/es/x?q=/fr/", "/fr/1#z", "?x", "#y"]
    urls = [(k, f"http://{h}{p}") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, "no scheme"), (902, "http://a.com/://b"), (None, "http://a.com/en/"), (1, "http://a.com")]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("www.a.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("never.org", "/", "block")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("html", F.lit("x"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert listed(url_filter.judge_urls(pages, table), "page_id", "host", "path", "rule", "verdict") == brute_urls(urls, rules)
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_url_list_of_many_lengths_and_parts(spark):
    """Keys follow a host's own rules, however many lengths the list has; a list beyond the largest filter is split."""
    rules = [(f"h{i}.com", "/" + "x" * i, "block" if i % 3 else "allow") for i in range(100)] + [("h7.com", "/" + "x" * 20, "allow"), ("com", "/" + "x" * 90, "block")]
    urls = [(i, f"https://www.h{i % 110}.com/" + "x" * (i * 7 % 160) + "?q") for i in range(400)]
    pages, table = spark.createDataFrame(urls, "page_id long, url string").repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string")
    for most_bits in (1 << 30, 64):
        assert listed(url_filter.judge_urls(pages, table, most_bits=most_bits), "page_id", "host", "path", "rule", "verdict") == brute_urls(urls, rules)
    keys = table.select(F.col("host").alias("rule_host"), F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict")
    own = Counter(h for h, _, _ in rules)
    for r in url_filter.candidates(pages, keys, "page_id", "url", 1 << 30).collect():
        assert len(r["keys"]) <= own[r["host"].removeprefix("www.")] + own["com"]
    split = url_filter.build_cascades(keys.select("key"), keys.select(F.concat("key", F.lit("y")).alias("key")), most_bits=64)
    assert len(split) >= 2 and all(level.bits <= 128 for c in split for level in c.value.levels)


def test_very_long_urls(spark):
    """Hosts of many labels and long paths cost no more than their length."""
    urls = [(1, "http://" + "a." * 50_000 + "example.com/en/" + "x" * 50_000), (2, "http://" + "a" * 100_000), (3, "http://" + "." * 100_000 + "net/es/"), (4, "http://example.com.")]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block")]
    got = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert listed(got, "page_id", "host", "path", "rule", "verdict") == brute_urls(urls, rules)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    inside = universe.where(F.xxhash64("key") % 17 == 0)
    cascade = url_filter.build_cascade(inside, universe)
    assert len(cascade.levels) > 1
    keys = universe.withColumn("real", F.xxhash64("key") % 17 == 0).select("real", *url_filter.digests(F.col("key"))).toPandas()
    one, two = (keys[c].to_numpy().view(np.uint64) for c in ("one", "two"))
    got = cascade.listed([url_filter.level_hashes(one, two, k) for k in range(len(cascade.levels))])
    assert (got == keys["real"].to_numpy()).all()


# --- 9
def test_lines_that_recur_stay_once(docs, rows, empty):
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) == set(got.columns)
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r["doc_id"]].append(r)
    passage = rows[85 + 0][1].split("\n")[1]
    assert [passage in by_id[85 + k][0]["text"] for k in range(5)] == [True, False, False, False, False]
    assert [len(by_id[85 + k][0]["text"].split("\n")) for k in range(5)] == [3, 2, 2, 2, 2]
    assert by_id[77][0]["text"] is None and by_id[77][0]["n_lines"] == 0
    assert by_id[75][0]["n_dropped"] > 0 and by_id[0][0]["n_dropped"] == 0
    assert by_id[78][0]["text"] == "" and by_id[80][0]["text"] == "one"
    assert sum(map(len, by_id.values())) == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_templates_cover_variable_fields(spark):
    rows = [(i, f"Page {i} of 90 printed on day {i * 3}\nown line number w{i}x of this text here") for i in range(4)]
    rows += [(10, "we greet you here today with a very warm hello from red town\nq"), (11, "we greet you here today with a very warm hello from blue town\nr"), (12, "we greet you here and other words follow that no one else has in place\ns")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and "Page" not in got[3]
    assert got[10] == rows[4][1] and got[11] == "r" and got[12] == rows[6][1]


# --- 10
def test_equal_rows_fall_into_even_groups(spark):
    df = spark.range(6000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    got = packing.pack(df, tokenizer_path("word_bpe_49k.json"), group_rows=1000).groupBy((F.col("sequence_id") / F.lit(1 << 32)).cast("long").alias("g")).count().collect()
    assert len(got) == 6 and max(r["count"] for r in got) < 1300


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows]
    for capacity, group in ((2048, 20_000), (256, 40)):
        want = Counter()
        for i, x in ids:
            for k in range(0, len(x), capacity):
                part = x[k : k + capacity]
                want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        got = packing.pack(docs, path, capacity=capacity, group_rows=group).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        if group > len(got):
            assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / capacity) + 1
    assert packing.pack(empty, path).count() == 0


def test_words_are_encoded_as_the_library_does():
    path = tokenizer_path("word_bpe_49k.json")
    encode = packing.word_ids(path)
    odd = ["", "  a  b ", "<|endoftext|>x <|STARTOFTEXT|> <|startoftext|>", "Ça İstanbul ΣΑΣ ΣΑΣ.", "a.b,c.. d,, e.", "\tfoo\rbar\x1cbaz qux z", "é é ́x", "don't it's I'll 's a' b'. x!!?", "123 4567 ½ Ⅷ", "漢字 かな, ไทย. हिन्दी,", "ǅ ß ẞ. İ,", "x" * 5000, "\x00 a\x00b", "😀 👍🏽."]
    for text in odd:
        assert encode([text])[0] == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


# --- the pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.count() > 0
        if number < 4:
            assert docs.columns == columns
        if number in (0, 1, 2):
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if number == 0:
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            scores = naive_quality({r["doc_id"]: r["text"] for r in before.collect()}, labels, lambda i: zlib.crc32(str(i).encode()) % 5)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, s in scores.items() if s >= 0.3}
        if number == 1:
            db = duckdb.connect()
            db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/0/*.parquet'")
            want = {i: (n, d, h) for i, n, d, h in db.sql(f"SELECT doc_id, n_lines, n_dropped, text_sha256 FROM ({registry.OP9_SQL})").fetchall()}
            got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}
            assert all(want[i][2] == h for i, h in got.items())
            assert all(want[r["doc_id"]][1] for r in before.join(docs, "doc_id", "left_anti").collect())
        if number == 4:
            from tokenizers import Tokenizer

            tokenizer, pieces = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
            for r in before.collect():
                ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
                for k in range(0, len(ids), 2048):
                    pieces[r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
            assert listed(docs, "doc_id", "piece", "start", "length", "ids_crc32") == pieces
            held = Counter()
            for r in docs.collect():
                held[r["sequence_id"]] += r["length"]
            assert max(held.values()) <= 2048 and len(held) <= 1.02 * sum(held.values()) / 2048 + 1
        if number == 2:
            rows = [(r["doc_id"], r["text"], None) for r in before.collect()]
            sets, root = brute_components(rows)
            least = {}
            for r, x in zip(rows, root):
                least[x] = min(least.get(x, r[0]), r[0])
            assert {r["doc_id"] for r in docs.collect()} == {r[0] for r, s, x in zip(rows, sets, root) if not s or least[x] == r[0]}
        if number == 3:
            want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(before).collect() if r["taken"]}
            got = Counter()
            for r in docs.collect():
                got[r["doc_id"]] += len(WORD.findall(r["text"]))
            assert dict(got) == want


def test_pipeline_stages_over_awkward_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline as pipeline

    rows = docs.withColumns({c: F.lit("clash") for c in ("words", "taken", "taken_id", "row_id", "kept_id", "lines", "dropped", "a.b")})
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (rows, empty):
        now = start
        for number, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            path = str(tmp_path / f"{start is rows}-{number}")
            out.write.parquet(path)
            if number < 4:
                assert out.columns == start.columns
                assert all({r[c] for r in out.select(f"`{c}`").distinct().collect()} <= {"clash"} for c in ("row_id", "dropped", "a.b") if c in start.columns)
            now = spark.read.schema(out.schema).parquet(path)
        assert (now.count() > 0) == (start is rows)


def test_bm25_documents_of_like_words_stand_together(monkeypatch):
    """Texts of two languages lie apart in a shard though their commonest words differ."""
    class Context:
        get = staticmethod(lambda: Context())
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(bm25, "TaskContext", Context)
    rnd = np.random.default_rng(4)
    texts = []
    for i in range(400):
        words = [f"{'ab'[i % 2]}{rnd.integers(0, 20)}" for _ in range(30)]
        texts.append(" ".join([*words, *[words[int(rnd.integers(0, 30))]] * 9]))
    (made,) = bm25._indexer(10_000, 1 << 30)(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])]))
    kinds = [i % 2 for i in made.column(made.schema.get_field_index("ids"))[0].as_py()]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 8
