"""Token counts with their cache, centroid clustering, spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import build
from tidewire.llm import bpe, centroids, spelling, token_counts
from tidewire.llm.common import numbered, salted, written

public = pytest.importorskip("public_tokenizers")


# Token counts


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.Tokenizer.load(public.path("byte_bpe_50k.json"))


def _plain(path):
    import sentencepiece
    import tokenizers

    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    made = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(made.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(spark, odd, odd_rows, tmp_path, name):
    made, plain = token_counts.Tokenizer.load(public.path(name)), _plain(public.path(name))
    got = token_counts.counted(odd, made, f"file://{tmp_path}/cache").collect()
    expected = sorted((i, len((t or "").encode()), plain(t or ""), plain(t or "") > 1024) for i, t, _, _ in odd_rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    assert {r.content for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in odd_rows}


def test_only_distinct_misses_are_encoded(spark, tokenizer, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = [(i, f"text number {i % 5}", "en", "a") for i in range(40)]
    first = build(spark, rows)
    assert token_counts.counted(first, tokenizer, cache).count() == 40
    assert token_counts.cached(spark, cache, tokenizer).count() == 5
    files = spark.read.parquet(f"{cache}/tokenizer={tokenizer.digest}")
    assert files.count() == 5  # one row a content, not a row
    # counts that are there are taken from there: a planted one shows
    digest = hashlib.sha256(b"planted").digest()
    spark.createDataFrame([(bytearray(digest), 77), (bytearray(digest), 77)], "content binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.digest}")
    more = build(spark, [*rows, (50, "planted", "en", "a"), (51, "new", "en", "a"), (52, None, "en", "a")])
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(more, tokenizer, cache).collect()}
    assert len(got) == 43 and got[50] == 77 and got[51] == 1 and got[52] == 0
    assert token_counts.cached(spark, cache, tokenizer).count() == 8
    # another version has counts of its own
    other = tokenizer._replace(digest="0" * 64)
    assert {r.doc_id: r.n_tokens for r in token_counts.counted(more, other, cache).collect()}[50] == _plain(public.path("byte_bpe_50k.json"))("planted")
    assert token_counts.Tokenizer.load(public.path("word_bpe_49k.json")).digest != tokenizer.digest


def test_count_of_no_rows_and_of_joined_rows(spark, none, odd, tokenizer, tmp_path):
    assert token_counts.counted(none, tokenizer, f"file://{tmp_path}/a").collect() == []
    twice = odd.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n_tokens"))
    got = token_counts.counted(twice, tokenizer, f"file://{tmp_path}/b").collect()
    assert len(got) == 2 * odd.count()
    assert token_counts.counted(twice, tokenizer, f"file://{tmp_path}/b", keep=("doc_id", "text")).columns == ["doc_id", "text", "content", "n_bytes", "n_tokens", "over_limit"]


def test_long_texts_in_pieces(monkeypatch, tokenizer):
    r = random.Random(5)
    texts = ["".join(r.choice("ab  \n.'s1é<|endoftext|>") for _ in range(r.randint(0, 3000))) + " it's done" for _ in range(60)]
    plain = _plain(public.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_counts, "PIECE", 50)
    assert all("".join(token_counts.pieces(t, 50)) == t for t in texts)
    assert token_counts.counter(tokenizer)(texts) == [plain(t) for t in texts]


def test_rows_are_numbered_once(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    made = [files, files.filter("doc_id > 3").select("doc_id"), files.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")), files.union(files), files.alias("a").join(files.alias("b"), F.lit(True)).select("a.doc_id"), files.groupBy("doc_id").count()]
    for df in made:
        rows = numbered(df, "number")
        assert rows.select("number").distinct().count() == rows.count() == df.count() > 0
        assert sorted(map(str, rows.collect())) == sorted(map(str, rows.collect()))


def test_salted_join_keeps_all_rows(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    keyed = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2))
    got = salted(rows, keyed, "k", "n")
    assert got.count() == 5000 and got.filter("v <> 2 * k").count() == 0 and got.agg(F.count_distinct("id")).first()[0] == 5000


# Clusters


def _clustered(rows, k=8, rounds=10, seed=3, width=64, scale=1024):
    good = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in good)
    at = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in good]
        groups = [[v for (_, v), o in zip(good, own) if o == j] for j in range(len(at))]
        at = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, at)]
    last = [(i, *nearest(v)) for i, v in good]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in last)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int, ids string").repartition(5)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=64) * 0.1 + (i % 5)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(3, rows[3][1]), (None, rows[9][1]), (None, rows[11][1])]
    rows += [(500, None), (501, []), (502, [float("nan")] * 64), (503, [1.0] * 63 + [None]), (504, [float("inf")] * 64), (505, [1.0] * 63)]
    got = centroids.cluster(_vectors(spark, rows)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == _clustered(rows)


def test_clusters_of_few_none_and_large_values(spark):
    few = [(i, [float(i)] * 64) for i in range(3)] + [(9, [0.0] * 64)]
    got = centroids.cluster(_vectors(spark, few)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == _clustered(few)
    assert centroids.cluster(_vectors(spark, [])).collect() == []
    assert centroids.cluster(_vectors(spark, [(1, None)])).collect() == []
    large = [(i, [float((-1) ** i * 10 ** (i % 7))] * 64) for i in range(40)]  # beyond the tables' 64 bits
    got = centroids.cluster(_vectors(spark, large)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == _clustered(large)
    huge = [(0, [3e38] * 64), (1, [-3e38] * 64), (2, [1.0] * 64)]
    assert {r.vec_id: r.distance for r in centroids.cluster(_vectors(spark, huge), k=1, rounds=1).collect()}[0] == 2**63 - 1


def test_blocks_tabulate_what_occurs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=4)]) for i in range(9000)]
    blocks = centroids.packed(_vectors(spark, rows).coalesce(1), 4, 1).collect()
    assert all(len(b.ids) <= centroids.BLOCK for b in blocks) and sum(len(b.ids) for b in blocks) == 9000
    assert all(len(np.frombuffer(bytes(b["values"]), np.int64)) <= 7 * 4 for b in blocks)
    model = centroids.fit(centroids.packed(_vectors(spark, rows), 4, 1), [[0] * 4, [2] * 4], 3)
    assert len(model.history) == 4 and model.history[0] >= model.history[-1] == sum(model.inertia)


# Spelling


def _one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def _variants(counts, times=10):
    words = sorted(counts)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if _one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else -1) for w in words)


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def _dense(seed, letters, lengths, n):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        w = r.choice(base)
        i = r.randrange(len(w) + 1)
        out.add(r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]]))
    return {w: r.choice([2, 3, 25, 300, 4000]) for w in out if len(w) >= 7}


@pytest.mark.parametrize("seed,letters,lengths,shard", [(1, "ab", (7, 8, 9), 400), (2, "abcé", (7, 8, 12, 31), 1 << 18), (3, "abcdefghijklmnopqrstuvwxyzßàÿÀ÷", (7, 10, 11), 900), (4, "a", (7, 8, 9, 40), 20)])
def test_near_words(spark, monkeypatch, seed, letters, lengths, shard):
    counts = _dense(seed, letters, lengths, 700) if len(letters) > 1 else {"a" * k: 2 + k for k in range(7, 60)} | {"a" * 30 + "b" + "a" * 5: 9}
    monkeypatch.setattr(spelling, "SHARD_CHARS", shard)
    monkeypatch.setattr(spelling, "SHARD_QUERIES", 30 if seed == 1 else 200_000)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = spelling.near_words(words, shard).collect()
    pairs = [(r.word, r.near) for r in near]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in counts for b in counts if _one_apart(a, b)}
    assert all(r.n == counts[r.word] and r.near_n == counts[r.near] for r in near)
    assert _rows(spelling.variants(words)) == _variants(counts)


def test_variants_of_documents(spark, odd, odd_rows):
    counts = Counter()
    for i, text, _, _ in odd_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    frequent = Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:1500]))
    assert sorted(map(tuple, spelling.vocabulary(odd).collect())) == sorted(counts.items())
    words = spark.createDataFrame(list(frequent.items()), "word string, n long")
    assert _rows(spelling.variants(words, 2)) == _variants(frequent, 2)


def test_variants_of_nothing_and_of_long_runs(spark, none):
    assert spelling.variants(spelling.vocabulary(none)).collect() == []
    a = "x" * 3000 + "y" + "z" * 3000
    rows = [(1, f"{a} {a} {a[:-1]}q", "en", "a"), (2, f"{a[:-1]}q {a}", "en", "a"), (None, a, "en", "a"), (4, "ABCDEFG ABCDEFG abcdefg1abcdefgh", "en", "a"), (5, "ÀBCDEFG àBCDEFG", None, None)]
    docs = build(spark, rows)
    vocabulary = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert _rows(spelling.variants(spelling.vocabulary(docs))) == _variants(vocabulary)


def test_intervals_stay_in_step():
    """Left and right extensions of the index agree with counting in the text."""
    words = sorted({"abcabca", "abcabcb", "bcabcab", "ccccccc", "aaaaaaa"})
    index = spelling.Index(words)
    text = "\0" + "\0".join(words) + "\0"

    def symbol(c):
        return np.array([1 if c == "\0" else int(np.searchsorted(index.letters, ord(c))) + 2])

    r = random.Random(3)
    for _ in range(200):
        at = r.randrange(len(text) - 5)
        pattern, k = text[at : at + 5], r.randrange(1, 5)
        state = index.everything(1)
        for c in reversed(pattern[:k]):
            state = index.left(state, symbol(c))
        for c in pattern[k:]:
            state = index.right(state, symbol(c))
        other = index.everything(1)
        for c in pattern:
            other = index.right(other, symbol(c))
        assert [int(x[0]) for x in state] == [int(x[0]) for x in other]
        assert int(state[2][0]) == sum(text.startswith(pattern, i) for i in range(len(text)))
