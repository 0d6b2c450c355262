"""Vectors, conversations, graphs, hashing, the registered queries and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import same
from tests.llm import brute
from tidewire.llm import chat, components, knn, queries, wordhash
from tidewire.llm.common import written


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, cell string, v string")


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 700)]  # many copies of one vector
    rows += [(700, None), (750, []), (800, [float("nan")] * 6), (850, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("inf")] * 6), (950, [0.5, 0.5]), (None, rows[3][1])]
    got = {}
    for r in knn.search(_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    good = {i: np.floor(np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v))) * 256).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    queries_ = [i for i in good if i % 50 == 0]
    assert set(got) == set(queries_)
    for q in queries_:
        best = sorted(((int(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, s) for s, i in best]


def test_knn_small_and_empty(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert [(r.rank, r.vec_id) for r in knn.search(_vectors(spark, few), F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert knn.search(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    huge = [(0, [1e19, -1e8]), (1, [1e8, 1.0]), (2, [-1e19, 0.0]), (50, [3e9, 3e9])]
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.search(_vectors(spark, huge), F.col("vec_id") % 50 == 0).collect()}
    assert set(out) == {(q, k) for q in (0, 50) for k in (1, 2, 3)} and out[0, 1] == (1, 2**63 - 1) and out[0, 3] == (2, -(2**63))
    assert knn.search(_vectors(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mark int, piece string").repartition(4)


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\<|b", "\\", "<\\|", "x<", "", None, "line\nbreak\\n"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % 8], 1, "x") for c in range(5) for t in range(8)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t}", 1, "x") for t in range(300)]  # longer than a run
    rows += [(None, 0, None, "no id", 1, "x"), (7, 1, "a\nb|<|", "odd role", 1, "x"), (6, 0, "user", "same", 1, "x"), (6, 0, "user", "same", 1, "x")]
    rows += [(8, 2, "assistant", x, 1, "x") for x in ("ok then", "ok", "ok!", "", "b" * 80, "b" * 79 + "a")] + [(8, 2, "user", "ok", 1, "x")]  # one turn, several rows
    got = {r.conv_id: r for r in chat.summarise(chat.render(_turns(spark, rows))).collect()}
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r.loss_chars, r.loss_sha256, r.n_rewritten) == (len(said), brute.sha(said), 0)
        assert r.formatted_chars == len(chat.marked([(role, x) for _, role, x in turns]))
    assert chat.render(_turns(spark, [])).count() == 0 and chat.summarise(chat.render(_turns(spark, []))).count() == 0


def test_chat_finds_rewritten_history():
    def template(turns, prompt=None):  # keeps only the last answer's text
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else ''};" for i, (r, t) in enumerate(turns)) + (f"[{prompt}]" if prompt else "")

    run = chat.Renderer(template, True)
    flags = [run.add(t)[3] for t in [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]]
    assert flags == [False, False, False, True]


def test_chat_renders_true_history_beyond_a_run(spark):
    def template(turns, prompt=None):  # the last answer's text only; roles must alternate
        assert all(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else ''};" for i, (r, t) in enumerate(turns)) + (f"[{prompt}]" if prompt else "")

    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}", 1, "x") for c in range(3) for t in range(70)]
    got = {(r.conv_id, r.turn): tuple(r)[2:6] for r in chat.render(_turns(spark, rows), template).collect()}
    for c in range(3):
        run = chat.Renderer(template, True)
        for _, t, role, text, *_ in rows[c * 70 : c * 70 + 70]:
            assert got[c, t] == run.add((role, text))


def test_chat_spans_are_the_answers():
    run = chat.Renderer(chat.marked, True)
    for turn in [("user", "q"), ("assistant", "an <| answer"), ("assistant", "")]:
        span, lo, hi, odd = run.add(turn)
        assert not odd and chat.read_back(span) == [turn]
        assert chat.unescape(span[lo:hi]) == (turn[1] if turn[0] == "assistant" else "")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in range(101, 160)} == {100} and got[301] == 300 and 200 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    data = b"  one two\tthree\n\x0bone \xc3\xa9 two"
    h, lo = wordhash.words(data)
    assert [data[i : i + 2] for i in lo] == [b"on", b"tw", b"th", b"on", b"\xc3\xa9", b"tw"] and h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4
    r = wordhash.runs(np.concatenate((h, h)), 3)
    assert r[0] == r[6] and len(set(r[:6].tolist())) == 6
    assert len(wordhash.words(b"")[0]) == 0 and len(wordhash.runs(h[:2], 3)) == 0
    long = b" ".join(b"w%d" % i for i in range(400_000))
    assert (wordhash._long(long) == wordhash.words(long)[0]).all()


def test_pipeline(spark, sf_dir, odd_rows):
    from tests.llm.conftest import build

    docs = written(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        seen[name] = (before, docs)
        if stage is not corpus_pipeline.tokens:
            assert docs.columns == names
    before, after = seen["n-gram jaccard join"]
    rows = before.select("doc_id", "text").collect()
    want = brute.components({r.doc_id: [brute.shingles(r.text)] for r in rows})
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(set(want.values()))
    before, after = seen["secret scans"]
    assert before.count() == after.count()
    changed = before.alias("b").join(after.alias("a"), "doc_id").filter("a.text <> b.text").select("doc_id", F.col("b.text").alias("t"), F.col("a.text").alias("u")).collect()
    assert {r.doc_id for r in changed} == {r.doc_id for r in before.collect() if brute.base_spans(r.text)}
    assert all("[SECRET]" in r.u and not brute.base_spans(r.u) for r in changed)
    before, after = seen["mixing to target weights"]
    texts = {r.doc_id: brute.words(r.text) for r in before.collect()}
    for r in after.collect():
        w = brute.words(r.text)
        assert w and len(w) <= len(texts[r.doc_id]) and set(w) <= set(texts[r.doc_id])
    before, after = seen["bpe encoding and decoding"]
    assert after.count() == before.count() and after.filter("not restored").count() == 0

    # odd rows, no rows, and further columns whose names clash with those used inside
    for rows in (odd_rows, []):
        docs = build(spark, rows)
        wide = docs.columns
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
            if stage is corpus_pipeline.language_id:
                texts = {r.text for r in docs.collect()}
                assert texts <= {t for _, t, *_ in rows if any(c.isalpha() for c in t or "")} and (not rows or len(texts) >= 8)
            if stage is corpus_pipeline.near_copies:
                kept = [brute.shingles(r.text) for r in docs.collect()]
                assert not any(brute.jaccard(a, b) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
            if stage is corpus_pipeline.live_secrets:
                assert docs.count() == before.count() and not any(brute.base_spans(r.text) for r in docs.collect())
            if stage is corpus_pipeline.tokens:
                assert docs.count() == before.count() and docs.filter("not restored").count() == 0
            else:
                assert docs.columns == wide


def test_pipeline_keeps_clean_rows_without_or_with_equal_ids(spark, sf_dir):
    from tests.llm.conftest import build, prose

    texts = [prose(800 + k, 90) for k in range(6)]
    secret = " token=mineminemine9"
    rows = [(None, texts[0] + secret, "en", "a"), (None, texts[1] + secret, "en", "a"), (7, texts[2], "en", "a"), (7, texts[3], "en", "a"), (8, texts[4], "en", "a"), (9, texts[4], "en", "a"), (None, texts[5], "en", "a"), (3, texts[5], "en", "a")]
    docs = build(spark, rows)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = corpus_pipeline.near_copies(spark, docs.select(*names), sf_dir)
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(((i, t) for i, t, *_ in rows if t != texts[4] or i == 8 if t != texts[5] or i == 3), key=key)
    docs = written(corpus_pipeline.live_secrets(spark, docs, sf_dir), "secrets")
    out = docs.collect()
    assert len(out) == 6 and sum("[SECRET]" in r.text for r in out) == 2 and not any("mineminemine9" in r.text for r in out)
    mixed = corpus_pipeline.target_weights(spark, docs, sf_dir).collect()
    whole = {(r.doc_id, w) for r in out for w in brute.words(r.text)}
    assert {(r.doc_id, w) for r in mixed for w in brute.words(r.text)} <= whole and sum(r.doc_id is None for r in mixed) >= 2
