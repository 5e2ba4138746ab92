"""Toxicity, fill-in-middle and whitening against brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pixelframe.llm import infill, toxicity, whitening

DOCS = "doc_id long, text string, lang string, form string, n long, id string, word string, x int, _doc int, key int"
ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "é\nü\r\n\n中x", "x <P> y\nz", "<S>", "a<\nP>b\n<", "e" * 3000 + "\n" + "日本\n" * 50, "a\x00b\nc", " a\nb", "<M", ">\n<P\n>\nM>"]


def documents(spark, texts, ids=None, langs=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", "f", 1, "i", "w", 0, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ fill-in-middle


def brute_infill(i, t, unit="line", rate=100, spm=50, seed=7):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return "plain", len(u), None, None, t
    if h4 % 100 < spm:
        return "spm", len(u), len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return "psm", len(u), len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("char", 60, 20)])
def test_infill_matches_brute_force(spark, unit, rate, spm):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "é", "中", "\n", "𝒳", " ", "<", "P", ">"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["long line %d é\n" % k * 20000 for k in range(2)]
    ids = [None, 3, 3] + list(range(10, 7 + len(texts)))
    df = infill.infill(documents(spark, texts, ids), unit=unit, rate=rate, spm=spm)
    got = sorted(map(tuple, df.select("doc_id", "form", "n", "prefix_chars", "middle_chars", "output", infill.restored(df["output"], df["form"])).collect()), key=repr)
    want = sorted(((i, *brute_infill(i, t, unit, rate, spm), t or "") for i, t in zip(ids, texts)), key=repr)
    assert got == want
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill(documents(spark, [])).count() == 0


def test_marks_match_a_loop():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 8, 9, 63, 64, 1000):
        buf = rng.choice(np.frombuffer("a\n\x0bé中\x8a".encode("utf-8") + b"\x8a\x0a\x09", dtype=np.uint8), size)
        words = infill.as_words(buf)
        for marks, want in ((infill.marks_of_byte(words, 10), np.flatnonzero(buf == 10)), (infill.marks_of_starts(words, size), np.flatnonzero((buf & 0xC0) != 0x80))):
            m = infill.Marks(marks)
            assert m.select(np.arange(len(want))).tolist() == want.tolist()
            assert m.before(np.arange(size + 1)).tolist() == [int((want < k).sum()) for k in range(size + 1)]


# ------------------------------------------------------------------ whitening

VEC = "vec_id long, embedding array<float>, label int, id string, x int, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 1, "x", 2, 3) for i, v in rows], VEC)


def brute_whitening(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    dims = max(len(v) for _, v in kept)
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (dims - len(v)) for _, v in kept]
    fit = np.array(sorted(set(map(tuple, x))), dtype=float)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    cov = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [(i, n, sum((n * a - b) ** 2 for a, b in zip(r, s)), (np.array(r) - fit.mean(axis=0)) @ u / np.sqrt(e)) for (i, _), r in zip(kept, x)], e / np.trace(cov)


@pytest.mark.parametrize("dims,seed", [(6, 1), (24, 2)])
def test_whitening_matches_dense_eigenvectors(spark, dims, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(150, dims)) * np.linspace(1, 3, dims)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(200 + i, v[0].tolist()) for i in range(30)] + [(7, v[3].tolist()), (None, v[4].tolist())]
    rows += [(300, None), (301, [None] + [1.0] * (dims - 1)), (302, [float("nan")] * dims), (303, [float("inf")] * dims), (304, v[5].tolist()[:3]), (305, [])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    want, explained = brute_whitening(rows)
    assert len(got) == 4 * len(want)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), []).append(r)
    for i, n, far, w in want:
        own = sorted(by[i, far], key=lambda r: r.component)
        assert {r.n for r in own} == {n} and {r.component for r in own} == {1, 2, 3, 4}
        assert np.allclose(sorted({abs(round(r.whitened, 7)) for r in own}), sorted({abs(round(x, 7)) for x in w}), atol=1e-6)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    signs = {(r.component, np.sign(r.whitened * want[0][3][r.component - 1])) for r in by[want[0][0], want[0][2]]}
    assert len(signs) == 4


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()  # one direction varies
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-9 for r in flat)
    large = whitening.whiten(vectors(spark, [(k, [float(k) * 2**40, 1.0 * k]) for k in range(4)])).collect()
    x = [k * 2**48 for k in range(4)], [k * 256 for k in range(4)]
    assert {(r.vec_id, int(r.deviation)) for r in large} == {(k, sum((4 * c[k] - sum(c)) ** 2 for c in x)) for k in range(4)}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30]), (2, [1.0])])).count()


@pytest.mark.parametrize("case", ["gap", "tied", "wide", "low rank", "small"])
def test_jacobi_davidson_matches_dense(case):
    rng = np.random.default_rng(3)
    d = {"small": 3, "wide": 60}.get(case, 40)
    values = {"gap": np.arange(d, 0, -1.0), "tied": np.repeat([5.0, 4.0, 1.0, 0.5], d // 4), "wide": np.logspace(6, -3, d), "low rank": np.append([3.0, 2.0], np.zeros(d - 2)), "small": np.array([3.0, 1.0, 0.1])}[case]
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    a = (q * values) @ q.T
    e, u = whitening.jacobi_davidson(lambda b: a @ b, d, 4)
    assert np.allclose(e, values[:4], rtol=1e-11, atol=1e-11 * values[0])
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * values[0] and np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-12)


def test_minres_solves():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    a, b = a + a.T, rng.normal(size=(12, 3))
    assert np.allclose(a @ whitening.minres(lambda v: a @ v, b, 40), b, atol=1e-6)
    assert not whitening.minres(lambda v: a @ v, np.zeros((12, 2)), 5).any()


# ------------------------------------------------------------------ toxicity


def talk(rng, words, bad, n, toxic):
    out = [rng.choice(words) + rng.choice(["", "er", "a", "on"]) for _ in range(n)]
    for _ in range(max(2, n // 20) if toxic else 0):
        out.insert(rng.randrange(len(out) + 1), rng.choice(bad))
    return " ".join(out)


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    words = {"en": "the of and to in that was with this from".split(), "fr": "le de et que dans sur pour avec être déjà".split()}
    bad = {"en": ["zurk", "plonko", "vexx"], "fr": ["grôk", "mufle", "tarée"]}
    rows = []
    for i in range(n):
        lang, toxic = rng.choice(["en", "fr"]), int(rng.random() < 0.2)
        rows.append((i, talk(rng, words[lang], bad[lang], rng.randint(5, 120), toxic), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = documents(spark, [r[1] for r in rows], langs=[r[2] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(0, None, None), (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, toxicity.learn_and_score(docs, labels).collect()


def test_toxic_texts_are_found_on_held_out_rows(scored):
    rows, _, _, got = scored
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r.doc_id for r in got if r.held_out} == {r[0] for r in held}
    hit = sum(by[i].predicted and y for i, _, _, y in held)
    assert hit / sum(y for *_, y in held) > 0.9 and hit / sum(by[i].predicted for i, *_ in held) > 0.9
    assert all(r.lang_found == rows[r.doc_id][2] for r in got)


def test_scores_depend_on_text_and_training_labels_only(spark, scored):
    rows, docs, labels, got = scored
    held = toxicity.held_out("doc_id")
    other = labels.where(~held).unionByName(labels.where(held).selectExpr("doc_id", "quality", "1 - toxic toxic"))
    again = toxicity.learn_and_score(docs.repartition(7), other).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got}, abs=2e-6)


def test_odd_texts_and_chunks(spark, monkeypatch):
    rows = corpus(2, 300)
    model = toxicity.fit([{"key": i, "y": y, "lang": lang, **dict(zip(("word", "stem"), toxicity.word_buckets(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))))} for i, t, lang, y in rows], steps=60)
    texts = ODD + [rows[0][1] * 40 + " zurk zurk " + rows[1][1] * 300, rows[0][1]]
    whole = [r.score for r in toxicity.score_texts(documents(spark, texts).coalesce(1), model).collect()]
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    net, best = model["net"], []
    for t in texts:
        word, stem, _ = toxicity.word_buckets(np.frombuffer((t or "").encode(), dtype=np.uint8), np.array([0, len((t or "").encode())]))
        w, s = (np.where(model["known"][x], x, 2 * toxicity.BUCKETS).astype(np.int32) for x in (word, stem))
        best.append((w, s))
    chunked = net.logit(net.pooled(best)[0])
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 20)
    assert np.allclose(net.logit(net.pooled(best)[0]), chunked, atol=1e-4)
    assert whole[0] == whole[1] == whole[2] and all(0 <= s <= 1 for s in whole)


def test_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.learn_and_score(docs, none).collect()] == [(0.5, 0), (0.5, 0)]
    assert toxicity.learn_and_score(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    rows = corpus(3, 200)
    docs = spark.createDataFrame([(r[0], r[0] * 7919 % 1009, r[2], r[1]) for r in rows] * 3, "_doc long, key long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "_id long, y int")
    got = toxicity.sample(docs, labels, rows=20, words=1000)
    assert sum(r["y"] for r in got) <= 20 and len(got) <= 40 and len({r["key"] for r in got}) == len(got)
    for y in (0, 1):
        assert 0 < sum(len(r["word"]) for r in got if r["y"] == y) <= 500
