"""Operators over embeddings, pages and conversations, and the pipeline, against brute force."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import ann, chat, neardup, urls

VEC = "vec_id long, embedding array<float>, label int, id string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, "x", 0) for i, v, label in rows], VEC)


ODD = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def clustered(seed, n=260, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.08, 0.3])
        rows.append((i, (v * rng.uniform(0.5, 3)).tolist(), int(rng.integers(3)) if rng.random() < 0.95 else None))
    return rows + [(n + k, v, 1) for k, v in enumerate(ODD)] + [(n + 10 + k, rows[0][1], rows[0][2] or 0) for k in range(4)] + [(n + 20, [1.0, 2.0, 3.0], 1)]


# ------------------------------------------------------------------ near-duplicates


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 3
    p = neardup.decode_e8(x)
    doubled = np.rint(2 * p).astype(int)
    assert np.allclose(doubled, 2 * p) and ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    here = ((x - p) ** 2).sum(axis=1)
    assert len(neardup.ROOTS) == 240 and (((x - p)[:, None] - neardup.ROOTS[None]) ** 2).sum(axis=2).min() >= 0
    assert (here[:, None] <= ((x - p)[:, None] - neardup.ROOTS[None]).__pow__(2).sum(axis=2) + 1e-9).all()


def test_repeated_ids_and_extreme_norms(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, a, 1), (None, a, 1), (None, [0.0, 0.0, 1.0], 1), (3, [None, 1.0, 0.0], 1), (4, a, None), (5, a, 2)]
    df = spark.createDataFrame([(i, v, l, "x", 0) for i, v, l in rows], "vec_id long, embedding array<double>, label int, id string, n long")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 0, 1), (2, 2, 1), (None, 2, 1), (None, 0, None), (3, 0, 3), (4, 0, 4), (5, 0, 5)], key=str)
    far = [(k, [s, 2 * s, 0.1 * s * (k % 2)], 1) for k, s in enumerate((1e200, 1e-200, 3e200, 1.0))]
    df = spark.createDataFrame([(i, v, l, "x", 0) for i, v, l in far], "vec_id long, embedding array<double>, label int, id string, n long")
    assert {(r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(k, 3, 0) for k in range(4)}


@pytest.mark.parametrize("part", [10_000, 7])
def test_links_match_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(neardup, "PART", part)  # cells in one part, and in several
    rows = clustered(3)
    got = {r.vec_id: r for r in neardup.near_duplicates(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    f = [(i, np.array(np.float32(v), dtype=np.float64), label) if usable(v) and label is not None else (i, None, None) for i, v, label in rows]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, v, a) in enumerate(f):
        for j, w, b in f[:k]:
            if v is not None and w is not None and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    true, found = sum(links.values()), sum(r.n_links for r in got.values())
    assert found <= true and found >= 0.99 * true and all(got[i].n_links <= n for i, n in links.items())
    if found == true:
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (links[i], find(i), find(i) == i) for i in links)


def test_no_vectors(spark):
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0
    assert {tuple(r) for r in neardup.near_duplicates(vectors(spark, [(5, None, 1)])).collect()} == {(5, 0, 5, True)}
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 2 == 0).count() == 0


# ------------------------------------------------------------------ nearest neighbours


@pytest.mark.parametrize("shard", [5000, 60])
def test_neighbours_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", shard)
    rows = clustered(4)
    rows += [(1000 + k, rows[10][1], 1) for k in range(30)]  # a group of equal vectors, larger than k
    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    all_v = {i: np.array(np.float32(v), dtype=np.float64) for i, v, _ in rows if usable(v)}
    hit = total = 0
    for q in [i for i in all_v if i % 10 == 0]:
        true = sorted((float(np.sqrt(((all_v[q] - v) ** 2).sum())), i) for i, v in all_v.items() if i != q and len(v) == len(all_v[q]))[:10]
        mine = sorted(got.get(q, []))
        assert [k for k, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(true)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(s == pytest.approx(float(np.sqrt(((all_v[q] - all_v[i]) ** 2).sum())), rel=1e-12) for _, i, s in mine)
        hit, total = hit + len({i for _, i in true} & {i for _, i, _ in mine}), total + len(true)
    assert hit >= 0.9 * total and set(got) == {i for i in all_v if i % 10 == 0 and i != 280}


def test_forest_stops_before_the_root(spark):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(50, 1, 16)) + rng.normal(size=(1, 40, 16)) * 0.02).reshape(-1, 16)
    got = ann.nearest(vectors(spark, [(i, v, 0) for i, v in enumerate(rows.tolist())]), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.examined < 0.5 * len(rows)
    hit = 0
    for q in range(0, 2000, 100):
        d = ((rows.astype(np.float32).astype(np.float64) - rows[q].astype(np.float32)) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 200


def test_near_points_share_prefixes():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 32))
    p = ann.Projections(np.zeros(32), 6.0)
    a, near, far = p.strings(v), p.strings(v + rng.normal(size=v.shape) * 0.02), p.strings(np.roll(v, 1, axis=0))
    for digits in (1, 2, 3):
        shift = 8 * (ann.DIGITS - digits)
        assert (a >> shift == near >> shift).mean() > 3 * (a >> shift == far >> shift).mean() + 0.5
    at, chance = ann.same_digit()
    assert chance[0] == 1 and (np.diff(chance) <= 0).all() and 0.001 < chance[-1] < 0.02


# ------------------------------------------------------------------ URLs

PAGES = [None, "", "no scheme", "https://", "http://X.COM/en/1", "http://example.com/en/1?q=2#x", "http://www.EXAMPLE.com/en/", "http://a.example.com/en/x", "http://a.net/es/1", "ftp://net/fr/", "http://a.net", "http://b.org/en/1", "http://b.org?x://y/en/", "http://badcom/en/", "http://h\n.net/es/"]


def brute_rule(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_mined_rules(spark):
    rng = random.Random(1)
    pages = PAGES + [f"https://{rng.choice(['www.', 'm.', ''])}site{k % 9}.{tld}/{lang}/{k}" for k in range(400) for tld, lang in [(rng.choice(["net", "com", "org"]), rng.choice(["en", "es", "fr", "de"]))]]
    pages += [f"http://m{k}.net/es/offer/{k}" for k in range(40)] + [f"http://m{k}.org/xx/offer/{k}" for k in range(9)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(pages)], "page_id long, url string, host string, rule string")
    rows = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate(pages):
        host, path, rule, verdict = brute_rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    # mined rules by counting every token set of the labelled pages
    seen = df.select("page_id", urls.tokens(*urls.split_url(F.col("url")), F.col("url")).alias("t")).collect()
    labelled = [(set(r.t), rows[r.page_id].verdict) for r in seen if rows[r.page_id].rule]
    for r in rows.values():
        if r.mined_tokens:
            with_all = [v for t, v in labelled if set(r.mined_tokens) <= t]
            assert with_all.count(r.verdict) / len(with_all) == pytest.approx(r.confidence) and r.confidence >= urls.CONFIDENCE
            assert with_all.count(r.verdict) >= urls.SUPPORT * len(labelled)
    offers = [i for i, u in enumerate(pages) if u and "xx/offer" in u]
    assert len(offers) == 9 and all(rows[i].verdict == "block" and rows[i].mined_tokens for i in offers)
    assert urls.judge(df.limit(0)).count() == 0


# ------------------------------------------------------------------ chat


def test_links_and_canonical_json(spark):
    turns = [(1, 0, "user", 'say "hi"\n\\ \x01é'), (1, 1, "assistant", "hi"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "alone"), (3, 1, "user", "later"), (4, 0, None, "who"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (None, None, None, None)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, status string, step int")
    rows = chat.link_tools(*chat.as_calls(df)).collect()
    by = {r.call_id: r for r in rows}
    first = json.loads(by["1:0"].canonical)
    assert first == {"arguments": {"text": turns[0][3], "turn": 0}, "id": "1:0", "needs": None, "result": "hi", "status": "ok", "tool": "reply"}
    assert all(json.dumps(json.loads(r.canonical), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.canonical for r in rows)
    assert by["1:2"].status == "bad_arguments" and by["1:3"].status == "no_result" and by["1:3"].step == 4 and by["3:1"].step == 1
    assert by["4:1"].n_calls == 2 and by["4:0"].n_results == 2
    assert by["2:-1"].status == "no_call" and by["?:?"].status == "bad_arguments"
    assert sum(r.n_calls for r in rows) == len(turns)
    assert chat.link_tools(*chat.as_calls(df.limit(0))).count() == 0


def test_repeated_identifiers_unknown_tools_and_cycles(spark):
    args = "struct<text:string,turn:long>"
    calls = spark.createDataFrame([(1, 0, "a", "reply", ("t", 0), "b"), (1, 1, "b", "reply", ("t", 1), "a"), (1, 2, "c", "nope", ("t", 2), None), (1, 3, "d", "reply", ("t", 3), None), (1, 3, "d", "reply", ("u", 3), "c"), (1, 4, "e", "reply", ("t", 4), "c")], f"conv_id long, turn long, call_id string, tool string, arguments {args}, needs string")
    results = spark.createDataFrame([(1, k, "r") for k in "abcdez"], "conv_id long, call_id string, result string")
    rows = chat.link_tools(calls, results).collect()
    assert sorted((r.call_id, r.status, r.step) for r in rows) == [("a", "cycle", None), ("b", "cycle", None), ("c", "unknown_tool", 1), ("d", "repeated_id", 2), ("d", "repeated_id", 2), ("e", "ok", 2), ("z", "no_call", None)]


def test_every_result_is_linked_and_turns_may_be_missing(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 3, "user", "r"), (2, 7, "assistant", "s"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = [(r.call_id, r.step, r.n_results, json.loads(r.canonical)) for r in chat.link_tools(*chat.as_calls(df)).collect()]
    assert sorted((c, n, j["result"]) for c, _, n, j in rows if c in ("1:0", "?:0")) == [("1:0", 1, "b"), ("1:0", 2, "a"), ("?:0", 1, "y"), ("?:0", 1, "z")]
    assert sorted((c, s, j["needs"]) for c, s, _, j in rows if s and c.startswith("2:")) == [("2:0", 1, None), ("2:3", 2, "2:0"), ("2:7", 3, "2:3")]


def test_steps_follow_every_need(spark):
    rng = random.Random(7)
    edges = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(rng.randint(0, 3))] + [(i, i - 1) for i in range(61, 100)] + [(99, 5), (100, 102), (101, 100), (102, 101), (103, 100), (103, 0), (59, 999)]
    deps = [(str(i), None) for i in range(104)] + [(str(a), str(b)) for a, b in edges]
    want = {}
    for i in range(100):
        want[i] = 1 + max((want[b] for a, b in edges if a == i and b < i), default=0)
    got = {int(r.id): r.step for r in chat.steps(spark.createDataFrame(deps, "id string, needs string")).collect()}
    assert got == want | dict.fromkeys(range(100, 104))
    calls = spark.createDataFrame([(1, k, c, "reply", ("t", k), n) for k, (c, n) in enumerate([("a", None), ("b", ["a"]), ("c", ["a", "b"]), ("d", [])])], "conv_id long, turn long, call_id string, tool string, arguments struct<text:string,turn:long>, needs array<string>")
    rows = chat.link_tools(calls, spark.createDataFrame([], "conv_id long, call_id string, result string")).collect()
    assert sorted((r.call_id, r.step, json.loads(r.canonical)["needs"]) for r in rows) == [("a", 1, None), ("b", 2, ["a"]), ("c", 3, ["a", "b"]), ("d", 1, [])]


SCHEMAS = {"find": {"q": ("string", True), "top": ("integer", False)}, "add": {"a": ("number", True), "b": ("number", True)}}
ARGS = "q string, top long, a double, b double, tags array<string>, o struct<y:int,x:string>"


def brute_links(calls, results):
    """(call_id, step, status, canonical) of calls (conv, turn, id, tool, arguments, needs) and results (conv, id, text)."""
    ids = {c[2] or "?" for c in calls}
    needs = {}
    for c in calls:
        needs.setdefault(c[2] or "?", set()).update(n for n in c[5] or () if n in ids)
    step, going = {}, set()

    def depth(i):
        if i in going:
            return None
        if i not in step:
            going.add(i)
            below = [depth(n) for n in needs[i]]
            going.discard(i)
            step[i] = None if None in below else 1 + max(below, default=0)
        return step[i]

    for _ in range(3):  # what is behind a cycle
        for i in ids:
            depth(i)
    out = []
    kinds = {"string": str, "integer": int, "number": float}
    distinct = {}
    for c in calls:
        distinct.setdefault(json.dumps(c), c)
    with_id = {}
    for c in distinct.values():
        with_id[c[2] or "?"] = with_id.get(c[2] or "?", 0) + 1
    texts = {}
    for _, i, t in results:
        texts.setdefault(i or "?", set()).add(t)
    for c in distinct.values():
        i, tool, args = c[2] or "?", c[3], dict(zip(("q", "top", "a", "b", "tags", "o"), c[4]))
        good = tool in SCHEMAS and all((args[n] not in (None, "") or not need) and isinstance(args[n], (kinds[k], type(None))) for n, (k, need) in SCHEMAS[tool].items()) and all(v is None or n in SCHEMAS[tool] for n, v in args.items())
        for t in texts.get(i, {None: None}) or (None,):
            have = i in texts
            status = "repeated_id" if with_id[i] > 1 else "unknown_tool" if tool not in SCHEMAS else "cycle" if step[i] is None else "bad_arguments" if not good else "ok" if have else "no_result"
            args["o"] = args["o"] and (args["o"] if isinstance(args["o"], dict) else {"y": args["o"][0], "x": args["o"][1]})
            out.append((i, step[i], status, json.dumps({"arguments": args, "id": i, "needs": c[5], "result": t, "status": status, "tool": tool}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    out += [(i, None, "no_call", None) for i in texts if i not in ids for _ in texts[i]]
    return sorted(out, key=str)


def test_links_against_brute_force(spark):
    rng = random.Random(21)
    names = [f"c{i}" for i in range(40)]
    calls = []
    for k in range(90):
        args = (rng.choice([None, "", "x", 'say "hi"\n\\ é']), rng.choice([None, 3]), rng.choice([None, 0.5, -2.25]), rng.choice([None, 1.5]), rng.choice([None, None, ["p", "q"]]), rng.choice([None, None, (1, "z")]))
        calls.append((rng.randrange(4), k, rng.choice(names[:30]) if rng.random() < 0.3 else f"d{k}", rng.choice(["find", "find", "add", "nope"]), args, rng.choice([None, [], [rng.choice(names)], [f"d{rng.randrange(90)}", f"d{rng.randrange(90)}"]])))
    calls += [calls[0], calls[1], (0, 0, None, "find", ("t" * 200_000, None, None, None, None, None), None)]
    results = [(0, rng.choice(names + [f"d{k}" for k in range(90)] + [None]), rng.choice(["r1", "r2", None])) for _ in range(80)]
    c = spark.createDataFrame(calls, f"conv_id long, turn long, call_id string, tool string, arguments struct<{', '.join(x.replace(' ', ':', 1) for x in ARGS.split(', '))}>, needs array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, result string")
    rows = chat.link_tools(c.withColumn("status", F.lit(1)), r.withColumn("step", F.lit("x")), SCHEMAS).collect()
    got = sorted(((x.call_id, x.step, x.status, None if x.status == "no_call" else x.canonical) for x in rows), key=str)
    assert got == brute_links([(*x[:4], list(x[4]), x[5]) for x in calls], results)


def test_wrong_types_are_bad_arguments(spark):
    calls = spark.createDataFrame([(1, 0, "a", "reply", ("t", "not-a-number"), None), (1, 1, "b", "reply", ("t", None), None)], "conv_id long, turn long, call_id string, tool string, arguments struct<text:string,turn:string>, needs string")
    rows = chat.link_tools(calls, spark.createDataFrame([], "conv_id long, call_id string, result string")).collect()
    assert {r.status for r in rows} == {"bad_arguments"}


# ------------------------------------------------------------------ pipeline


def test_pipeline_keeps_null_and_repeated_ids(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    rng = random.Random(4)
    words = "the of and to in that was with this from".split()
    prose = lambda k: " ".join(rng.choice(words) + f"w{k}x{j % 9}" * (j % 2) for j in range(40))
    text = [prose(k) for k in range(40)]
    rows = [(k, text[k], "en", "s1", k) for k in range(40)]
    rows += [(None, prose(50) + " me@host.org", "en", "s1", 0), (None, "to a.b@c.de " + prose(51), "en", "s2", 0), (None, None, "en", "s1", 0)]
    rows += [(3, "123 !!", "en", "s1", 0), (4, prose(52) + " 10.0.0.1", "en", "s1", 0)]  # one id, another text
    rows += [(5, text[5], "en", "s1", 5), (5, text[5], "en", "s2", 5)]  # repeated rows
    rows += [(60, text[6], "en", "s1", 6), (None, text[7], "en", "s1", 7)]  # copies of smaller ids
    rows += [(None, rows[40][1], "en", "s1", 0)]  # a repeated row without an id
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    lettered = [r[:2] for r in rows if r[1] and r[1] != "123 !!"]
    known = C.language_id(spark, docs, "")
    assert pairs(known) == sorted(lettered, key=str) and known.columns == docs.columns
    one = C.near_duplicates(spark, known, "")
    want = sorted(set(lettered) - {(60, text[6]), (None, text[7])}, key=str)
    assert pairs(one) == want and one.columns == docs.columns
    clean = [(i, t.replace("me@host.org", "[EMAIL]").replace("a.b@c.de", "[EMAIL]").replace("10.0.0.1", "[IP]")) for i, t in want]
    assert pairs(C.pii(spark, one, "")) == sorted(clean, key=str)


def test_pipeline_against_its_parts(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    import tiktoken
    import public_tokenizers as P

    from pixelframe.llm.bpe import PrefixBpe

    rng = random.Random(3)
    words = {"en": "the of and to in that was with".split(), "fr": "le la de et que dans pour avec".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(i)]) for _ in range(rng.randint(8, 40))), lang, f"s{i % 4}", 0))
    rows += [(200, rows[5][1], "en", "s1", 0), (201, None, "en", "s1", 0), (202, "123 !!", None, None, 0), (203, "the of and to in write to me@host.org that was with", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0]: r[1] for r in rows}
    assert set(kept[0]) == set(everything) - {201, 202}
    assert set(kept[1]) == set(kept[0]) - {200}
    assert kept[2][203] == "the of and to in write to [EMAIL] that was with" and all(kept[2][i] == everything[i] for i in kept[2] if i != 203)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = PrefixBpe(P.path("byte_bpe_multi_50k.tiktoken")).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in out} == set(kept[3])
    for r in out:
        ids = np.array(enc.encode_ordinary(kept[2][r.doc_id]), dtype="<u4").tobytes()
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(kept[2][r.doc_id].encode()).hexdigest()


def test_pipeline_of_nothing_and_clashing_columns(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    more = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _id string, _key long, shard int, epoch int, id string, score double"
    docs = spark.createDataFrame([], more)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    rng = random.Random(2)
    words = "the of and to in that was with this from".split()
    rows = [(k, " ".join(rng.choice(words) + f"w{rng.randrange(500)}" * (j % 2) for j in range(30)) + " a@b.org", "en", f"s{k % 2}", 9, "p", "i", 5, 6, 7, "j", 0.5) for k in range(30)]
    docs = spark.createDataFrame(rows, more)
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [x.split(" ")[0] for x in more.split(", ")], name
        kept = docs.collect()
        assert kept and {tuple(r)[5:] for r in kept} == {rows[0][5:]}, name
    assert all("[EMAIL]" in r.text for r in kept)


def test_all_control_characters_are_escaped(spark):
    text = "".join(map(chr, range(32))) + '"\\é'
    (row,) = spark.createDataFrame([(text,)], "t string").select(chat.json_string(F.col("t")).alias("j")).collect()
    assert json.loads(row.j) == text


def test_the_bound_of_sources_is_within_the_draws():
    from pixelframe.llm import mixing

    assert mixing.SOURCES * mixing.MOST * mixing.BLOCKS < 10**9
    q = np.full(mixing.SOURCES, int(mixing.MOST * mixing.BLOCKS))
    assert np.random.default_rng(1).multivariate_hypergeometric(q, int(q.sum()) // 2, method="marginals").sum() == q.sum() // 2


SPECS = {"find": {"q": ("string", True), "n": ("integer", False), "near": ("number", False), "deep": ("boolean", False), "tags": ("array", False), "more": ("object", False)}, "stop": {}}


def brute_fits(text, fields):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return False
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    if not isinstance(v, dict) or any(k not in fields and x is not None for k, x in v.items()):
        return False
    for name, (want, required) in fields.items():
        x = v.get(name)
        if x is None:
            if required:
                return False
        elif not isinstance(x, kinds[want]) or (isinstance(x, bool) and want != "boolean") or (want == "string" and required and not x):
            return False
    return True


def test_arguments_as_json_are_checked_by_value(spark):
    rng = random.Random(8)
    values = ['"a"', '""', "1", "1.5", "true", "null", "[1]", '{"b":{"z":1,"a":[]}}', '"\\u0041"']
    texts = [None, "", "{", "[]", "1", "{}", "null", '{"q":"x"}', '{ "q" : "x" , "n" : 3 }', '{"q":"x","zz":null}', '{"q":"x","zz":1}', '{"q":"","n":1}']
    texts += ["{" + ",".join(f'"{k}":{rng.choice(values)}' for k in rng.sample(["q", "n", "near", "deep", "tags", "more", "x y"], rng.randint(0, 5))) + "}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", chat.fits_json_schema(F.col("t"), SPECS["find"]).alias("ok"), chat.canonical_json(F.col("t")).alias("c"))
    for r in df.collect():
        assert r.ok == brute_fits(r.t, SPECS["find"]), r.t
        try:
            assert json.loads(r.c) == json.loads(r.t) and list(json.loads(r.c)) == sorted(json.loads(r.t)) if isinstance(json.loads(r.t), dict) else True
        except (TypeError, ValueError):
            assert json.loads(r.c) == r.t


def test_every_status_is_reached(spark):
    calls = [
        ("c", 0, "a", "find", '{"q":"x"}', None),
        ("c", 1, "b", "find", '{"q":"x"}', "a"),
        ("c", 2, "d", "find", '{"q":7}', "b"),
        ("c", 3, "e", "fly", "{}", None),
        ("c", 4, "f", "stop", "{}", "g"),
        ("c", 5, "g", "stop", "{}", "f"),
        ("c", 6, "h", "stop", "{}", None),
        ("c", 7, "h", "stop", '{"x":null}', None),
    ]
    results = [(r, "c", r + "!") for r in "abdefghz"]
    c = spark.createDataFrame(calls, "conv_id string, turn long, call_id string, tool string, arguments string, needs string")
    r = spark.createDataFrame([x for x in results if x[0] != "b"], "call_id string, conv_id string, result string")
    got = sorted((x.call_id, x.status, x.step) for x in chat.link_tools(c, r, SPECS).collect())
    assert got == [("a", "ok", 1), ("b", "no_result", 2), ("d", "bad_arguments", 3), ("e", "unknown_tool", 1), ("f", "cycle", None), ("g", "cycle", None), ("h", "repeated_id", 1), ("h", "repeated_id", 1), ("z", "no_call", None)]
    assert {s for _, s, _ in got} == set(chat.STATUS)


def test_pipeline_stages_get_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some text ', 500) as text")
    try:
        corpus_pipeline.byte_bpe(spark, docs, "")
        got = docs.mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.b for r in got) < 2 * corpus_pipeline.BATCH
    finally:
        spark.conf.unset(name)
    assert max(r.b for r in docs.mapInArrow(sizes, "n long, b long").collect()) > 2 * corpus_pipeline.BATCH
