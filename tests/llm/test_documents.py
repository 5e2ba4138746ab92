"""Operators over documents against brute force on small tables with nulls, empty and long texts, ties, repeated rows and
clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import bpe, jaccard, langid, licenses, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, langs=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", "y", "z"))
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words="the of and to in that was with this from".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", ".", ","]) for _ in range(n))


ODD = [None, "", " \n\t ", "!!! ... 123", "a", "A b", " 　x", "e" * 5000, "日本語 テキスト", "a\x00b"]


# ------------------------------------------------------------------ n-gram Jaccard join


def brute_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, base, n, share):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(int(share * len(w))):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups_match_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks in a group
    base = prose(rng, 150, [f"w{i}" for i in range(300)])
    texts = ODD + ODD + [prose(rng, rng.randint(1, 12)) for _ in range(40)]
    texts += near_copies(rng, base, 50, 0.02) + near_copies(rng, base, 20, 0.04) + [base, base, base.upper()]
    texts += [base + " " + prose(rng, n, [f"v{i}" for i in range(99)]) for n in (10, 40, 49, 50, 51, 52, 60, 200)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    assert {tuple(r) for r in jaccard.jaccard_groups(frame(spark, [None, ""])).collect()} == {(0, 0, 0), (1, 0, 1)}
    kept = jaccard.keep_one(frame(spark, ["a b c d e f", "a b c d e f", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_divide_skip_counts_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(200)]
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(200), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    for least in (1, 5, 15, 20):
        found, count = jaccard.divide_skip(sets[0], tokens[edge], np.concatenate([edge, [len(tokens)]]), owners, least, 200)
        true = {i: len(np.intersect1d(sets[0], s)) for i, s in enumerate(sets)}
        assert dict(zip(found.tolist(), count.tolist())) == {i: n for i, n in true.items() if n >= least}


# ------------------------------------------------------------------ PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (253) 555-3368", "+12", " ", "é", "𝒳", "_d@e.f", "a@b.c_d@e.f", "9", "(", ")", "-", "\n", "word", "1.2.3.4.5.6.7.8", "%"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["a." * 20000 + "@b.c" + ".d" * 20000, "1 " * 3000, "+1" + "(" * 50000]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in pii.find_pii(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.spans_text(pii.F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].s == ",".join(want), t[:200]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]


def test_a_text_of_very_many_tokens(spark):
    """100,000 tokens, 10,000 addresses among them: time grows with the text, not with its square."""
    text = " ".join(f"user{i}@host.org" if i % 10 == 0 else f"item{i}" for i in range(100_000))
    df = frame(spark, [text, "a@b.c", None])
    began = time.time()
    found = pii.find_pii(df)
    got = {r.doc_id: r for r in found.collect()}
    assert got[0].n_email == 10_000 and got[1].n_email == 1 and got[2].base == []
    assert [text[s.start : s.stop] for s in got[0].base[:2]] == ["user0@host.org", "user10@host.org"]
    clean = {r.doc_id: r.text for r in pii.redact(df, found).collect()}
    assert clean[0] == " ".join("[EMAIL]" if i % 10 == 0 else f"item{i}" for i in range(100_000)) and clean[1] == "[EMAIL]" and clean[2] is None
    assert time.time() - began < 200


def test_addresses_with_zero_octets(spark):
    rng = random.Random(6)
    bits = ["0", "00", "000", "10", "01", "255", "256", "0256", "1", ".", ".", ".", ".", " ", "x"]
    texts = ["10.0.0.1", "127.0.0.1", "192.168.0.5", "1.2.3.0", "0.0.0.0", "00.000.0.010", "0.0.0.256", "at 10.0.0.1, or 1.2.3.00"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(7, 40))) for _ in range(300)]
    rows = pii.find_pii(frame(spark, texts)).select("doc_id", "n_ip", pii.spans_text(pii.F.col("base")).alias("s")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_ip for i in range(8)] == [1, 1, 1, 1, 1, 1, 0, 2]
    assert all(got[i].s == ",".join(brute_spans(t)) for i, t in enumerate(texts))
    clean = pii.redact(frame(spark, texts[:4]), pii.find_pii(frame(spark, texts[:4]))).collect()
    assert {r.text for r in clean} == {"[IP]"}


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"please write to mailbox user{i}@host{i % 7}.example.org for help" for i in range(30)]
    texts += ["please write to mailbox root@localhost for help", "nothing to see on 12th of May", None]
    found = {r.doc_id: r.added for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [(s.kind, texts[30][s.start : s.stop]) for s in found[30]] == [("email", "root@localhost")]
    assert not any(found[i] for i in range(33) if i != 30)
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, texts), pii.find_pii(frame(spark, texts))).collect()}
    assert clean[30] == "please write to mailbox [EMAIL] for help" and clean[31] == texts[31] and clean[32] is None


def test_overlapping_spans_are_redacted_together(spark):
    texts = ["pay 4111 1111 1111 1111@example.com now", "4111 1111 1111 1111.0.2.3 end", "a@b.cd and 1.2.3.4"]
    spans = pii.find_pii(frame(spark, texts))
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, texts), spans).collect()}
    for r in spans.collect():
        text, at, want = texts[r.doc_id], 0, ""
        for s in sorted((*r.base, *r.added), key=lambda s: s.start):
            want += text[at : s.start] + f"[{s.kind.upper()}]" if s.start >= at else ""
            at = max(at, s.stop)
        assert clean[r.doc_id] == want + text[at:]
    assert clean[0] == "pay [CARD] now" and clean[2] == "[EMAIL] and [IP]"


def brute_discovery(texts):
    """Added spans of each text: tokens, patterns and rounds with dictionaries."""
    occ = []
    for i, t in enumerate(texts):
        t = t or ""
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_spans(t))]
        tokens, at, before = [], 0, ""
        for m in re.finditer(pii.TOKEN, t):
            words = re.findall(r"\S+", before + t[at : m.start()])[-2:]
            norm = lambda w: re.sub(r"\s+", " ", re.sub("[0-9]+", "#", w.lower()))
            tail = re.search(r"(\S+\s+\S+)\s*$", before + t[at : m.start()])
            tokens.append((m.start(), m.end(), m[0], norm(words[-1]) if words else None, norm(tail[1]) if tail else None))
            at, before = m.end(), m[0]
        for k, a, b in base:
            own = next(x for x in tokens if x[0] <= a < x[1])
            occ.append((i, k, a, b, t[a:b], own[2][: a - own[0]], own[3], own[4]))
        for a, b, v, one, two in tokens:
            if any(x[1] < b and a < x[2] for x in base):
                continue
            opened = re.match(pii.OPEN, v)
            bare = re.sub(pii.CLOSE, "", re.sub(pii.OPEN, "", v))
            lead = re.match(pii.NAME, bare)
            lead = lead[0] if lead else ""
            a += (len(opened[0]) if opened else 0) + len(lead)
            value = bare[len(lead) :]
            occ.append((i, "secret" if re.match(pii.SEED, value) else "", a, a + len(value), value, lead, one, two))
    rows = []
    for i, k, a, b, v, lead, one, two in occ:
        names = {one and "1:" + one, two and "2:" + two, "in:" + re.sub("[0-9]+", "#", lead.lower()), "as:" + v[:4] if re.match("^[A-Z]{4}[A-Z0-9]{8,}$", v) else None}
        rows += [(i, k, a, b, v, p) for p in names if p and re.search(r"[^\W\d_]", p.split(":", 1)[1])]
    edges = {}
    for i, k, a, b, v, p in rows:
        edges[p, v, k] = edges.get((p, v, k), 0) + 1
    per = {}
    for p, v, k in edges:
        if k:
            per[p, k] = per.get((p, k), 0) + 1
    strong = {x for x, n in per.items() if n >= pii.SUPPORT}
    edges = {x: n for x, n in edges.items() if x[0] in {p for p, _ in strong}}
    seeds = {(v, k): 1.0 for p, v, k in edges if k}
    belief = dict(seeds)
    fits = lambda v, k: re.search(pii.SHAPES[k], v)
    for _ in range(pii.ROUNDS):
        score, total = {}, {}
        for (p, v, _), n in edges.items():
            total[p] = total.get(p, 0) + n
            for (w, k), x in belief.items():
                if w == v:
                    score[p, k] = score.get((p, k), 0) + n * x
        score = {x: y / (total[x[0]] + pii.PRIOR) for x, y in score.items()}
        belief = dict(seeds)
        for p, v, k0 in edges:
            for q, k in score:
                if q == p and k0 == "" and fits(v, k) and v not in {w for w, _ in seeds}:
                    belief[v, k] = max(belief.get((v, k), 0), score[q, k])
    out = {}
    for i, k0, a, b, v, p in rows:
        for q, k in strong:
            if q == p and k0 not in pii.KINDS and fits(v, k) and score.get((p, k), 0) >= pii.LEAST:
                out[i, a, b, v] = max(out.get((i, a, b, v), (0, "")), (score[p, k], k))
    return sorted((i, k, a, b) for (i, a, b, v), (_, k) in out.items())


def test_rounds_match_brute_force(spark):
    rng = random.Random(12)
    hex_ = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    makers = [lambda: f"password={hex_(18)}", lambda: f'token = "{hex_(40)}"', key, lambda: f"mail to {hex_(4)}@h{hex_(2)}.org", lambda: f"mail to {hex_(3)}@local", lambda: f"host: 10.{rng.randrange(300)}.3.{rng.randrange(99)}", lambda: f"code=({rng.randrange(99)})", lambda: f"see [{rng.randrange(10**6)}], (v{rng.randrange(9)}.2)", lambda: f"call +1 (253) 555-{rng.randrange(1000, 9999)}", lambda: f"call {rng.randrange(10**8)}", lambda: "A" * 20]
    texts = ODD + [" ".join(rng.choice(makers)() if rng.random() < 0.3 else prose(rng, 1) for _ in range(rng.randint(1, 25))) for _ in range(120)] + ["w " * 100_000 + makers[0]() + " end"]
    df = frame(spark, texts).withColumnsRenamed({"size": "_id", "n": "_s"})
    rows = pii.find_pii(df).collect()
    got = sorted((r.doc_id, s.kind, s.start, s.stop) for r in rows for s in r.added)
    assert got == brute_discovery(texts)
    found = {(i, texts[i][a:b]) for i, k, a, b in got if k == "secret"}
    for i, t in enumerate(texts):
        for v in re.findall(r'password=([0-9a-f]{18})|"([0-9a-f]{40})"|(AKIA[A-Z0-9]{16})', t or ""):
            assert (i, "".join(v)) in found
    clean = pii.redact(df, pii.find_pii(df))
    assert clean.columns == df.columns and {r._s for r in clean.collect()} == {"z"}


def test_pii_of_nothing(spark):
    assert pii.find_pii(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ licenses


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(9)
    bits = ["Under the MIT License", "apache license, version 2", "CC-BY-NC", "the", "license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "GNU General Public License version 3", "x", "é", "under the mit"]
    texts = ODD + [" ".join(rng.choice(bits) if rng.random() < 0.3 else prose(rng, 3) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    assert licenses.scan_licenses(frame(spark, ["w0 " + " ".join(f"w{i}" for i in range(100))]), templates={"x": [" ".join(f"w{i}" for i in range(100))]}).first().labels == "x"
    long = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t) > 300]
    texts += [prose(rng, 300) + " " + t.upper() + " " + prose(rng, 50) for t in long] + [prose(rng, 100_000) + " " + long[0]] + long + long
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert all(got[len(texts) - 1 - k].labels and got[len(texts) - 1 - k].score == 1 for k in range(len(long)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, labels, more = [], set(), {}
        for p, label in licenses.PHRASES.items():
            p = p.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        said = {n: licenses.words_in(n) for ns in licenses.TEMPLATES.values() for n in ns}
        for run in {licenses.run_of(len(x)) for x in said.values()}:
            for b in range(0, len(w), run):
                block = set(w[b : b + 2 * run])
                met = {(label, n): len(set(said[n]) & block) / len(set(said[n])) for label, ns in licenses.TEMPLATES.items() for n in ns if licenses.run_of(len(said[n])) == run}
                met = {k: v for k, v in met.items() if v >= licenses.THRESHOLD}
                for (label, n), share in met.items():
                    if not any(set(said[n]) < set(said[o]) for _, o in met):
                        more[label] = max(more.get(label, 0), share)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | set(more)))
        assert r.score == pytest.approx(1.0 if labels else max(more.values(), default=0.0))
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ language ID

VOCABULARY = {"en": "the of and to in that was with this from thing other".split(), "fr": "le la de et que dans pour avec une été être où".split(), "ru": "и в не на что быть с как это он".split()}


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(4)
    langs = [rng.choice(list(VOCABULARY)) for _ in range(300)]
    texts = [" ".join(rng.choice(VOCABULARY[x]) for _ in range(rng.randint(5, 60))) for x in langs]
    mixed = " ".join(rng.choice(VOCABULARY["en"]) for _ in range(40)) + " " + " ".join(rng.choice(VOCABULARY["fr"]) for _ in range(60))
    texts, langs = texts + [mixed] + ODD, langs + [None] + [None] * len(ODD)
    got = {r.doc_id: r for r in langid.learn_and_label(frame(spark, texts, langs)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(texts)))
    assert all(got[i].lang_pred == langs[i] for i in range(300))
    assert got[300].lang_pred == "fr" and [s.lang for s in got[300].spans] == ["en", "fr"] and abs(got[300].spans[1].first_word - 40) <= 1
    assert [got[301 + i].lang_pred for i in range(4)] == ["und"] * 4 and got[301].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_viterbi_is_optimal():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, k = int(rng.integers(1, 7)), 3
        s = (rng.normal(size=(n, k)) * 5).round(2)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in np.ndindex(*[k] * n))
        assert value(langid.best_path(s, 4.0).tolist()) == pytest.approx(best)


def test_nothing_learned(spark):
    assert langid.learn_and_label(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in langid.learn_and_label(frame(spark, ["a b"], [None])).collect()] == ["und"]


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    b = bpe.PrefixBpe(path)
    return path, P.PATTERN, b, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_matches_and_round_trips(spark, tokenizer):
    path, pattern, b, enc = tokenizer
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["ab", " the", "ing ", "  ", "\n", " \n ", "é", "日", "'s", "12", "…", "\t"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert got[i].ids == ids and got[i].n_tokens == len(ids) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, texts), path, pattern), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def test_bpe_of_other_patterns_and_long_texts(spark, tokenizer):
    path, pattern, b, enc = tokenizer
    import regex
    import tiktoken

    other = r"\w+ \w+|(?s:.)"
    e2 = tiktoken.Encoding("two", pat_str=other, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["ab cd ef", " x y", prose(rng, 200), "日本 語x y"]
    got = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts), path, other).collect()}
    assert [got[i] for i in range(len(texts))] == [np.array(e2.encode_ordinary(t), "<u4").tobytes() for t in texts]
    texts = [prose(rng, 100_000), "ab" * 100_000, "é " * 50_000 + "\n", " " * 1000, "x\t y \n\n z " * 500]
    got = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        want = [x for m in regex.findall(pattern, t) for x in (b.encode_piece(m.encode()))] if i == 1 else enc.encode_ordinary(t)
        assert got[i] == np.array(want, "<u4").tobytes()


def test_appends_and_edits(tokenizer):
    b, rng = tokenizer[2], random.Random(6)
    for _ in range(200):
        piece = bytes(rng.choice(b"thesingonab") for _ in range(rng.randint(1, 120)))
        table = b.extend(piece, [])
        assert b.ids(table) == b.merged(piece, 1 << 60)
        at = rng.randint(0, len(piece))
        cut, new = rng.randint(0, len(piece) - at), b"ing the"[: rng.randint(0, 7)]
        after, redone = b.edit(piece, table, at, cut, new)
        assert after == piece[:at] + new + piece[at + cut :] and redone == b.extend(after, [])


# ------------------------------------------------------------------ mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(7)
    sources = [rng.choice(["a", "a", "a", "a", "b", "é", None]) for _ in range(600)]
    texts = [None if rng.random() < 0.02 else prose(rng, rng.randint(1, 60)) for _ in sources]
    df = frame(spark, texts, sources=sources)
    rows = mixing.plan_mix(df).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    names = sorted({s for s in sources if s is not None}, key=lambda s: s.encode()) + [None]
    total = {s: sum(z for z, o in zip(sizes, sources) if o == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert (r["size"], r.source_size) == (sizes[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.plan_mix(df.repartition(3)).collect()))
    # shards take disjoint runs of a pass, which together are what the mix takes
    shard_of = {}
    for r in rows:
        for d in r.draws:
            shard_of.setdefault((r.doc_id, d.epoch), set()).add(d.shard)
        assert len({d.epoch for d in r.draws}) == len(r.draws)
    assert all(len(x) == 1 and 0 <= min(x) < 16 for x in shard_of.values())
    per_shard = [sum(sizes[i] for (i, _), x in shard_of.items() if s in x) for s in range(16)]
    assert sum(per_shard) == sum(taken.values()) and max(per_shard) < 3 * sum(per_shard) / 16
    mixed = mixing.mix(df)
    order = [(r.shard, r.doc_id, r.epoch) for r in mixed.collect()]
    assert {(i, e): {s} for s, i, e in order} == shard_of and order != sorted(order)
    assert {"shard", "epoch", "shard_", "epoch_"} <= set(mixing.mix(df.withColumn("shard", F.lit(1)).withColumn("epoch", F.lit("x"))).columns)
    assert set(df.columns) < set(mixed.columns) and mixed.count() == sum(len(r.draws) for r in rows)
    assert mixing.plan_mix(frame(spark, [])).count() == 0


def test_split_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), ("c", 0), ("d", 1)], "skey string, quota long")
    rows = mixing.split_tree(quotas, 8, 3).collect()
    by, per = {}, {}
    for r in rows:
        by[r.skey] = by.get(r.skey, 0) + r.n
        per[r.shard] = per.get(r.shard, 0) + r.n
    assert by == {"a": 100, "b": 37, "c": 0, "d": 1} and len(per) == 8 and max(per.values()) - min(per.values()) <= 1
