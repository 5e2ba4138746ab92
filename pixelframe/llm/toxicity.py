"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's vector is that of the word's bucket plus that of its first letters' bucket, so that unseen forms of a known stem
say something. Filters of a few words weigh each place by itself; wide ones weigh all places alike, and tell how dense a
text is in a kind of words. Each filter's largest response over the whole text enters one logistic unit. Training is plain
numpy on a bounded sample of labelled rows (ROWS and WORDS; rows in order of a hash of their ids and labels, so that reruns
agree). Thresholds are calibrated for each language on held-back training rows; the language is what a naive Bayes
model of the sample's words finds in the text itself, never the column of the row that is scored. The score is the
logistic function of the margin over the language's threshold, moved so that THRESHOLD is where the threshold lies.

Defined results: a null or empty text, and one without letters, gets the score of a text without any word; with no
labels of one of both classes all scores are 0.5; repeated rows score alike; of several labels of one id the highest
counts (over 0 is toxic), null labels do not; texts are scored whole, however long, in chunks that overlap by the widest
filter; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, byte_class, cut, text_pieces, word_hashes, words_of

#: Most labelled rows of a class and most words in all that are learned from.
ROWS, WORDS = 4000, 6_000_000
#: Buckets of words, and as many of beginnings; numbers of a vector; filters of each width; bytes of a beginning.
BUCKETS, DIMS, FILTERS, STEM = 1 << 15, 12, 8, 6
#: Widths whose places have weights of their own, and widths of one weight for all places.
NARROW, WIDE = (1, 2, 3), (12, 40)
WIDEST = max(*NARROW, *WIDE)
THRESHOLD = 0.7
#: Training: texts of a step, steps, rate, share of words left out, share of rows held back for thresholds, texts that
#: must hold a bucket, toxic rows a language needs for a threshold of its own.
BATCH, STEPS, RATE, DROP, BACK, SEEN, ENOUGH, SEED = 48, 800, 0.1, 0.25, 0.25, 3, 8, 11
#: Words of a chunk that is scored at once.
CHUNK = 1 << 15
LETTERS = byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])


def word_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its beginning (behind the words' buckets), and the first word of each row."""
    buf = LOWER[buf]
    starts, ends, first = words_of(buf, offsets, LETTERS)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), first
    word = (word_hashes(buf, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32)
    stem = (word_hashes(buf, starts, np.minimum(ends, starts + STEM)) >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return word, stem + np.int32(BUCKETS), first


class Net:
    """Embeddings (2 * BUCKETS + 1, the last one a blank), filters and the logistic unit, with their gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = lambda *shape: rng.normal(size=shape).astype(np.float32)
        self.p = {"e": size(2 * BUCKETS + 1, DIMS) * np.float32(0.1)}
        self.p["e"][-1] = 0
        for w in NARROW:
            self.p[f"f{w}"] = size(w, DIMS, FILTERS) / np.float32(np.sqrt(w * DIMS))
        for w in WIDE:
            self.p[f"f{w}"] = size(1, DIMS, FILTERS) / np.float32(np.sqrt(DIMS))
        self.n = FILTERS * len((*NARROW, *WIDE))
        self.p["b"] = np.zeros(self.n, np.float32)
        self.p["o"] = size(self.n) * np.float32(0.1)
        self.p["c"] = np.zeros(1, np.float32)
        self.squares = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def vectors(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        return self.p["e"][word] + self.p["e"][stem]

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filter responses at each place of a sequence with WIDEST - 1 blanks behind it; a window may reach into them."""
        n = len(x) - WIDEST + 1
        out = []
        for w in NARROW:
            f = self.p[f"f{w}"]
            out.append(sum(x[j : j + n] @ f[j] for j in range(w)))
        total = np.concatenate([np.zeros((1, DIMS)), np.cumsum(x, axis=0, dtype=np.float64)])
        for w in WIDE:
            mean = (total[w : w + n] - total[:n]) / w
            out.append(mean.astype(np.float32) @ self.p[f"f{w}"][0])
        return np.concatenate(out, axis=1)

    def pooled(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses over each whole text and where they are. Texts stand in one sequence with blanks between
        them; one of more than CHUNK words goes in chunks that overlap by the widest filter."""
        best, at = np.full((len(texts), self.n), -np.inf, np.float32), np.zeros((len(texts), self.n), np.int64)
        blanks, filled, waiting = np.full(WIDEST, 2 * BUCKETS, np.int32), 0, []

        def flush() -> None:
            if not waiting:
                return
            ids = [np.concatenate([part for i, a, b in waiting for part in (texts[i][k][a : b + WIDEST - 1], blanks[: max(0, b + WIDEST - 1 - len(texts[i][k]))])]) for k in (0, 1)]
            r, start = self.responses(self.vectors(*ids)), 0
            for row, a, b in waiting:
                own = r[start : start + b - a]
                k = own.argmax(axis=0)
                top = own[k, np.arange(self.n)]
                at[row], best[row] = np.where(top > best[row], a + k, at[row]), np.maximum(best[row], top)
                start += b - a + WIDEST - 1
            waiting.clear()

        for row, (word, _) in enumerate(texts):
            n = max(len(word), 1)
            for a in range(0, n, CHUNK):
                b = min(n, a + CHUNK)
                if filled + b - a > CHUNK:
                    flush()
                    filled = 0
                waiting.append((row, a, b))
                filled += b - a + WIDEST - 1
        flush()
        return best, at

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.p["b"], 0) @ self.p["o"] + self.p["c"]

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One step of Adagrad on the weighted log loss; gradients pass through the places that max pooling chose."""
        m, at = self.pooled(texts)
        h = np.maximum(m + self.p["b"], 0)
        z = h @ self.p["o"] + self.p["c"]
        g = ((1 / (1 + np.exp(-z)) - labels) * weights / len(texts)).astype(np.float32)
        back = g[:, None] * self.p["o"] * (h > 0)
        grads = {"o": h.T @ g + np.float32(1e-4) * self.p["o"], "c": g.sum(keepdims=True), "b": back.sum(axis=0)}
        blanks = np.full(WIDEST, 2 * BUCKETS, np.int32)
        padded = [(np.concatenate([w, blanks]), np.concatenate([s, blanks])) for w, s in texts]
        rows, moves = [], []
        for i, w in enumerate((*NARROW, *WIDE)):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            place = at[:, own, None] + np.arange(w)
            words = np.stack([p[0][k] for p, k in zip(padded, place)])
            stems = np.stack([p[1][k] for p, k in zip(padded, place)])
            f, b = self.p[f"f{w}"], back[:, own]
            x = self.vectors(words, stems)
            if w in NARROW:
                grads[f"f{w}"] = np.einsum("bk,bkwd->wdk", b, x)
                to = np.einsum("bk,wdk->bkwd", b, f)
            else:
                grads[f"f{w}"] = np.einsum("bk,bkd->dk", b, x.mean(axis=2))[None]
                to = np.broadcast_to((np.einsum("bk,dk->bkd", b, f[0]) / w)[:, :, None], x.shape)
            for ids in (words, stems):
                rows.append(ids.ravel())
                moves.append(to.reshape(-1, DIMS))
        ids, moves = np.concatenate(rows), np.concatenate(moves)
        order = np.argsort(ids, kind="stable")
        ids, first = np.unique(ids[order], return_index=True)
        step = np.add.reduceat(moves[order], first, axis=0)
        ids, step = ids[ids < 2 * BUCKETS], step[ids < 2 * BUCKETS]
        self.squares["e"][ids] += step * step
        self.p["e"][ids] -= rate * step / np.sqrt(self.squares["e"][ids])
        for k, d in grads.items():
            self.squares[k] += d * d
            self.p[k] -= rate * d / np.sqrt(self.squares[k])


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, words: int = WORDS) -> list[dict]:
    """docs: _doc, key (a hash that orders the draw), lang, text; labels: _id, y -> at most rows of each class, and half of words in
    each, in order of key; a text of more words than are left is passed over, none is cut. Equal keys are one row. What
    reaches the driver is bounded by these two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, buf, offsets in text_pieces(batch.column(3)):
                word, stem, first = word_buckets(buf, offsets)
                raw = [np.stack([word[a:b], stem[a:b]]).astype("<i4").tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, end - at) for k in range(3)], pa.array(np.diff(first), pa.int64()), pa.array(raw, pa.binary())], ["key", "y", "lang", "n", "raw"])

    keys = cut(docs.select("_doc", "key").join(labels, F.col("_doc") == F.col("_id")).select("key", "y").distinct())  # no text is sent
    firsts = cut(keys.where("y = 0").orderBy("key").limit(rows).unionByName(keys.where("y = 1").orderBy("key").limit(rows)), keys, rows=2 * rows)
    picked = docs.select("key", "lang", "text").join(F.broadcast(firsts), "key").select("key", "y", "lang", "text")  # 2 * rows keys
    # copies of a row meet before they are sent
    found = cut(picked.mapInArrow(run, "key long, y int, lang string, n long, raw binary").groupBy("key", "y").agg(F.min("lang").alias("lang"), F.min("n").alias("n"), F.min("raw").alias("raw")))
    left, taken = {0: words // 2, 1: words // 2}, []
    for r in sorted(found.select("key", "y", "n").collect(), key=lambda r: r["key"]):  # 2 * rows
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            taken.append(r["key"])
    out = []
    for r in found.where(F.col("key").isin(taken)).collect():
        ids = np.frombuffer(r["raw"], dtype="<i4").reshape(2, -1)
        out.append({"key": r["key"], "y": r["y"], "lang": r["lang"], "word": ids[0], "stem": ids[1]})
    return sorted(out, key=lambda r: (r["key"], r["y"]))


def languages(rows: list[dict]) -> tuple[list[str], np.ndarray]:
    """Names, and log shares of word and beginning buckets by language (2 * BUCKETS + 1, L), smoothed."""
    names = sorted({r["lang"] for r in rows if r["lang"] is not None})
    counts = np.full((2 * BUCKETS + 1, max(len(names), 1)), 0.5, np.float32)
    for r in rows:
        if r["lang"] is not None:
            for ids in (r["word"], r["stem"]):
                np.add.at(counts[:, names.index(r["lang"])], ids, 1)
    return names, np.log(counts / counts.sum(axis=0))


def best_threshold(z: np.ndarray, y: np.ndarray) -> float | None:
    """The middle of the gap between margins where precision (twice its weight) and recall are best together; None without
    a toxic row, or if less than half of what lies above is toxic."""
    if not y.any():
        return None
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f = 1.25 * hit / (n + 0.25 * y.sum())
    f[:-1][z[:-1] == z[1:]] = -1  # equal margins stay together
    k = int(f.argmax())
    if hit[k] / n[k] < 0.5:
        return None
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 0.5)


def fit(rows: list[dict], steps: int = STEPS, seed: int = SEED) -> dict:
    """A model from a sample: net, words' languages and a threshold for each of them."""
    net, rng = Net(seed), np.random.default_rng(seed)
    names, shares = languages(rows)
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return {"net": None, "known": np.zeros(2 * BUCKETS + 1, bool), "names": names, "shares": shares, "thresholds": np.zeros(max(len(names), 1))}
    # a bucket that few texts hold says nothing of its own
    seen = np.zeros(2 * BUCKETS + 1, np.int64)
    for r in rows:
        for ids in (r["word"], r["stem"]):
            seen[np.unique(ids)] += 1
    known = seen >= SEEN
    known[-1] = True
    texts = [tuple(np.where(known[ids], ids, 2 * BUCKETS).astype(np.int32) for ids in (r["word"], r["stem"])) for r in rows]
    held = np.zeros(len(rows), bool)
    for k in (0, 1):  # every so manieth row of a class, in order of keys
        own = np.flatnonzero(y == k)
        held[own[:: max(2, round(1 / BACK))]] = True
    train = np.flatnonzero(~held)
    positive, negative = train[y[train] == 1], train[y[train] == 0]
    if not len(positive) or not len(negative):
        positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # the languages of a class come up alike, so that the words of rare ones are learned too
    own = np.array([names.index(r["lang"]) if r["lang"] is not None else -1 for r in rows])
    odds = [1 / np.bincount(own[k] + 1)[own[k] + 1] for k in (positive, negative)]
    odds = [o / o.sum() for o in odds]
    for step in range(steps):
        half = BATCH // 2
        picked = np.concatenate([rng.choice(positive, half, p=odds[0]), rng.choice(negative, half, p=odds[1])])
        batch = []
        for i in picked:
            gone = rng.random(len(texts[i][0])) < DROP
            batch.append(tuple(np.where(gone, 2 * BUCKETS, ids).astype(np.int32) for ids in texts[i]))
        net.learn(batch, y[picked].astype(np.float32), np.ones(len(picked), np.float32), RATE * (1 - step / steps) + 0.005)
    back = np.flatnonzero(held)
    z = net.logit(net.pooled([texts[i] for i in back])[0])
    lang = np.array([language_of(rows[i]["word"], rows[i]["stem"], shares) for i in back])
    overall = best_threshold(z, y[back])
    overall = 0.0 if overall is None else overall
    thresholds = np.full(max(len(names), 1), overall)
    for k in range(len(names)):
        own = lang == k
        if y[back][own].sum() >= ENOUGH:
            t = best_threshold(z[own], y[back][own])
            thresholds[k] = overall if t is None else t
    return {"net": net, "known": known, "names": names, "shares": shares, "thresholds": thresholds}


def language_of(word: np.ndarray, stem: np.ndarray, shares: np.ndarray) -> int:
    """The language of the highest naive Bayes sum; the first one for a text without words."""
    total = np.zeros(shares.shape[1])
    for a in range(0, len(word), CHUNK):
        total += shares[word[a : a + CHUNK]].sum(axis=0, dtype=np.float64) + shares[stem[a : a + CHUNK]].sum(axis=0, dtype=np.float64)
    return int(total.argmax())


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (rounded to 6 decimals), lang_found, n_words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 64 bytes for each of 2 * BUCKETS buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net, known, shift = m["net"], m["known"], float(np.log(THRESHOLD / (1 - THRESHOLD)))
        for batch in batches:
            score, lang, count = np.full(batch.num_rows, 0.5), [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for at, end, buf, offsets in text_pieces(batch.column(1)):
                word, stem, first = word_buckets(buf, offsets)
                count[at:end] = np.diff(first)
                if net is None:
                    continue
                w, s = (np.where(known[ids], ids, 2 * BUCKETS).astype(np.int32) for ids in (word, stem))
                pooled, _ = net.pooled([(w[a:b], s[a:b]) for a, b in zip(first, first[1:])])
                where = [language_of(word[a:b], stem[a:b], m["shares"]) for a, b in zip(first, first[1:])]
                z = net.logit(pooled).astype(np.float64) - m["thresholds"][where]
                score[at:end] = 1 / (1 + np.exp(-np.clip(z + shift, -30, 30)))
                for i, k in enumerate(where):
                    lang[at + i] = m["names"][k] if m["names"] and first[i + 1] > first[i] else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6)), pa.array(lang, pa.string()), pa.array(count)], ["id", "score", "lang_found", "n_words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, lang_found string, n_words long").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3: such rows' labels are never learned from; nor are those
    of null ids, which have no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted, lang_found, n_words."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_doc"), text.alias("text"), lang.alias("lang"), F.xxhash64(F.col(id_col), text, F.lit(SEED)).alias("key"))
    model = fit(sample(rows, y))
    found = score_texts(docs, model, id_col, text_col)
    return found.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
