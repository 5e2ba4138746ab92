"""Language ID of mixed texts: script ranges narrow the candidates, Viterbi over word scores labels spans.

A word's score under a language is a naive Bayes sum over its hashed byte trigrams and the word itself, learned from
labelled documents. A language that is not written in the word's script is no candidate for it. The best
sequence of languages for a text's words, where every change costs SWITCH, gives the spans.

Defined results: a null text or one without a letter is 'und' with score 0; with nothing learned all texts are
'und'; repeated rows are labelled alike; an empty table gives no rows; lang, source and ids are never inputs of a
prediction; texts are scored whole, however long. Ties go to the language that is first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, byte_class, text_pieces, word_hashes, words_of

#: Cost of a change of language between two words, in nats; buckets of trigrams and of words; a script counts for a
#: language if it has this share of the language's words.
SWITCH, BUCKETS, SCRIPT_SHARE = 14.0, 1 << 16, 0.001
LETTERS = byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])
#: Script of a word by its first byte over 0x7F: UTF-8 lead bytes of the scripts' ranges (fixed values).
SCRIPTS = {"latin": range(0xC3, 0xCA), "greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD4), "armenian_hebrew": range(0xD4, 0xD8), "arabic": range(0xD8, 0xDC), "south_asian": [0xE0], "other_asian": [0xE1], "marks": [0xE2], "kana_han": range(0xE3, 0xEA), "hangul": range(0xEA, 0xEE)}
_SCRIPT = np.zeros(256, dtype=np.int64)
for _i, _r in enumerate(SCRIPTS.values()):
    _SCRIPT[list(_r)] = _i
N_SCRIPTS = len(SCRIPTS)
N_FEATURES = 2 * BUCKETS + N_SCRIPTS


def _features(buf: np.ndarray, offsets: np.ndarray):
    """starts, first word of each row, bucket of each byte's trigram (only those in words count), bucket and script of
    each word."""
    buf = LOWER[buf]
    starts, ends, first = words_of(buf, offsets, LETTERS)
    inside = np.zeros(len(buf) + 1, dtype=np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    clean = np.where(inside, buf, 0x20).astype(np.uint32)
    # words that touch across two rows keep apart: the trigram at a row's edge sees a space
    before = np.concatenate([[0x20], clean[:-1]]).astype(np.uint32)
    after = np.concatenate([clean[1:], [0x20]]).astype(np.uint32)
    before[starts], after[ends - 1] = 0x20, 0x20
    tri = ((before << np.uint32(16) | clean << np.uint32(8) | after) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32)
    words = (word_hashes(buf, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    script = np.zeros(len(starts), dtype=np.int64)
    high = np.flatnonzero((buf >= 0xC3) & inside)
    if len(high) and len(starts):
        w = np.searchsorted(starts, high, side="right") - 1
        w, at = np.unique(w, return_index=True)
        script[w] = _SCRIPT[buf[high[at]]]
    return starts, ends, first, tri, inside, words, script


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Counts of features by language over all labelled documents; what reaches the driver is bounded by languages x
    N_FEATURES. -> {"langs": [...], "logp": float32 (L, 2 * BUCKETS), "allowed": bool (L, scripts)}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        counts = np.zeros((0, N_FEATURES), dtype=np.int64)
        for batch in batches:
            of = np.array([number.setdefault(x, len(number)) for x in batch.column(0).to_pylist()], dtype=np.int64) * N_FEATURES
            counts = np.concatenate([counts, np.zeros((len(number) - len(counts), N_FEATURES), dtype=np.int64)])
            for at, end, buf, offsets in text_pieces(batch.column(1)):
                starts, ends, first, tri, inside, words, script = _features(buf, offsets)
                by_byte, by_word = np.repeat(of[at:end], np.diff(offsets)), np.repeat(of[at:end], np.diff(first))
                f = np.concatenate([by_byte[inside] + tri[inside], by_word + BUCKETS + words, by_word + 2 * BUCKETS + script])
                counts += np.bincount(f, minlength=counts.size).reshape(counts.shape)
        for lang, c in zip(number, counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "f", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    c = np.zeros((len(langs), N_FEATURES))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        c[i, own["f"].to_numpy()] = own["n"].to_numpy()
    logp = np.zeros((len(langs), 2 * BUCKETS), dtype=np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        x = c[:, part] + 0.5
        logp[:, part] = np.log(x / x.sum(axis=1, keepdims=True))
    s = c[:, 2 * BUCKETS :]
    return {"langs": langs, "logp": logp, "allowed": s >= SCRIPT_SHARE * np.maximum(1, s.sum(axis=1, keepdims=True))}


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word (rows) that maximises the sum of scores less switch for every change."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    best = int(total.argmax())
    if n == 0 or k == 1:
        return np.full(n, best)
    # the best language holds throughout if no other gains more over any run of words than one change costs (a path that
    # has the best one has a change for each run without it), and if the best of the others at every word gain no
    # more either (a path without it has one change less than runs)
    ahead = scores.astype(np.float64) - scores[:, best : best + 1]
    gain = np.cumsum(ahead, axis=0)
    low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((1, k)), gain[:-1]]), axis=0), 0)
    if (gain - low).max() <= switch and np.delete(ahead, best, axis=1).max(axis=1).sum() <= switch:
        return np.full(n, best)
    value, back = scores[0].astype(np.float64).tolist(), []
    rows = scores.tolist()
    for i in range(1, n):
        top = max(value)
        at = value.index(top)
        moved = top - switch
        back.append([j if v >= moved else at for j, v in enumerate(value)])
        value = [max(v, moved) + s for v, s in zip(value, rows[i])]
    out = np.zeros(n, dtype=np.int64)
    out[-1] = value.index(max(value))
    for i in range(n - 2, -1, -1):
        out[i] = back[i][out[i + 1]]
    return out


def word_scores(words: np.ndarray, tri_sums: np.ndarray, script: np.ndarray, model: dict) -> np.ndarray:
    """Scores of words (W, L); tri_sums are the words' trigram sums (L, W)."""
    s = (tri_sums + model["logp"][:, BUCKETS + words]).T
    ok = model["allowed"][:, script].T
    ok |= ~ok.any(axis=1, keepdims=True)  # a script that no language has says nothing
    low = np.where(ok, s, np.inf).min(axis=1, keepdims=True)
    return np.where(ok, s, np.minimum(s, low - 10.0)).astype(np.float32)


def label_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score (share of the words that are in spans of lang_pred), spans
    array<struct<lang, first_word, n_words>>; carry: columns of docs that stay on their row, named _0, _1, ..."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x 2 * BUCKETS numbers of 4 bytes

    def run(batches):
        m = shared.value
        langs, logp = m["langs"], m["logp"]
        for batch in batches:
            n = batch.num_rows
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_pylist()
            pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            for at, end, buf, offsets in text_pieces(batch.column(1)) if langs else ():
                starts, ends, first, tri, inside, words, script = _features(buf, offsets)
                if not len(starts):
                    continue
                sums = np.empty((len(langs), len(starts)), dtype=np.float32)
                for i in range(len(langs)):
                    sums[i] = np.add.reduceat(np.where(inside, logp[i, tri], np.float32(0)), starts)
                scores = word_scores(words, sums, script, m)
                for row in range(at, end):
                    a, b = first[row - at], first[row - at + 1]
                    if b == a or not lettered[row]:
                        continue
                    path = best_path(scores[a:b])
                    count = np.bincount(path, minlength=len(langs))
                    top = int(count.argmax())
                    pred[row], score[row] = langs[top], float(count[top] / len(path))
                    edge = np.flatnonzero(np.diff(path, prepend=-1))
                    spans[row] = [{"lang": langs[path[e]], "first_word": int(e), "n_words": int(f - e)} for e, f in zip(edge, [*edge[1:], len(path)])]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
            found = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(found + [batch.column(k) for k in places], ["id", "lang_pred", "score", "spans", *names])

    kinds = dict(docs.dtypes)
    names = [f"_{k}" for k in range(len(carry))]
    # a text that is carried comes to the batch once
    once = [c == text_col and kinds[c] == "string" for c in carry]
    more = [F.col(c).alias(n) for c, n, o in zip(carry, names, once) if not o]
    free = iter(range(2, 2 + len(more)))
    places = [1 if o else next(free) for o in once]
    schema = ", ".join([f"id {kinds[id_col]}, lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>", *[f"{n} {kinds[c]}" for c, n in zip(carry, names)]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5: such documents are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_and_label(docs: DataFrame, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    model = learn(docs.where(~held_out(id_col)))
    return label_languages(docs, model, id_col, carry=carry).withColumn("held_out", held_out(id_col))
