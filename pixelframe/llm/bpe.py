"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can be the last one of the prefix's encoding. It is found from
shorter prefixes: a token that ends the prefix is valid if it may stand behind the last token of what is left. The
table of last tokens is all that an encoding needs: appending bytes extends it, an edit redoes it from the edit on,
and only until it meets the old table again at some distance. The distinct pieces of a batch are done together, one
prefix length after another.

Defined results: null and empty texts give no ids; repeated rows are encoded alike; there are no ties, as a prefix has one
valid last token only; an empty table gives no rows; other columns are ignored; texts may be as long as Arrow's strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import U64, byte_sums, mix64, powers, small_batches

#: Bits of the worker's cache of token pairs; longest piece that is encoded together with others, and how many of them at once.
CACHE_BITS, LONG, TOGETHER = 20, 48, 50_000
#: Bytes of text whose distinct words are encoded together.
TEXTS = 1 << 22
#: Patterns (fixed values) none of whose matches reaches over a single space between two words; with any other, texts are
#: matched whole.
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
_SLOT_BITS = 18


class _Finder:
    """Numbers of known 64-bit hashes: open addressing, at most a quarter full."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(_SLOT_BITS, int(len(hashes)).bit_length() + 2)
        self.hashes, self.slots = hashes, np.full((1 << self.bits) + len(hashes) + 1, -1, dtype=np.int32)
        left, at = np.arange(len(hashes)), (hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 for an unknown one."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        again = np.flatnonzero((got >= 0) & (self.hashes[got] != h))
        while len(again):
            at[again] += 1
            got[again] = self.slots[at[again]]
            again = again[(got[again] >= 0) & (self.hashes[got[again]] != h[again])]
        return got


class PrefixBpe:
    """Encoder and decoder for a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str):
        self.tokens: list[bytes] = []
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.longest = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        #: tokens that encode to themselves; only these can be a last token
        self.sound = {t: r for t, r in self.ranks.items() if len(t) == 1 or len(self.merged(t, r, True)) == 2}
        self._follows = _Follows(self)
        self._bytes = np.array(self.tokens, dtype=object)
        self._tables()

    def _tables(self) -> None:
        """Arrays by rank: a token's length, sum and halves; and what finds tokens by their bytes' hash."""
        n = len(self.tokens)
        self.size = np.fromiter(map(len, self.tokens), np.int64, n)
        buf = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        ends = np.cumsum(self.size)
        total = byte_sums(buf)
        self.value = (total[ends] - total[ends - self.size]) * powers(len(buf) + 1, inverse=True)[ends - self.size]
        self.right, self.left = (np.fromiter((self.halves(r)[k] for r in range(n)), np.int64, n) for k in (1, 0))
        known = np.flatnonzero(self.size)
        self.token_of, self.finder = known, _Finder(mix64(self.value[known] + self.size[known].astype(U64)))
        self.is_sound = np.zeros(n, dtype=bool)
        self.is_sound[list(self.sound.values())] = True
        #: bit k of the mask of three last bytes (by hash): a token of k bytes ends so. One or two bytes: all masks.
        self.masks = np.full(1 << _SLOT_BITS, 6, dtype=U64)
        for r in self.sound.values():
            if self.size[r] > 2:
                self.masks[self._ending(*self.tokens[r][-3:])] |= U64(1 << min(63, int(self.size[r])))
        self.pair, self.kept = np.zeros(1 << CACHE_BITS, dtype=U64), np.zeros(1 << CACHE_BITS, dtype=bool)

    @staticmethod
    def _ending(x, y, z):
        return ((x << 16 | y << 8 | z) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _SLOT_BITS)

    def merged(self, piece: bytes, below: int, whole: bool = False) -> list[int]:
        """Merging by rank, ranks under below only; used for single tokens, which are short. whole: the piece is the token
        below, and what it is merged from is kept as its halves."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best, at = below, -1
            for i in range(len(ids) - 1):
                r = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[i + 1]], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [best]
        if whole:
            self._halves[below] = (ids[0], ids[1]) if len(ids) == 2 else (below, below)
        return ids

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of this token joins; itself twice for a byte or a token that no merges make."""
        got = self._halves.get(token)
        if got is None:
            ids = self.merged(self.tokens[token], token)
            got = self._halves[token] = (ids[0], ids[1]) if len(ids) == 2 else (token, token)
        return got

    def follows(self, left: int, right: int) -> bool:
        """Whether right may stand behind left: undoing their merges from the latest on, no pair at the seam would
        have been merged sooner."""
        a, b, before, ok = left, right, 1 << 62, True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < before:
                ok = False
                break
            ha, hb = self.halves(a)[1], self.halves(b)[0]
            if ha == a and hb == b:
                break
            # the later of the two merges is undone first; among equals the right one, since merges go from the left
            if hb == b or (ha != a and a > b):
                before, a = a, ha
            else:
                before, b = b + 1, hb
        return ok

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last: the last token of each non-empty prefix so far, extended in place to all of piece."""
        get, follows, longest = self.sound.get, self._follows, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                t = get(piece[start:end])
                if t is not None and (not start or follows[last[start - 1] << 32 | t]):
                    last.append(t)
                    break
        return last

    def ids(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a match that is a token is that token
            return [whole]
        return self.ids(self.extend(piece, []))

    def edit(self, piece: bytes, last: list[int], at: int, cut: int, new: bytes) -> tuple[bytes, list[int]]:
        """piece with piece[at:at+cut] replaced by new, and its table: prefixes before the edit are kept, later ones are
        redone until longest + 1 tokens in a row are as before, from where the old table holds."""
        after = piece[:at] + new + piece[at + cut :]
        table, shift, same = last[:at], len(new) - cut, 0
        while len(table) < len(after):
            self.extend(after[: len(table) + 1], table)
            old = len(table) - 1 - shift
            same = same + 1 if old >= at + cut and table[-1] == last[old] else 0
            if same > self.longest:
                table += last[old + 1 :]
        return after, table

    # ------------------------------------------------------------------ many pieces at once

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """follows for arrays."""
        a, b = left.copy(), right.copy()
        ok, before = np.ones(len(a), dtype=bool), np.full(len(a), 1 << 62)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            sizes = self.size[x] + self.size[y]
            joined = self.finder.find(mix64(self.value[x] + self.value[y] * powers(self.longest + 1)[self.size[x]] + sizes.astype(U64)))
            sooner = (joined >= 0) & (self.token_of[joined] < before[live])
            ok[live[sooner]] = False
            hx, hy = self.right[x], self.left[y]
            done = sooner | ((hx == x) & (hy == y))
            first = (hy == y) | ((hx != x) & (x > y))
            a[live], b[live], before[live] = np.where(first, hx, x), np.where(first, y, hy), np.where(first, x, y + 1)
            live = live[~done]
        return ok

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same by way of a cache of fixed size."""
        key = (left.astype(U64) << U64(32)) | right.astype(U64)
        at = (mix64(key) >> U64(64 - CACHE_BITS)).astype(np.int64)
        ok, unknown = self.kept[at], np.flatnonzero(self.pair[at] != key + U64(1))
        if len(unknown):
            new = key[unknown]
            some, where = np.unique(new, return_inverse=True)
            found = self._fits((some >> U64(32)).astype(np.int64), (some & U64(0xFFFFFFFF)).astype(np.int64))
            ok[unknown] = found[where]
            self.pair[at[unknown]], self.kept[at[unknown]] = new + U64(1), ok[unknown]
        return ok

    def tables(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Last tokens (longest size, pieces) of all prefixes of the pieces buf[start:start+size], longest pieces first."""
        total, inverse = byte_sums(buf), powers(len(buf) + 1, inverse=True)
        last = np.zeros((int(sizes[0]), len(sizes)), dtype=np.int32)
        wide = buf.astype(np.int64)
        for end in range(1, len(last) + 1):
            m = int(np.searchsorted(-sizes, -end, side="right"))
            stop = starts[:m] + end
            mask = self.masks[self._ending(wide[stop - 3], wide[stop - 2], wide[stop - 1])] if end > 2 else np.full(m, 6, dtype=U64)
            top = min(end, self.longest)
            for size in range(top, 0, -1):
                bit = U64(1 << min(63, size))
                at = np.flatnonzero(mask & bit)
                if not len(at):
                    continue
                s = stop[at] - size
                token = self.finder.find(mix64((total[stop[at]] - total[s]) * inverse[s] + U64(size)))
                known = token >= 0
                at, token = at[known], self.token_of[token[known]]
                good = self.is_sound[token]
                if size < end:
                    good[good] = self.fits(last[end - size - 1, at[good]].astype(np.int64), token[good])
                at = at[good]
                last[end - 1, at] = token[good]
                mask[at] = 0
        return last

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces behind one another, and where each piece's begin (and the last one's end)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, found = np.zeros(len(pieces), np.int64), []
        alone = sizes > LONG
        for i in np.flatnonzero(alone):
            ids = self.encode_piece(pieces[i])
            counts[i] = len(ids)
            found.append((np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int64)))
        order = np.flatnonzero(~alone)
        order = order[np.argsort(-sizes[order], kind="stable")]
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            n = sizes[some]
            buf = np.frombuffer(b"".join([pieces[i] for i in some]), dtype=np.uint8)
            ends = np.cumsum(n)
            total, inverse = byte_sums(buf), powers(len(buf) + 1, inverse=True)
            whole = self.finder.find(mix64((total[ends] - total[ends - n]) * inverse[ends - n] + n.astype(U64)))
            own = whole >= 0  # a match that is a token is that token
            found.append((some[own], np.zeros(own.sum(), np.int64), self.token_of[whole[own]]))
            counts[some[own]] = 1
            rest = np.flatnonzero(~own)
            if not len(rest):
                continue
            last = self.tables(buf, (ends - n)[rest], n[rest])
            at, live, back = n[rest].copy(), np.arange(len(rest)), 0
            taken = []
            while len(live):
                token = last[at[live] - 1, live].astype(np.int64)
                taken.append((live, np.full(len(live), back), token))
                at[live] -= self.size[token]
                live, back = live[at[live] > 0], back + 1
            who, place, token = (np.concatenate(x) for x in zip(*taken))
            many = np.bincount(who, minlength=len(rest))
            counts[some[rest]] = many
            found.append((some[rest][who], many[who] - 1 - place, token))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(offsets[-1], dtype="<u4")
        for who, place, token in found:
            ids[offsets[who] + place] = token
        return ids, offsets

    def decode(self, ids) -> bytes:
        return b"".join(self._bytes[np.asarray(ids, dtype=np.int64)].tolist())


class _Follows(dict):
    """left << 32 | right -> whether right may stand behind left."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >> CACHE_BITS:
            self.clear()
        self[pair] = ok = self.bpe.follows(pair >> 32, pair & 0xFFFFFFFF)
        return ok


_workers: dict[str, PrefixBpe] = {}


def _worker(path: str) -> PrefixBpe:
    if path not in _workers:
        _workers[path] = PrefixBpe(path)
    return _workers[path]


def _gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[offsets[c]:offsets[c + 1]] of all codes behind one another, and where each begins."""
    count = np.diff(offsets)[codes]
    upto = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(offsets[codes] - upto[:-1], count) + np.arange(upto[-1])], upto


def _encode_strings(bpe: PrefixBpe, strings: list[str], findall) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all strings behind one another, and where each string's begin. Distinct matches are encoded once."""
    matches = [findall(s) for s in strings]
    coded = pa.array([m for found in matches for m in found], pa.large_string()).dictionary_encode()
    ids, offsets = bpe.encode_pieces(coded.dictionary.cast(pa.large_binary()).to_pylist())
    flat, upto = _gather(ids, offsets, np.asarray(coded.indices).astype(np.int64))
    return flat, upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))])]


def encode_texts(bpe: PrefixBpe, column: pa.Array, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text, each match of the pattern by itself. Where no match reaches over a single space from one word
    to the next, a text is a row of words (each with the space before it), and each distinct word of the batch is
    matched and encoded once; texts with other white space beside a space are matched whole."""
    import regex

    findall = regex.compile(pattern).findall
    column = column.cast(pa.large_string()).fill_null("")
    if pattern not in WORD_PATTERNS:
        flat, upto = _encode_strings(bpe, column.to_pylist(), findall)
        yield from (flat[a:b] for a, b in zip(upto[:-1], upto[1:]))
        return
    parts = pc.split_pattern(column, " ")
    first = np.asarray(parts.offsets).astype(np.int64)
    coded = parts.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
    codes, words, first = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), first - first[0]
    starts, n = first[:-1], len(words)
    behind = np.ones(len(codes), dtype=bool)
    behind[starts] = False
    before_space = ~behind & np.repeat(np.diff(first) > 1, np.diff(first))
    odd = np.fromiter((not w or w != w.strip() for w in words), bool, n)
    ends_odd = odd & np.fromiter((w[-1:].isspace() for w in words), bool, n)
    whole = np.add.reduceat((behind & odd[codes]) | (before_space & ends_odd[codes]), starts) > 0
    # strings: words behind a space, words that begin a text, whole texts
    codes[~behind] += n
    kept = ~np.repeat(whole, np.diff(first))
    use = np.zeros(2 * n, dtype=bool)
    use[codes[kept]] = True
    strings = [" " + words[i] for i in np.flatnonzero(use[:n])] + [words[i] for i in np.flatnonzero(use[n:])]
    texts = np.flatnonzero(whole)
    flat, upto = _encode_strings(bpe, strings + column.take(pa.array(texts)).to_pylist(), findall)
    # a text that is matched whole is one string
    kept[starts[texts]] = True
    codes = (np.cumsum(use) - 1)[codes]
    codes[starts[texts]] = len(strings) + np.arange(len(texts))
    first = np.concatenate([[0], np.cumsum(kept)])[first]
    flat, upto = _gather(flat, upto, codes[kept])
    yield from (flat[a:b] for a, b in zip(upto[first[:-1]], upto[first[1:]]))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id, ids (little-endian 32-bit integers in binary; only if keep_ids), n_tokens, ids_sha256, decoded_sha256.

    Every match of pattern (which has no groups) is encoded by itself; the ids are decoded again and hashed. No shuffle: one
    pass of Arrow batches, whose memory is one batch and the bounded cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = _worker(path), hashlib.sha256
        for batch in small_batches(batches, 1, TEXTS):
            n, ids_of, a, b = [], [], [], []
            for ids in encode_texts(bpe, batch.column(1), pattern):
                n.append(len(ids))
                a.append(sha(ids.tobytes()).hexdigest())
                b.append(sha(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    ids_of.append(ids.tobytes())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids_of, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the bytes of the ids, read as UTF-8."""

    def run(batches):
        bpe = _worker(path)
        for batch in batches:
            texts = [None if x.as_py() is None else bpe.decode(np.frombuffer(x.as_py(), dtype="<u4")).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
