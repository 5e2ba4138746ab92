"""Shared helpers: byte-level word splitting and shingles in Arrow batches; cutting lineage and components of links come from
the library's graph operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pixelframe.operators.graph import connected_components, cut, drop, shared_dir  # noqa: F401

U64 = np.uint64
#: Bytes of text that one numpy step handles; a longer text is handled alone.
PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ bytes and words


def byte_class(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return out


#: White space of the word rule [^\x20\x09-\x0D]+ ; all other bytes belong to words (UTF-8 bytes over 0x7F too).
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all bytes over 0x7F.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n-1 of the hash's base, or of its inverse, modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE), _RINV if inverse else _R, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 16 * PIECE:
            _powers[inverse] = have
    return have[:n]


def byte_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of weighted bytes up to each place: a difference of two of them times powers(.., inverse=True) of its start
    is the same for equal bytes wherever they stand."""
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * powers(len(buf)), out=total[1:])
    return total


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets from 0) of an Arrow string column, each about PIECE bytes
    long; nulls are empty texts, texts are never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if len(column) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def small_batches(batches: Iterator[pa.RecordBatch], text: int, size: int = 8 * PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about size bytes of the text column, so that what is made of them stays small; a
    longer text is a slice of its own."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        upto, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, and the number of the first word of each row (n rows + 1)."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = kind[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    first[edges] = inside[edges]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes wherever they stand."""
    total = byte_sums(buf)
    h = (total[ends] - total[starts]) * powers(len(buf) + 1, inverse=True)[starts]
    return mix64(h + (ends - starts).astype(U64))


def hash_word(word: bytes) -> int:
    buf = np.frombuffer(word, dtype=np.uint8)
    return int(word_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(8)], dtype=U64)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its word shingles) for every row; texts with fewer than width words
    give one hash of the whole sequence, texts without words none."""
    for at, end, buf, offsets in text_pieces(column):
        buf = LOWER[buf]
        starts, ends, first = words_of(buf, offsets, NOT_SPACE)
        h = word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, dtype=U64)
        m = len(h) - width + 1
        rolled = np.zeros(max(m, 0), dtype=U64)
        for k in range(width):
            if m > 0:
                rolled += h[k : k + m] * _STEP[k]
        rolled = mix64(rolled)
        for row in range(at, end):
            a, b = int(first[row - at]), int(first[row - at + 1])
            if b - a >= width:
                yield row, np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield row, mix64(np.array([(h[a:b] * _STEP[: b - a]).sum() + U64(b - a)], dtype=U64))
            else:
                yield row, np.zeros(0, dtype=U64)
