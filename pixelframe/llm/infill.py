"""Fill-in-middle transformation: texts cut into prefix, middle and suffix between units, rearranged under sentinels.

Bytes are handled eight at a time in uint64 words. The bytes that end a unit are marked arithmetically (one bit in each
byte, without carries between bytes), np.bitwise_count counts the marks of a word, a cumulative sum over words is searched
for the word that holds the mark wanted, and that word's lower marks are cleared until it is the lowest. All texts
of a batch share one buffer: a text's units are those behind the marks that stand before its first byte.

Defined results: a null text is empty, an empty text is plain and has no units; a text that holds a sentinel is plain; a
null id is drawn as an empty one; repeated rows give the same rows (draws depend on the id alone); texts are handled
whole, however long; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

U64 = np.uint64
#: One bit of each byte.
HIGH, LOW7, ONES = U64(0x8080808080808080), U64(0x7F7F7F7F7F7F7F7F), U64(0x0101010101010101)
#: Sentinels of the prefix, the suffix and the middle; forms in the order of their draw.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
_CUTS = "n long, prefix_chars long, middle_chars long, output string"


def as_words(buf: np.ndarray) -> np.ndarray:
    """Bytes as little-endian uint64 words, zeros behind the end, and one word more for what lies past it."""
    out = np.zeros((len(buf) // 8 + 1) * 8, dtype=np.uint8)
    out[: len(buf)] = buf
    return out.view("<u8")


def marks_of_byte(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte that equals byte (not zero). Adding 0x7F to the low seven bits sets the high bit unless
    they are all zero, and never carries into the next byte."""
    x = words ^ (ONES * U64(byte))
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def marks_of_starts(words: np.ndarray, size: int) -> np.ndarray:
    """The high bit of each byte that starts a code point: one that is not 10xxxxxx. Bytes from size on have no mark."""
    marks = ~(words & (~words << U64(1))) & HIGH
    marks[size // 8] &= (U64(1) << U64(8 * (size % 8))) - U64(1)
    return marks


class Marks:
    """Counts and places of marks in a buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before each byte position."""
        word, byte = at // 8, (at % 8).astype(U64)
        return self.upto[word] + np.bitwise_count(self.marks[word] & ((U64(1) << (U64(8) * byte)) - U64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th mark, counted from 0; each k must be below the number of marks."""
        word = np.searchsorted(self.upto, k, side="right") - 1
        left, x = k - self.upto[word], self.marks[word].copy()
        for _ in range(7):
            more = left > 0
            x[more] &= x[more] - U64(1)
            left = left - more
        return word * 8 + np.bitwise_count((x & (~x + U64(1))) - U64(1)) // 8


def unit_cuts(buf: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts at offsets of buf, with two draws each: n units, byte positions of the two cuts (modulo n + 1, the
    smaller one first), and the code points of the prefix and of the middle."""
    words = as_words(buf)
    points = Marks(marks_of_starts(words, len(buf)))
    start, stop = offsets[:-1], offsets[1:]
    if unit == "line":
        ends = Marks(marks_of_byte(words, 0x0A))
        seen = ends.before(start)
        closed = ends.before(stop) - seen
        # a text that does not end in a line feed has one more line
        n = closed + ((stop > start) & ((buf[np.maximum(stop - 1, 0)] if len(buf) else np.zeros(len(stop))) != 0x0A))

        def place(k: np.ndarray) -> np.ndarray:
            at = stop.copy()
            at[k == 0] = start[k == 0]
            inner = (k > 0) & (k <= closed)
            at[inner] = ends.select((seen + k - 1)[inner]) + 1
            return at

    elif unit == "char":
        seen = points.before(start)
        n = points.before(stop) - seen

        def place(k: np.ndarray) -> np.ndarray:
            at = stop.copy()
            inner = k < n
            at[inner] = points.select((seen + k)[inner])
            return at

    else:
        raise ValueError(f"no unit {unit}")
    a, b = first % (n + 1), second % (n + 1)
    low, high = place(np.minimum(a, b)), place(np.maximum(a, b))
    return n, low, high, points.before(low) - points.before(start), points.before(high) - points.before(low)


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of seed, colon and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """id, form (plain, psm or spm), n (units), prefix_chars and middle_chars (null if plain), output. Of 100 texts about
    rate are rearranged, and of 100 of these spm go suffix first."""
    pre, suf, mid = (s.encode() for s in sentinels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = draws(F.col(id_col), seed)
    plain = (text == "") | (h[2] % 100 >= rate)
    for s in sentinels:
        plain |= F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4):
            column = batch.column(4).cast(pa.large_string())
            rows = batch.num_rows
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
            buf = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            one, two = (batch.column(k).to_numpy() for k in (2, 3))
            n, low, high, before, between = unit_cuts(buf, offsets, one, two, unit)
            data, forms, out = buf.tobytes(), batch.column(1).to_pylist(), []
            for how, a, p, q, z in zip(forms, *(x.tolist() for x in (offsets[:-1], low, high, offsets[1:]))):
                if how == "plain":
                    out.append(data[a:z])
                elif how == "psm":
                    out.append(b"".join((pre, data[a:p], suf, data[q:z], mid, data[p:q])))
                else:
                    out.append(b"".join((suf, data[q:z], pre, data[a:p], mid, data[p:q])))
            no = np.array([how == "plain" for how in forms], dtype=bool)
            cuts = [pa.array(n, pa.int64()), pa.array(before, pa.int64(), mask=no), pa.array(between, pa.int64(), mask=no)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cuts, pa.array(out, pa.binary()).cast(pa.string())], ["id", "form", "n", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), form.alias("form"), h[0].alias("one"), h[1].alias("two"), text.alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, form string, {_CUTS}").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output of infill. No piece holds a sentinel and none arises where pieces meet, so the three that
    are there tell the pieces apart."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), 4)
    psm, spm = (F.concat(*[F.get(parts, F.lit(k)) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
