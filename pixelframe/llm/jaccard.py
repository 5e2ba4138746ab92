"""N-gram Jaccard join of documents by T-occurrence search (DivideSkip), and its groups.

1. signatures: each text's number of distinct word shingles and a fingerprint of the set; texts with equal sets are
   one from here on. A sketch of fixed size counts shingles by hash, and gives the order: the more a cell holds over the
   usual, the later its shingles come.
2. entries: a text's first n - ceil(0.75 n) + k shingles in that order go to inverted lists, k growing with n. Texts
   that link share k of these at least. They are shuffled as packed arrays, lists of frequent shingles in several parts;
   lists of one text end there, and what is left is brought back to its text.
3. blocks: texts with the same smallest list neighbour make a block, a large one is split by hash, and a few texts of each
   part meet in a block of their own. In a block all texts are searched with all by T-occurrence with their whole sets:
   short lists are merged by a heap, long ones are probed by binary search for what the merge leaves.
4. groups so far are joined up by connected components. Only lists that still hold texts of two groups go on: two
   blocks meet if a text in one shares k such entries with texts of other groups in the other. These pairs of blocks
   are searched in the same way. A search gives a spanning forest of the links it found, never pairs by pairs.
5. connected components of all links.

Defined results: a null or empty text has 0 shingles and is its own group; fewer than five words make one shingle;
repeated rows and ids get the same group; a tie of similarity and threshold is a link; an empty table gives no rows; other
columns are ignored; a text is held whole in memory, however long. Hashes have 64 bits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, connected_components, cut, drop, fresh, mix64, parts_for, shingle_sets, small_batches

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT, WIDTH = 75, 5
#: A link needs LEAST shared list entries and one more for each PER shingles; texts and shingles in a block; cells of the
#: sketch and bits of the filter (fixed sizes: as they fill up they order and filter less sharply, but lose nothing).
LEAST, PER, BLOCK, SHINGLES, CELL_BITS, FILTER_BITS = 3, 16, 1000, 400_000, 18, 22
#: Entries in a packed part (of which a task holds one at a time), and those that a task holds before it packs them; parts
#: in a stage at most; weight of a probe against a merge step (fixed value of the DivideSkip rule).
PACKED, HELD, PARTS, PROBE = 400_000, 250_000, 20_000, 0.0085
_SLICES = 16


def need(n, percent: int = PERCENT):
    """Least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def shared(n, percent: int = PERCENT):
    """Entries that a text of n shingles adds to the shortest prefix. Two texts that link share as many entries as the
    smaller of their numbers, which is at least shared(need(n)) for either n."""
    return min(need(n, percent), LEAST + n // PER)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _sum_slices(rows: DataFrame) -> np.ndarray:
    """rows: slice, cells (binary) -> one array of fixed size on the driver, slices added up."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "cells"])

    got = rows.repartition(_SLICES, "slice").mapInArrow(merge, "slice int, cells binary").collect()
    return np.concatenate([np.frombuffer(r["cells"], np.int64) for r in sorted(got, key=lambda r: r["slice"])]) if got else np.zeros(0, np.int64)


def _mark(s: np.ndarray) -> tuple[int, int]:
    """Fingerprint of a set: sum and exclusive or of its hashes."""
    return (s.sum(), np.bitwise_xor.reduce(s * U64(0xC2B2AE3D27D4EB4F))) if len(s) else (U64(0), U64(0))


def _keys(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """One number for both; that sets clash in it only adds candidates."""
    return mix64(f1 + mix64(f2)).view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """id, n, f1, f2 (fingerprint), key for each row of docs (id, text), a cut; and the level of each sketch cell."""
    names = ["id", "n", "f1", "f2", "key", "slice", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros(1 << CELL_BITS, dtype=np.int32), [], 0
        for batch in small_batches(batches, 1):
            n = np.zeros(batch.num_rows, np.int64)
            f = np.zeros((2, batch.num_rows), U64)
            for row, s in shingle_sets(batch.column(1), width):
                n[row] = len(s)
                f[0, row], f[1, row] = _mark(s)
                held.append((s >> U64(64 - CELL_BITS)).astype(np.int32))
                size += len(s)
                if size >= HELD:
                    cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.int32)
                    held, size = [], 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in f), pa.array(_keys(*f)), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if held:
            cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.int32)
        if cells.any():
            parts = [x.tobytes() for x in np.split(cells, _SLICES)]
            none = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    got = cut(docs.mapInArrow(run, "id long, n long, f1 long, f2 long, key long, slice int, cells binary"))
    cells = _sum_slices(got.where("slice is not null").select("slice", "cells"))
    if not len(cells):
        cells = np.zeros(1 << CELL_BITS, np.int64)
    # what stands out of the chance differences between cells is the count of frequent shingles
    usual = float(np.median(cells))
    over = cells - usual
    level = np.where(over > 5 * math.sqrt(usual) + 8, np.log2(np.maximum(over, 1)), 0).astype(np.uint8)
    marks = got.where("slice is null").select("id", "n", "f1", "f2", "key")
    marks.cut_path = got.cut_path
    return marks, level


def _packed(part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, a, b, ...: one row for each part that holds its entries of the columns."""
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    offsets = np.concatenate([edge, [len(part)]])
    out = [pa.array(part[order][edge], pa.int32())]
    for c in columns:
        data = np.ascontiguousarray(c[order])
        out.append(pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((offsets * c.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    yield pa.RecordBatch.from_arrays(out, ["part", *"abc"[: len(columns)]])


def _by_part(batches, *kinds) -> Iterator[list[np.ndarray]]:
    """The columns of one part after another; rows come sorted by part."""
    now, held = None, []
    for batch in batches:
        part = batch.column(0).to_pylist()
        columns = [batch.column(i + 1) for i in range(len(kinds))]
        for row, p in enumerate(part):
            if p != now and held:
                yield [np.concatenate([np.frombuffer(h[i], k) for h in held]) for i, k in enumerate(kinds)]
                held = []
            now = p
            held.append([c[row].as_py() for c in columns])
    if held:
        yield [np.concatenate([np.frombuffer(h[i], k) for h in held]) for i, k in enumerate(kinds)]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(min(parts, PARTS), "part").sortWithinPartitions("part")


def entries(docs: DataFrame, level: np.ndarray, total: int, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """key, label, tokens: each set's entries in inverted lists with two sets or more (in the part of a list that it is
    in), and the smallest neighbour in these (its upper 32 bits)."""
    known = docs.sparkSession.sparkContext.broadcast(level)
    parts = max(parts_for(docs.sparkSession), total // PACKED + 1)

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        best = dict(held)  # sets that are equal are one
        tokens = np.concatenate(list(best.values()))
        keys = np.repeat(np.array(list(best), np.int64), [len(t) for t in best.values()])
        # a list that is likely to be long is in several parts
        expected = 2.0 ** (known.value[(tokens >> U64(64 - CELL_BITS)).astype(np.int64)].astype(np.float64) + 1)
        salts = np.maximum(1, np.minimum(expected / (PACKED / 4), 1 << 20)).astype(np.int64)
        salt = (keys.view(U64) >> U64(20)) % salts.view(U64)
        yield from _packed((mix64(tokens + salt) % U64(parts)).astype(np.int64), tokens, keys)

    def run(batches):
        levels = known.value
        held, size = [], 0
        for batch in small_batches(batches, 1):
            for _, s in shingle_sets(batch.column(1), width):
                if not len(s):
                    continue
                first = len(s) - need(len(s), percent) + shared(len(s), percent)
                lv = levels[(s >> U64(64 - CELL_BITS)).astype(np.int64)]
                t = s[:first] if not lv.any() else s[np.argsort(lv, kind="stable")[:first]]
                f = _mark(s)
                held.append((int(_keys(np.array([f[0]], U64), np.array([f[1]], U64))[0]), t.copy()))
                size += first
                if size >= HELD:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    def lists(batches):
        for t, d in _by_part(batches, U64, np.int64):
            order = np.lexsort((d, t))
            t, d = t[order], d[order]
            new = np.ones(len(t), dtype=bool)  # equal sets of several tasks
            new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
            t, d = t[new], d[new]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            length = np.diff(np.append(first, len(t)))
            low = np.repeat((d[first] >> 32).astype(np.int32), length)
            some = np.repeat(length > 1, length)
            if some.any():
                yield from _packed((d[some].view(U64) % U64(parts)).astype(np.int64), d[some], t[some], low[some])

    def texts(batches):
        for d, t, low in _by_part(batches, np.int64, np.int64, np.int32):
            order = np.argsort(d, kind="stable")
            d, t, low = d[order], t[order], low[order]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            ends = np.append(first, len(d))
            label = np.minimum.reduceat(low, first)
            for a in range(0, len(first), 5000):
                b = min(a + 5000, len(first))
                own = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(t[ends[a] : ends[b]]))
                yield pa.RecordBatch.from_arrays([pa.array(d[first[a:b]]), pa.array(label[a:b]), own], ["key", "label", "tokens"])

    packed = docs.mapInArrow(run, "part int, a binary, b binary")
    back = _dealt(packed, parts).mapInArrow(lists, "part int, a binary, b binary, c binary")
    return _dealt(back, parts).mapInArrow(texts, "key long, label int, tokens array<long>")


# ------------------------------------------------------------------ T-occurrence in a pair of blocks


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def merged(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in sorted lists, and in how many each is: by a heap of the lists' heads. Lists that together are longer
    than there are texts are counted in an array, which gives the same."""
    if sum(map(len, lists)) > n:
        count = np.bincount(np.concatenate(lists), minlength=n)
        found = np.flatnonzero(count)
        return found, count[found]
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    found, count = [], []
    while heap:
        text, i, at = heap[0]
        if found and found[-1] == text:
            count[-1] += 1
        else:
            found.append(text)
            count.append(1)
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heap, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(found, np.int64), np.array(count, np.int64)


def divide_skip(query: np.ndarray, keys: np.ndarray, edges: np.ndarray, owners: np.ndarray, least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold least or more of the query's tokens, and how many. keys: sorted tokens of the index; the list
    of keys[i] is owners[edges[i]:edges[i+1]], sorted. The longest lists are left out of the merge: what
    they alone could complete needs least - their number from the short ones, and is then looked up in them."""
    at = np.searchsorted(keys, query)
    at[at == len(keys)] = 0
    at = at[keys[at] == query]
    if len(at) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = edges[at + 1] - edges[at]
    at = at[np.argsort(length, kind="stable")]
    longest = int(length.max())
    n_long = min(least - 1, int(least / (PROBE * math.log2(longest + 1) * longest / max(1, n) + 1))) if longest > 8 else 0
    short, long = at[: len(at) - n_long], at[len(at) - n_long :]
    found, count = merged([owners[edges[i] : edges[i + 1]] for i in short], n)
    enough = count >= max(1, least - n_long)
    found, count = found[enough], count[enough]
    for k, i in enumerate(long):
        own = owners[edges[i] : edges[i + 1]]
        spot = np.searchsorted(own, found)
        spot[spot == len(own)] = 0
        count = count + (own[spot] == found)
        keep = count >= least - (n_long - k - 1)
        found, count = found[keep], count[keep]
    return found, count


def links_between(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links of texts of the left side with the others (all with all if every text is left)."""
    n, forest, out = len(ids), _Forest(len(ids)), []
    alone = bool(left.all())
    a, b = np.flatnonzero(left), np.arange(n) if alone else np.flatnonzero(~left)
    if not len(a) or not len(b):
        return out
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([sets[i] for i in b])
    owners = np.repeat(b, sizes[b])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    keys, edges = tokens[edge], np.concatenate([edge, [len(tokens)]])
    for x in a.tolist():
        found, count = divide_skip(sets[x], keys, edges, owners, need(int(sizes[x]), percent), n)
        ok = (100 * count >= percent * (sizes[x] + sizes[found] - count)) & ((found < x) if alone else True)
        for y in found[ok].tolist():
            if forest.join(x, y):
                out.append((int(ids[x]), int(ids[y])))
    return out


def verify(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows: t1, t2, id, blk, tokens -> a, b: links, by pairs of blocks."""

    def run(batches):
        def done(held):
            ids = np.array([h[0] for h in held], np.int64)
            return links_between(ids, [np.frombuffer(h[2], U64) for h in held], np.array([h[1] for h in held]), percent)

        now, held, out = None, [], []
        for batch in batches:
            t1, t2, ids, blk, tokens = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if (t1[i], t2[i]) != now:
                    out += done(held) if len(held) > 1 else []
                    now, held = (t1[i], t2[i]), []
                held.append((ids[i], blk[i] == t1[i], tokens[i]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        out += done(held) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = rows.select("t1", "t2", "id", "blk", "tokens").repartition("t1", "t2").sortWithinPartitions("t1", "t2", "id")
    return dealt.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, count: int) -> tuple[DataFrame, list[DataFrame]]:
    """rows (id, n, label) -> id, blk; and where all of these meet: id, blk for each level. A label's texts are split by hash
    so that a block is small in texts and shingles; of each part up to four texts go on to the next level."""
    levels, first = [], None
    for level in range(20):
        k = F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / 4))).cast("int")
        split = rows.groupBy("label").agg(k.alias("k"))
        mine = rows.join(split, "label").select("id", "n", "label", "k", F.xxhash64("label", F.lit(level), F.pmod(F.xxhash64("id", F.lit(level)), F.col("k"))).alias("blk"))
        mine = cut(mine, rows=count)
        levels.append(mine)
        first = first or mine
        large = mine.where("k > 1")
        h = F.xxhash64("id", F.lit(-1 - level))
        ends = [f(F.struct(*x)) for f in (F.min, F.max) for x in (("id", "n"), (h.alias("h"), "id", "n"))]
        picks = large.groupBy("label", "blk").agg(F.array(*[F.struct(e["id"].alias("id"), e["n"].alias("n")) for e in ends]).alias("p"))
        if large.isEmpty():
            break
        was = large.count()
        rows = cut(picks.select("label", F.explode(F.array_distinct("p")).alias("p")).select("p.id", "p.n", "label").distinct(), rows=was)
        count = rows.count()
        if 2 * count > was:
            drop(rows)
            break
    return first, levels


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """signatures (id, n) and links (a, b) that connect every group."""
    docs = _docs(docs, id_col, text_col)
    spark = docs.sparkSession
    marks, level = signatures(docs, width)
    total, count = marks.agg(F.sum(F.col("n") * ((100 - percent) / 100 + 1 / PER) + LEAST), F.count("*")).first()
    stands = cut(marks.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("key").alias("key")), rows=count)
    copies = marks.where("n > 0").join(stands.where("copies > 1"), ["f1", "f2", "n"]).select(F.col("id").alias("a"), F.col("low").alias("b"))

    found = entries(docs, level, int(total or 0), percent, width)
    m = F.expr(f"cast(ceil({percent} * n / 100) as long)")
    least = F.expr(f"least(ceil({percent} * m / 100), {LEAST} + m div {PER})")  # what it shares with any text it links with
    rows = found.join(stands.select(F.col("low").alias("id"), "n", "key"), "key").withColumn("m", m).withColumn("least", least)
    rows = cut(rows.where("size(tokens) >= least").select("id", "n", "label", "least", "tokens"), rows=4 * count)
    count = rows.count()
    first, levels = _blocks(rows.select("id", "n", "label"), count)
    meet = None
    for x in levels:
        with_others = x.join(x.groupBy("blk").agg(F.count("*").alias("c")).where("c > 1").select("blk"), "blk", "left_semi").select("id", "blk")
        meet = with_others if meet is None else meet.unionByName(with_others)
    meet = cut(meet.distinct(), rows=2 * count)
    links = cut(verify(_with_sets(docs, meet.select("id", "blk", F.col("blk").alias("t1"), F.col("blk").alias("t2")), width), percent), meet)
    groups = connected_components(links).select(F.col("id").alias("_id"), "component")

    # what lists still connect: entries of lists with two groups, of texts with enough of them
    rows2 = rows.join(first.select("id", "blk"), "id").join(groups, F.col("id") == F.col("_id"), "left")
    rows2 = cut(rows2.select("id", "n", "least", "blk", F.coalesce("component", "id").alias("grp"), "tokens"), rows, *levels, rows=4 * count)
    each = rows2.select("id", "n", "least", "blk", "grp", F.explode("tokens").alias("token"))
    alive = each.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo != hi").select("token")
    alive = cut(alive)
    still = cut(each.join(alive, "token", "left_semi"), rows2)
    drop(alive)
    enough = still.groupBy("id").agg(F.count("*").alias("c"), F.first("least").alias("l")).where("c >= l").select("id")
    still = cut(still.join(enough, "id", "left_semi"), still)
    if not still.isEmpty():
        by_block = still.groupBy("token", F.col("blk").alias("ob")).agg(F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        near = still.join(by_block, "token").where("blk != ob and (lo != hi or lo != grp)").where(f"{percent} * n <= 100 * hi_n and {percent} * lo_n <= 100 * n")
        near = near.groupBy("id", "blk", "ob", "least").agg(F.count("*").alias("c")).where("c >= least")
        near = cut(near.select("id", "blk", F.least("blk", "ob").alias("t1"), F.greatest("blk", "ob").alias("t2")).distinct(), still)
        links = cut(links.unionByName(verify(_with_sets(docs, near, width), percent)), near, links)
    else:
        drop(still)
    return marks.select("id", "n"), links.unionByName(copies)


def _with_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """rows (with id) and each one's whole set. Most texts that are in no row are left out by a filter of fixed size."""
    got = _filter_slices(rows.select("id")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in got:
        bits[r["slice"] * len(bits) // _SLICES : (r["slice"] + 1) * len(bits) // _SLICES] |= np.frombuffer(r["cells"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** FILTER_BITS bits

    def sets(batches):
        have = known.value
        for batch in small_batches(batches, 1):
            ids = np.array(batch.column(0).fill_null(0), dtype=np.int64)
            at = _bit(ids)
            some = batch.filter(pa.array((have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for _, s in shingle_sets(some.column(1), width)], pa.binary())], ["id", "tokens"])

    return rows.join(docs.mapInArrow(sets, "id long, tokens binary"), "id")


def _bit(ids: np.ndarray) -> np.ndarray:
    return ((ids.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - FILTER_BITS)).astype(np.int64)


def _filter_slices(ids: DataFrame) -> DataFrame:
    """slice, cells: bits of the ids, a row for each slice and group of ids."""

    def run(batches):
        bits, some = np.zeros(1 << FILTER_BITS, dtype=bool), False
        for batch in batches:
            bits[_bit(np.array(batch.column(0), dtype=np.int64))] = True
            some = some or batch.num_rows > 0
        if some:
            parts = np.split(np.packbits(bits, bitorder="little"), _SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "cells"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, np.uint8(0)) | np.frombuffer(x.as_buffer(), np.uint8)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "cells"])

    return ids.mapInArrow(run, "slice int, cells binary").repartition(_SLICES, "slice").mapInArrow(merge, "slice int, cells binary")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """id, n_shingles, component_id: the smallest id that the document reaches by links."""
    marks, links = jaccard_links(docs, id_col, text_col, percent, width)
    groups = connected_components(links)
    out = marks.withColumnRenamed("id", "_id").join(groups, F.col("_id") == F.col("id"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the document with the smallest id, a null id last. Null and repeated ids are documents of their
    own, told apart by their texts; repeated rows of one that stays are reduced to one (the smallest by its
    columns). The joins are on a hash of id and text; where two different documents share one, all their rows are told
    apart by id and text themselves. The decisions are columns of hashes; texts are joined once."""
    key, own, row = fresh(docs, "_key", "_id", "_row")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text))
    # a second hash and the id tell whether a key is one document's only; the rare others get a key of all of them
    proof = F.struct(F.col(id_col).alias("id"), F.xxhash64(text, F.lit(1)).alias("h"), F.length(text).alias("n"))
    proofs = keyed.select(key, proof.alias("p")).groupBy(key).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    shared = cut(proofs.where(~F.col("a").eqNullSafe(F.col("b"))).select(key), rows=1)
    if not shared.isEmpty():
        other = F.xxhash64(F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256))
        twice = keyed.join(shared, key, "left_semi").withColumn(key, other)
        keyed = keyed.join(shared, key, "left_anti").unionByName(twice)
    groups = cut(jaccard_groups(keyed, key, text_col).groupBy(key, "component_id").agg(F.count("*").alias("copies")))
    ids = keyed.select(key, F.col(id_col).alias(own)).distinct()
    first = F.min(F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), F.col(key).alias("key"))).alias("m")
    stay = groups.join(ids, key).groupBy("component_id").agg(first).select(F.col("m.key").alias(key))
    count = groups.count()
    gone = cut(groups.join(stay, key, "left_anti").select(key), rows=count)
    kept = keyed.join(gone, key, "left_anti")
    again = cut(groups.where("copies > 1").join(gone, key, "left_anti").select(key), rows=count)
    if not again.isEmpty():
        one = kept.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(row))
        kept = kept.join(again, key, "left_anti").select(*docs.columns).unionByName(one.select(f"{row}.*"))
    return kept.select(*docs.columns)
