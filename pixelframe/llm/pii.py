"""PII by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base: four kinds of identifiers by pattern and check. They are seeds, and so are tokens that look random (a fifth kind,
secret: never a span by its looks alone). Every identifier-like token (one with a digit or @, or a long run of capitals)
is an instance; its lexical patterns are the one and the two words before it with their punctuation, what stands before it
in its own token (password=), and its first four letters if it is a run of capitals and digits. The bipartite
graph of patterns and instances is scored in rounds: a pattern's confidence in a kind is the (smoothed) share of its
occurrences whose instance is believed to be of that kind; an instance's belief is the best of its patterns' confidences.
Patterns of at least LEAST with SUPPORT distinct instances then discover instances that no base pattern knows, if their
shape fits.

Defined results: null texts are empty; texts are scanned whole, and words of any length count (a text of n matches
costs n log n); repeated rows are scanned
alike (and count as often as they stand); a tie of confidences goes to the kind last in the alphabet; overlapping spans of
different kinds all stay; an empty table gives no rows; other columns are ignored, whatever their names. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, fresh

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, written so that no text can make them slow: a run of characters is entered at its start
# only (or where the last match ended), and is never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})|0++)"
#: Kinds that contexts alone find, after the base kinds in order.
MORE = ("secret",)
#: A token with a digit or @, or one of 16 capitals and digits or more; and what a text with any match must hold.
TOKEN = r"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+|[A-Z]{16,}+(?!\S))"
SOME = "[0-9@]|[A-Z]{16}"
#: A random-looking token: letters and digits mixed, no less than 16 characters.
SEED = r"^(?=(?:[^0-9]*[0-9]){2})(?=(?:[^A-Za-z]*[A-Za-z]){2})[A-Za-z0-9+/_-]{16,}={0,2}$"
#: What may open a token (ASCII signs but +), close it (ASCII signs but =), and name a value in it (name=value).
OPEN, CLOSE = r"^[\x00-\x2A\x2C-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x3C\x3E-\x40\x5B-\x60\x7B-\x7F]+$"
NAME = r"^[A-Za-z][A-Za-z0-9_.-]*+[=:][\"']*+(?=.)"
ROUNDS, LEAST, SUPPORT, PRIOR = 3, 0.8, 3, 0.5
#: What an unseen instance of a kind may look like.
SHAPES = {"email": r"^[^@\s]+@[^@\s]+$", "ip": r"^[0-9]{1,5}([.:][0-9]{1,5}){2,7}$", "card": r"^[0-9][0-9-]{6,30}$", "phone": r"^[+(]?[0-9][0-9().-]{5,24}$", "secret": r"^[A-Za-z0-9+/_.-]{12,}={0,2}$"}
_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"
_PIECE = "array<struct<kind:string,k:int,gap:int,value:string,one:string,two:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.try_element_at(F.split(digits, ""), i).cast("int"))

    def weigh(v: Column, i: Column) -> Column:
        twice = v * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.transform(values, weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def pieces(found: Column, gaps: Column, kind: str, words: bool = False) -> Column:
    """The matches in order, each with the length of what stands between it and the one before it, from which positions
    are summed up later: no text is searched by position. words: also the one and the two words before each, looked for
    in that gap and in the match before it. found and gaps are columns of their own, not computed for each match."""

    def piece(x: Column, i: Column) -> Column:
        word = lambda w: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.reverse(w)), "[0-9]+", "#"), r"\s+", " "), F.lit(""))
        back = F.reverse(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), x["gap"]))
        more = [word(F.regexp_extract(back, p, 1)) if words else F.lit(None).cast("string") for p in (r"^\s*+(\S++)", r"^\s*+(\S++\s++\S++)")]
        return F.struct(F.lit(kind).alias("kind"), i.alias("k"), F.length(x["gap"]).alias("gap"), x["m"].alias("value"), more[0].alias("one"), more[1].alias("two"))

    return F.transform(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), piece)


def _text_key(text_col: str) -> Column:
    """With the id it tells rows apart whose ids are null or repeated; rows that share both have the same spans."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, found: each row's matches of the base patterns and its tokens."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), t.alias("t"), _text_key(text_col).alias("text_key"))
    # most texts have nothing that any match must hold
    none = F.array().cast("array<string>")
    for i, pattern in enumerate((*PATTERNS.values(), TOKEN)):
        some = F.col("t").rlike(SOME) & F.col("t").rlike(pattern)
        df = df.withColumns({f"m{i}": F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none), f"g{i}": F.when(some, F.split("t", pattern, -1)).otherwise(none)})
    every = [pieces(F.col(f"m{i}"), F.col(f"g{i}"), k, not k) for i, k in enumerate((*KINDS, ""))]
    return df.select("id", "text_key", F.concat(*every).alias("found"))


def occurrences(scanned: DataFrame) -> DataFrame:
    """id, text_key, rows (how many are alike), kind ('' if unknown), start, stop, value, lead, one, two: the valid base spans,
    each with the token around it, and the tokens that overlap none. Windows run along the matches of one text: a text
    of n matches costs n log n."""
    rows = scanned.where(F.size("found") > 0).groupBy("id", "text_key").agg(F.first("found").alias("found"), F.count("*").alias("rows"))
    each = rows.select("id", "text_key", "rows", F.explode("found").alias("p")).select("id", "text_key", "rows", "p.*")
    text = ("id", "text_key")
    along = W.partitionBy(*text, "kind").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(along).cast("int")).withColumn("start", F.col("stop") - F.length("value"))
    good = F.coalesce(*[F.when(F.col("kind") == k, valid(k, F.col("value"))) for k in KINDS], F.lit(True))
    each = each.where(good).withColumn("base", (F.col("kind") != "").cast("int"))
    # a base span starts in the last token that starts no later; it overlaps a token that ends behind its start and starts
    # before its end
    by_start = W.partitionBy(*text).orderBy("start", "base").rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(F.col("base") == 0, F.struct("start", "value", "one", "two")), ignorenulls=True).over(by_start)
    by_stop = W.partitionBy(*text).orderBy("edge", "base").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("base") == 1, F.col("stop"))).over(by_stop)
    each = each.withColumn("own", own).withColumn("edge", F.when(F.col("base") == 1, F.col("start")).otherwise(F.col("stop"))).withColumn("reach", reach)
    each = each.where((F.col("base") == 1) | (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    base = F.col("base") == 1
    value, start = F.col("value"), F.col("start")
    opened = F.length(F.regexp_extract(value, OPEN, 0))
    bare = F.regexp_replace(value, f"{OPEN}|{CLOSE}", "")
    named = F.regexp_extract(bare, NAME, 0)
    lead = F.when(base, F.substring(F.col("own.value"), F.lit(1), start - F.col("own.start"))).otherwise(named)
    inner = F.when(base, value).otherwise(F.substring(bare, F.length(named) + 1, F.length(bare)))
    each = each.select(*text, "rows", F.when(base, F.col("kind")).when(inner.rlike(SEED), "secret").otherwise("").alias("kind"), F.when(base, start).otherwise(start + opened + F.length(named)).alias("start"), inner.alias("value"), lead.alias("lead"), F.when(base, F.col("own.one")).otherwise(F.col("one")).alias("one"), F.when(base, F.col("own.two")).otherwise(F.col("two")).alias("two"))
    return each.withColumn("stop", F.col("start") + F.length("value"))


def patterns_of(value: Column, lead: Column, one: Column, two: Column) -> Column:
    """The lexical patterns of an occurrence; each holds a letter."""
    names = F.array(
        F.concat(F.lit("1:"), one),
        F.concat(F.lit("2:"), two),
        F.concat(F.lit("in:"), F.regexp_replace(F.lower(lead), "[0-9]+", "#")),
        F.when(value.rlike("^[A-Z]{4}[A-Z0-9]{8,}$"), F.concat(F.lit("as:"), F.substring(value, 1, 4))),
    )
    return F.filter(F.array_distinct(names), lambda p: p.isNotNull() & F.regexp_replace(p, "^[a-z0-9]+:", "").rlike(r"\p{L}"))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """occurrences: id, text_key, rows, kind ('' if unknown), start, stop, value, lead, one, two -> discovered spans id,
    text_key, kind, start, stop, value."""
    occ = occurrences.select("id", "text_key", "rows", "kind", "start", "stop", "value", F.explode(patterns_of(*map(F.col, ("value", "lead", "one", "two")))).alias("pattern"))
    edges = cut(occ.groupBy("pattern", "value", "kind").agg(F.sum("rows").alias("n")))
    count = edges.count()
    # only a pattern with enough seeds of one kind can ever discover anything
    strong = cut(edges.where("kind != ''").groupBy("pattern", "kind").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT), rows=count)
    edges = cut(edges.join(strong.select("pattern").distinct(), "pattern", "left_semi"), edges, rows=count)
    count = edges.count()
    belief = edges.select("value", "kind").distinct().where("kind != ''").select("value", F.col("kind").alias("k"), F.lit(1.0).alias("belief"))
    fits = F.coalesce(*[F.when(F.col("k") == k, F.col("value").rlike(SHAPES[k])) for k in (*KINDS, *MORE)], F.lit(False))
    for _ in range(ROUNDS):
        total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
        score = edges.groupBy("pattern", "value").agg(F.sum("n").alias("n")).join(belief, "value").groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("belief")).alias("b"))
        score = cut(score.join(total, "pattern").select("pattern", "k", (F.col("b") / (F.col("total") + PRIOR)).alias("confidence")), rows=5 * count)
        unknown = edges.where("kind = ''").select("pattern", "value").distinct()
        found = unknown.join(score, "pattern").where(fits).groupBy("value", "k").agg(F.max("confidence").alias("belief"))
        seeds = edges.where("kind != ''").select("value", F.col("kind").alias("k")).distinct().withColumn("belief", F.lit(1.0))
        belief = cut(seeds.unionByName(found.join(seeds.select("value").distinct(), "value", "left_anti")), rows=count)
    sure = score.join(strong.select("pattern", F.col("kind").alias("k")), ["pattern", "k"], "left_semi").where(F.col("confidence") >= LEAST)
    new = occ.where(~F.col("kind").isin(*KINDS)).join(sure, "pattern").where(fits)
    best = new.groupBy("id", "text_key", "start", "stop", "value").agg(F.max(F.struct("confidence", "k")).alias("m"))
    return best.select("id", "text_key", F.col("m.k").alias("kind"), "start", "stop", "value")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base array<span>, added array<span>, text_key: the base spans and those that the patterns discover."""
    rows = cut(scan(docs, id_col, text_col))
    seen = cut(occurrences(rows))
    spans = seen.where(F.col("kind").isin(*KINDS)).select("id", "text_key", F.lit(0).alias("more"), "kind", "start", "stop", "value")
    spans = spans.unionByName(bootstrap(seen).distinct().withColumn("more", F.lit(1)))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, *MORE)) for x in (k, i)])
    span = F.struct("start", F.element_at(rank, F.col("kind")).alias("rank"), "stop", "kind", "value")
    texts = spans.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(*[F.array_sort(F.collect_list(F.when(F.col("more") == i, span))).alias(c) for i, c in enumerate(("base", "added"))])
    out = rows.select("id", "text_key").join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,value:string>>")
    out = out.select("id", "text_key", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, "base", "added", "text_key")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def stretch(blocks: Column, size: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text given as blocks of size code points."""
    part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * size, F.lit(0)) + 1, F.least(b - k * size, size) - F.greatest(a - k * size, F.lit(0)))
    numbers = F.sequence(F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int"))
    return F.when(a < b, F.array_join(F.transform(numbers, part), "")).otherwise("")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are replaced together, by the kind
    of the first one. Rows are found by id and text. A text is cut into blocks of about the root of its length, so that no
    span is looked for from the text's start."""
    names = fresh(docs, "_id", "_key", "_s", "_b", "_z")
    i, k, s_, b_, z = names
    each = found.select(F.col(id_col).alias(i), F.col("text_key").alias(k), F.concat("base", "added").alias("s")).where(F.size("s") > 0).dropDuplicates([i, k])
    each = each.select(i, k, F.explode("s").alias("s")).select(i, k, "s.*")
    along = W.partitionBy(i, k).orderBy("start", "rank", "stop")
    before = F.max("stop").over(along.rowsBetween(W.unboundedPreceding, -1))
    each = each.withColumn("group", F.sum(F.when(F.coalesce(before, F.lit(0)) <= F.col("start"), 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    groups = each.groupBy(i, k, "group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", "rank", "stop")).alias("kind"))
    spans = groups.groupBy(i, k).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias(s_))
    t, size, none = F.col(text_col), F.col(z), F.lit(0)
    out = docs.join(spans, docs[id_col].eqNullSafe(spans[i]) & (_text_key(text_col) == F.col(k)), "left")
    out = out.withColumn(z, F.greatest(F.lit(1024), F.sqrt(F.length(t)).cast("int")))
    out = out.withColumn(b_, F.when(F.col(s_).isNotNull(), F.transform(F.sequence(none, F.floor(F.length(t) / size).cast("int")), lambda n: F.substring(t, n * size + 1, size))))
    piece = lambda s, n: F.concat(stretch(F.col(b_), size, F.when(n > 0, F.get(F.col(s_), n - 1)["stop"]).otherwise(0), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    clean = F.concat(F.array_join(F.transform(F.col(s_), piece), ""), stretch(F.col(b_), size, F.element_at(F.col(s_), -1)["stop"], F.length(t)))
    return out.withColumn(text_col, F.when(F.col(s_).isNotNull(), clean).otherwise(t)).drop(*names)
