"""Chat formatting: tool calls linked with results, ordered, checked against schemas, as canonical JSON.

Calls and results meet by identifier in a hash join on the identifiers; each different result of a call is a link. A call's
place in its conversation follows from its dependencies: it comes after every call whose result it names in its needs.
Arguments (a struct of any fields) are checked against the tool's schema: required fields must be there, and a field that is
there must be of the schema's type and no empty string where it is required; a field that the schema does not know is
wrong unless it is null. The result is one JSON text for each link, with sorted keys, no white space and null for
what is missing.

Defined results: a result without a call, a call without a result, a repeated identifier and a wrong argument
each have a status of their own (see STATUS); null texts are null in JSON; a null identifier counts as '?'; repeated rows are
counted in one row; ties of steps have no order; texts may be of any length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import cut

#: Tools and their arguments: name -> {argument: (type, required)}. Types: those of TYPES.
SCHEMAS = {"reply": {"text": ("string", True), "turn": ("integer", True)}, "continue": {"text": ("string", False), "turn": ("integer", True)}}
TYPES = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.NumericType,),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}
STATUS = ("ok", "no_result", "no_call", "bad_arguments", "unknown_tool", "repeated_id", "cycle")


def json_string(c: Column) -> Column:
    """A JSON string with the escapes that JSON asks for, lower-case hex, or null."""
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        s = F.replace(s, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    s = F.when(c.rlike(r'[\x00-\x1F"\\]'), s).otherwise(c)
    return F.coalesce(F.concat(F.lit('"'), s, F.lit('"')), F.lit("null"))


def json_of(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a value of any type: keys in order, no white space, null for what JSON cannot say."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), json_of(c[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_of(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.cast("string").alias("k"), F.element_at(c, k).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), json_of(e["v"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        return json_string(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), text), null)


def fits_schema(c: Column, kind: T.StructType, fields: dict[str, tuple[str, bool]]) -> Column:
    """Whether the struct c has the fields that the schema requires, each value of its type, and no others."""
    have = {f.name: f.dataType for f in kind.fields}
    good = F.lit(True)
    for name in sorted(set(have) | set(fields)):
        there = c[name].isNotNull() if name in have else F.lit(False)
        if name not in fields:
            good &= ~there
            continue
        want, required = fields[name]
        if name in have and want == "string" and required:
            there &= F.length(c[name].cast("string")) > 0
        typed = name not in have or isinstance(have[name], TYPES[want])
        good &= there if required else F.lit(True)
        good &= F.lit(True) if typed else c[name].isNull()
    return F.coalesce(good, F.lit(False))


#: What a value of JSON is, by the types of the schemas.
VALUES = {"string": "STRING", "integer": "BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL\(.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def fits_json_schema(text: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """Whether JSON text is an object that has the fields that the schema requires, each value of its type, and no others
    but nulls: each row is checked by its own values. False for null and for what is no JSON."""
    v = F.try_parse_json(text)
    whole = F.regexp_like(F.schema_of_variant(v), F.lit("(?s)^OBJECT<.*$"))
    good = F.lit(True)
    for name, (want, required) in fields.items():
        value = F.try_variant_get(v, f'$["{name}"]', "variant")
        there = value.isNotNull() & ~F.is_variant_null(value)
        typed = F.regexp_like(F.schema_of_variant(value), F.lit(f"(?s)^({VALUES[want]})$"))
        if want == "string" and required:
            typed &= F.length(F.try_variant_get(value, "$", "string")) > 0
        good &= F.when(there, typed).otherwise(not required)
    strange = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, x: ~k.isin(*fields) & x.isNotNull())
    return F.coalesce(v.isNotNull() & whole & good & (F.size(strange) == 0), F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON text with keys in order and no white space; what is no JSON as a string."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), json_string(text))


def as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text -> calls and results. A turn that is not the assistant's calls 'reply' with its text, an
    assistant's turn behind another assistant's turn calls 'continue'; the next turn, if it is the assistant's, is the
    result. A call needs the one before it in its conversation, over missing turns too."""
    m = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = m.withColumn("call_id", F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("?"))))
    # the turn before, once for each different turn; a first turn over 0 names the one that is missing
    turns = m.select("conv_id", "turn").distinct().where("turn is not null")
    turns = turns.withColumn("before", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    turns = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.coalesce("before", F.when(F.col("turn") > 0, F.col("turn") - 1)).alias("before"))
    m = m.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = m.select("conv_id", "turn", "call_id", F.when(answer, "continue").otherwise("reply").alias("tool"), F.struct(F.col("text"), F.col("turn")).alias("arguments"), F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.lit(":"), F.col("before").cast("string")).alias("needs"))
    results = m.where(answer & F.col("turn").isNotNull()).select("conv_id", F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.lit(":"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("result"))
    return calls, results


def steps(deps: DataFrame) -> DataFrame:
    """id, needs (one id or null, one row for each; an id that is not there counts as null) -> id, step: 1 + the length
    of the longest chain of needs, null in or behind a cycle. Hops of 1, 2, 4, ... links are made by doubling until no
    chain is that long; then every id takes them from its longest on, each one if a chain so long goes on from where
    it stands. A chain of n needs takes 2 log2(n) joins."""
    ids = cut(deps.select("id").distinct())
    links = deps.where("needs is not null").select("id", F.col("needs").alias("up")).distinct()
    hop = cut(links.join(ids.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    most, far, hops = hop.count(), 1, []
    # more links in a row than there are mean a cycle
    while far <= most and not hop.isEmpty():
        hops.append((far, hop))
        above = hop.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        hop = cut(hop.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up")).distinct())
        far *= 2
    endless = longer = hop.select("id").distinct()
    at = hop.select("id", "up", F.lit(0).cast("long").alias("dist")).limit(0)
    for far, hop in reversed(hops):
        # an id comes in with its longest hop; until then it is in no join
        new = hop.join(longer, "id", "left_anti").select("id", "up", F.lit(far).cast("long").alias("dist"))
        above = hop.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        moved = cut(at.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("dist") + far).alias("dist")).distinct())
        at = cut(at.join(moved.select("id").distinct(), "id", "left_anti").unionByName(moved).unionByName(new))
        longer = hop.select("id").distinct()
    first = ids.join(longer, "id", "left_anti").select("id", F.lit(1).cast("long").alias("step"))
    known = at.select("id", (F.col("dist") + 1).alias("step")).distinct().unionByName(first)
    return known.unionByName(endless.select("id", F.lit(None).cast("long").alias("step")))


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls: conv_id, turn, call_id, tool, arguments (a struct, or JSON text, whose values are checked row by row), needs (an
    identifier or an array of them);
    results: conv_id, call_id, result -> one row for each different call and different result of its identifier, each
    call without a result and each different result without a call: conv_id, call_id, step, tool, status, n_calls (rows
    of this call), n_results (rows of this result), canonical. A call whose identifier other calls have too has
    status repeated_id, and a row for each result of the identifier."""
    several = dict(calls.dtypes)["needs"].startswith("array")
    key = ["conv_id", "turn", "call_id", "tool", "arguments", "needs"]
    calls = calls.groupBy(*key).agg(F.count("*").alias("n_calls")).withColumn("call_id", F.coalesce("call_id", F.lit("?")))
    ids = calls.groupBy("call_id").agg(F.count("*").alias("with_id"))
    results = results.groupBy(F.coalesce("call_id", F.lit("?")).alias("call_id"), "result").agg(F.min("conv_id").alias("_conv"), F.count("*").alias("n_results"))
    order = steps(calls.select(F.col("call_id").alias("id"), (F.explode_outer("needs") if several else F.col("needs")).alias("needs"))).withColumnRenamed("id", "call_id")
    # the side that is hashed has one row for each identifier
    both = results.join(ids.hint("shuffle_hash"), "call_id", "full_outer").join(order.hint("shuffle_hash"), "call_id", "left")
    df = both.join(calls, "call_id", "left").withColumn("conv_id", F.coalesce("conv_id", "_conv")).drop("_conv")
    kind = df.schema["arguments"].dataType
    good, encoded = F.lit(False), isinstance(kind, T.StringType)
    for tool, fields in schemas.items():
        fits = fits_json_schema(F.col("arguments"), fields) if encoded else fits_schema(F.col("arguments"), kind, fields)
        good = F.when(F.col("tool") == tool, fits).otherwise(good)
    status = F.when(F.col("n_calls").isNull(), "no_call").when(F.col("with_id") > 1, "repeated_id").when(~F.col("tool").isin(*schemas), "unknown_tool").when(F.col("step").isNull(), "cycle").when(~good, "bad_arguments").when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    df = df.withColumn("status", status)
    arguments = canonical_json(F.col("arguments")) if encoded else json_of(F.col("arguments"), kind)
    needs = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform("needs", json_string), ","), F.lit("]")), F.lit("null")) if several else json_string(F.col("needs"))
    canonical = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"needs":'), needs, F.lit(',"result":'), json_string(F.col("result")), F.lit(',"status":'), json_string(F.col("status")), F.lit(',"tool":'), json_string(F.col("tool")), F.lit("}"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_calls", "n_results")]
    return df.select("conv_id", "call_id", "step", "tool", "status", *counts, canonical.alias("canonical"))
