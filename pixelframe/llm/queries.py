"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def op1_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, spans_text

    found = find_pii(table(spark, sf_dir, "documents"))
    digest = F.sha2(spans_text(F.col("base")), 256).alias("base_sha256")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, spans_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_and_label

    found = learn_and_label(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    found = judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined_tokens", " ").alias("mined_rule"))


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    plan = plan_mix(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"].cast("string"), d["shard"].cast("string"))), ",")
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("copies"), shards.alias("shards"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def op10_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import as_calls, link_tools

    return link_tools(*as_calls(table(spark, sf_dir, "conversations"))).withColumn("conv_id", F.col("conv_id").cast("long"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn_and_score

    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_words")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill, restored

    cut_up = infill(table(spark, sf_dir, "documents"))
    return cut_up.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lattice_neardup, op2_pii, op3_license_scan, op4_language_id, op5_url_filter, op6_prefix_forest, op7_byte_bpe, op8_mix_sources, op9_ngram_jaccard, op10_chat_tools, op11_toxicity, op12_infill, op13_whitening)}


_OP1_SQL = """with recursive v as (select vec_id, label, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.id where r.root < l.b),
c as (select id, min(root) component_id from r group by id), k as (select a, count(*) n_links from l group by a)
select vec_id, coalesce(n_links, 0) n_links, component_id, component_id = vec_id kept from embeddings join c on id = vec_id left join k on a = vec_id"""

_OP9_SQL = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as materialized (select doc_id, len(s) n from s), t as materialized (select doc_id, unnest(s) t from s),
i as (select x.doc_id a, y.doc_id b, count(*) c from t x join t y on x.t = y.t and x.doc_id <> y.doc_id group by all),
l as materialized (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(id, root) as (select doc_id, doc_id from documents union select l.b, r.root from r join l on l.a = r.id where r.root < l.b),
c as (select id, min(root) component_id from r group by id)
select n.doc_id, n.n n_shingles, component_id from n join c on id = n.doc_id"""


_OP12_SQL = """with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
n as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from u),
p as (select doc_id, n, form, t, array_to_string(u[1:a], '') pre, array_to_string(u[a+1:b], '') mid, array_to_string(u[b+1:], '') suf from n)
select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lattice_neardup": _OP1_SQL, "op9_ngram_jaccard": _OP9_SQL, "op12_infill": _OP12_SQL}
