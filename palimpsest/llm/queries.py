"""The subpackage's queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, jaccard, langid, licenses, matroska, middle, quality, repeats, sharding, veccodes, warc, wavelet
from palimpsest.llm.common import table
from palimpsest.scratch import stored

SHARDS = 40


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_id_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.measure(table(spark, sf_dir, "documents"))


def op6_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(matroska.mux(table(spark, sf_dir, "documents")), "media")
    return matroska.read_back(media)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(table(spark, sf_dir, "documents"))


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int")))


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page in seekable bundles, read back from them."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text rearranged with its middle last, and restored, by digests of both."""
    return middle.measure(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 16 parts under codebooks of 64 entries."""
    return veccodes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_token_id_wavelet, op3_bpe_round_trip, op4_language_id, op5_suffix_array_dedup, op6_matroska_columns, op7_ngram_jaccard_join, op8_license_scan, op8_license_passages, op9_rendezvous_sharding, op10_pu_quality, op11_warc_bundles, op12_fill_in_middle, op13_vector_codes)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(name: str, view: str, key: str) -> str:
    return f"""
{name}_w as (select {key}, {_WORDS} as w from {view} where text is not null),
{name} as (select distinct {key}, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s, len(w) as n from {name}_w, lateral (select unnest(range(1, greatest(1, len(w) - 4) + 1)) as i) where len(w) > 0)"""


def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    steps = [f"""
kept as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
cut as (select r, vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] as v from kept, (select unnest(range({parts})) as p)),
book0 as (select p, r - 1 as e, v as c from cut where r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as (select r, p, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {entries} + e) as d from cut join book{k} using (p) group by r, p)""")
        if k < rounds:
            steps.append(f"""
mean{k} as (select p, e, list(m order by i) as c from (select p, d % {entries} as e, i, floor(sum(v[i]) / count(*))::bigint as m from near{k} join cut using (r, p), lateral (select unnest(range(1, len(v) + 1)) as i) group by all) group by p, e),
book{k + 1} as (select p, e, coalesce(m.c, b.c) as c from book{k} b left join mean{k} m using (p, e))""")
    return f"""with {",".join(steps)},
coded as (select r, string_agg(printf('%02x', d % {entries}), '' order by p) as code, sum(d // {entries})::bigint as error from near{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
(select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256 from coded join kept using (r)"""


ORACLE_SQL = {
    "op1_benchmark_decontamination": f"""
with {_shingles("items", "benchmark", "item_id")}, {_shingles("docs", "documents", "doc_id")},
size as (select item_id, count(*) as n_item from items group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared, count(*)::double / n_item as containment
from items join docs using (s) join size using (item_id) where items.n >= 5
group by doc_id, item_id, n_item having count(*) >= 0.75 * n_item
union all select doc_id, item_id, 1, 1, 1.0 from (select distinct item_id, s, n from items where n < 5)
join (select distinct doc_id, k as n, array_to_string(w[i : i + k - 1], ' ') as s from docs_w, (select distinct n as k from items where n < 5), lateral (select unnest(range(1, len(w) - k + 2)) as i) where len(w) >= k) using (s, n)""",
    "op7_ngram_jaccard_join": f"""
with recursive {_shingles("docs", "documents", "doc_id")},
size as (select doc_id, count(*) as n from docs group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as i from docs a join docs b using (s) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join size x on a = x.doc_id join size y on b = y.doc_id where 100 * i >= 75 * (x.n + y.n - i)),
reach(a, b) as (select doc_id, doc_id from size union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(size.n, 0) as n_shingles, coalesce(m.low, d.doc_id) as component_id
from documents d left join size on d.doc_id = size.doc_id left join (select a, min(b) as low from reach group by a) m on d.doc_id = m.a""",
    "op8_license_scan": licenses.oracle(),
    "op11_warc_bundles": """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when first <> page_id or (page_id is null and first is not null) then 'revisit' else 'response' end as record_type,
case when first <> page_id or page_id is null then first end as refers_to from q""",
    "op12_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
e as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from e),
g as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from g""",
    "op13_vector_codes": _vector_codes(veccodes.PARTS, veccodes.ENTRIES, veccodes.ROUNDS),
}
