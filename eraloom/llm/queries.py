"""Registered queries of the text operators; each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eraloom.llm import ann, bpe, collocations, html_text, langid, licenses, mixture_packing, near_dedup, packing, periodic, pii, toxicity, vector_dedup
from eraloom.llm.common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find(table(spark, sf_dir, "documents"), tails=True)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text, op2_pii, op3_minhash_near_dedup, op4_best_fit_packing, op5_toxicity, op6_permutation_search, op7_language_id,
        op8_license_scan, op9_vector_near_dedup, op10_bpe, op11_mixture_packing, op12_periodic_runs, op13_collocations,
    )
}
# SQL that gives the same rows, where it can be written. Learned models, packing, tokens and approximate search
# are tested against plain versions instead.
ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
),
shingles as (
    select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from words
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from documents union select edges.y, reach.other from reach join edges on edges.x = reach.doc_id),
low as (select doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join low using (doc_id)
""",
    "op13_collocations": r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from words group by 1),
grams as (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as g
    from words, (values (1), (2), (3)) v(k) where len(ws) >= k
),
counts as (select lang, k, g, count(*)::hugeint as f from grams group by 1, 2, 3 having count(*) >= 10),
candidates as (select *, string_split(g, ' ') as ws from counts where k >= 2),
parts as (
    select lang, g, ws, k, f, i, array_to_string(ws[1:i], ' ') as left_part, array_to_string(ws[i + 1:k], ' ') as right_part
    from candidates, (values (1), (2)) j(i) where i < k
),
cuts as (
    select p.lang, p.g, p.f as a, i, l.f as l, r.f as r, (1000000 * p.f * p.f) // (l.f * r.f) as score
    from parts p join counts l on l.lang = p.lang and l.g = left_part join counts r on r.lang = p.lang and r.g = right_part
),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, i) = 1),
held as (
    select lang, g, max(f) as f from (
        select lang, array_to_string(ws[1:2], ' ') as g, f from candidates where k = 3
        union all select lang, array_to_string(ws[2:3], ' '), f from candidates where k = 3
    ) group by 1, 2
),
open as (select lowest.* from lowest left join held using (lang, g) where held.f is null or 100 * held.f < 50 * lowest.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, g) as rank from open)
select lang, rank, g as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
""",
}
