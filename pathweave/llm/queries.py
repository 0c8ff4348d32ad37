"""The operators of this subpackage as queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import embedding_dedup, fill_in_middle, jaccard, mixing, packing, periodic_runs, personal_data, quality, repeats, repetition, topk, toxicity, url_rules

#: Rules of the URL filter query: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("kept_text")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.summary(personal_data.find_spans(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced_mix(table(spark, sf_dir, "documents")).drop("copies")


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.transform(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def planted_period(doc_id: Column, text: Column) -> Column:
    """For a tenth of the ids, the text's words with a periodic end: from word a on, the p words there over and over. Else the text."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        end = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(ws, F.lit(1), a), end), F.lit(1), n), " "))

    # An array of one element names the words, so they are split once.
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words), planted), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.summary(periodic_runs.find_runs(docs.withColumn("text", planted_period(F.col("doc_id"), F.col("text")))))


OP6_SQL = """
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
r(rhost, rpath, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                              ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (
  select u.page_id, u.host, u.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule,
         max_by(r.v, length(r.rhost || r.rpath)) as v
  from u left join r on (u.host = r.rhost or ends_with(u.host, '.' || r.rhost)) and starts_with(u.path, r.rpath)
  group by all)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m
"""


OP1_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and list_count(embedding) = len(embedding) and len(embedding) > 0
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
n as (select a, count(*) as n_links from p group by a),
c as (select a, min(b) as low from r group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join n on vec_id = n.a left join c on vec_id = c.a
"""

OP3_SQL = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[p:p + 3], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 2)) as p from d) q
      union select doc_id, md5(array_to_string(w, ' ')) from d where len(w) between 1 and 3),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b using (h) where a.doc_id <> b.doc_id group by all),
p as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as low from r group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id
from d left join n using (doc_id) left join c on d.doc_id = c.a
"""

OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP5_SQL = """
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 33)) as p, w from d),
h as (select doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) as h from s),
m as (select h from h group by h having count(*) > 1),
c as (select distinct doc_id, unnest(range(p, p + 35)) as i from h semi join m using (h)),
k as (select doc_id, list(i) as gone, count(*) as n from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
from d left join k using (doc_id)
"""


OP11_SQL = """
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
l as (select r, line, count(*) as c, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) as chars
      from (select r, unnest(string_split(text, chr(10))) as line from d) x where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all),
dup as (select r, sum(c - 1)::bigint as n_dup_lines, sum((c - 1) * chars)::bigint as dup_line_chars from l group by r),
g as (select r, n, p, md5(array_to_string(w[p:p + n - 1], ' ')) as h from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, range(5, 11) t(n)) x),
m as (select r, n, p, row_number() over (partition by r, n, h order by p) as nth, count(*) over (partition by r, n, h) as c from g),
v as (select distinct r, n, nth > 1 as again, unnest(range(p, p + n)) as i from m where c > 1),
k as (select r, n, count(distinct v.i) as words, sum(case when again then length(d.w[v.i]) end)::bigint as chars from v join d using (r) group by r, n),
c as (select r, max(words) filter (n = 8) as n_repeat_words, max(chars) filter (n = 5) as dup_chars_5, max(chars) filter (n = 6) as dup_chars_6,
             max(chars) filter (n = 7) as dup_chars_7, max(chars) filter (n = 8) as dup_chars_8, max(chars) filter (n = 9) as dup_chars_9,
             max(chars) filter (n = 10) as dup_chars_10 from k group by r),
f as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(dup_line_chars, 0) as dup_line_chars,
         coalesce(dup_chars_5, 0) as dup_chars_5, coalesce(dup_chars_6, 0) as dup_chars_6, coalesce(dup_chars_7, 0) as dup_chars_7,
         coalesce(dup_chars_8, 0) as dup_chars_8, coalesce(dup_chars_9, 0) as dup_chars_9, coalesce(dup_chars_10, 0) as dup_chars_10
  from d left join dup using (r) left join c using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select *, not base_failed and 100 * dup_line_chars <= 25 * word_chars and 100 * dup_chars_5 <= 25 * word_chars and 100 * dup_chars_6 <= 24 * word_chars
          and 100 * dup_chars_7 <= 23 * word_chars and 100 * dup_chars_8 <= 22 * word_chars and 100 * dup_chars_9 <= 21 * word_chars
          and 100 * dup_chars_10 <= 20 * word_chars as kept from b
"""

OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u,
         sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
             ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from x),
p as (select doc_id, text, n, form, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
       case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
       sha256(text) as restored_sha256 from p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_quality": op2_quality,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_url_filters": op6_url_filters,
        "op7_toxicity": op7_toxicity,
        "op8_personal_data": op8_personal_data,
        "op9_packing": op9_packing,
        "op10_mixing": op10_mixing,
        "op11_repetition": op11_repetition,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_exact_top_k": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op6_url_filters": OP6_SQL,
            "op11_repetition": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
