"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, jaccard, language, lexical, licenses, mixing, near_vectors, packing, quality, substrings, suffix_arrays, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(licenses.scan(_table(spark, sf_dir, "documents")))


def license_digest(found: DataFrame) -> DataFrame:
    """The query's columns from a scan's detections."""
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*cols), lambda d: d["label"]))), ",")
    first = F.transform("base", lambda d: d["first"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), labels("base").alias("base_labels"), labels("base", "detections").alias("labels"), "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return chat.link(*chat.from_turns(turns), chat.REPLY, chat.other_turns(turns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_arrays.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scans, op3_language_id, op4_embedding_near_dedup, op5_chat_formatting, op6_ngram_jaccard_join, op7_best_fit_packing, op8_suffix_array_dedup, op9_mixing_sources, op10_quality_rules, op11_ranked_lexical_search, op12_tokenizer_alignment, op13_url_filters)}

OP1 = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, doc_id, unnest(range(len(w))) as i, unnest(w) as word from docs),
runs as (select r, doc_id, i, count(*) over f as n, string_agg(word, ' ') over f as run from words
  window f as (partition by r order by i rows between current row and 12 following)),
firsts as (select run, min(doc_id) as first from runs where n = 13 group by run),
hits as (select r, i from runs join firsts using (run) where n = 13 and doc_id > first),
gone as (select r, i, max(h) over (partition by r order by i rows between 12 preceding and current row) as gone
  from (select w.r, w.i, (h.i is not null)::int as h from words w left join hits h on h.r = w.r and h.i = w.i)),
kept as (select r, string_agg(word, ' ' order by i) filter (gone = 0) as kept, sum(gone) as n_removed from words join gone using (r, i) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from docs d left join kept k using (r)
"""
OP11 = r"""
with low as (select 'd' as kind, row_number() over () as r, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'q', row_number() over (), item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
terms as (select kind, r, id, unnest(regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from low),
tf as (select r, id, term, count(*) as tf from terms where kind = 'd' group by all),
docs as (select r, sum(tf)::bigint as n from tf group by r),
total as (select count(*) as nn, coalesce(sum(n), 0)::bigint as ll from docs),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, nn),
asked as (select distinct id as item_id, term from terms where kind = 'q'),
scores as (select item_id, id as doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from asked join w using (term) join tf using (term) join docs using (r), total group by item_id, id, r),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
OP13 = r"""
with rules(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (select row_number() over () as r, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
seen as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select s.r, x.host || x.path as rule, x.verdict, row_number() over (partition by s.r order by length(x.host || x.path) desc, length(x.host) desc) as k
  from seen s join rules x on (s.host = x.host or ends_with(s.host, '.' || x.host)) and starts_with(s.path, x.path))
select page_id, s.host, s.path, f.rule, coalesce(f.verdict, case when s.host = '' then 'block' else 'allow' end) as verdict
from seen s left join fits f on f.r = s.r and f.k = 1
"""
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1, "op11_ranked_lexical_search": OP11, "op13_url_filters": OP13}
