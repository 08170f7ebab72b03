"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import alignment, bloom_lookup, mil_quality, packing, phrases, pii, pivotal_mix, pu_toxicity, secret_ledger, simhash, substring_dedup, tiff_pages, url_filter
from loomgraph.llm.common import delete_at_exit, shared_dir, table


#: Rules of op7: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff_pages.from_texts(table(spark, sf_dir, "documents"))
    # the payload is the first page; reduced versions may follow
    read = tiff_pages.features(tiff_pages.pages(files, keep=("doc_id", "n_bytes", "content")).where("page = 0"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        "feature",
        "compression",
    )


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pivotal_mix.sizes(table(spark, sf_dir, "documents"))
    return pivotal_mix.mix(items, weights=(5, 2, 1), share=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pu_toxicity.score(docs, pu_toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, default="allow")


def op8_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_quality.score(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    ledger = delete_at_exit(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    # the ledger is filled first, and then meets the same blobs again, of which it has none to scan
    secret_ledger.update(versions, ledger)
    found = secret_ledger.findings(versions, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_ledger.BASE))
    return found.select(F.col("path").alias("doc_id"), *map(count, secret_ledger.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), reach=8, least=3, generalise=0.6, remove=0.9)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, share=100)


QUERIES = {
    f.__name__: f
    for f in (
        op1_tiff_pages,
        op2_pivotal_mix,
        op3_substring_dedup,
        op4_best_fit_packing,
        op5_toxicity_nnpu,
        op6_simhash_pivot,
        op7_url_filter,
        op8_iblt_fingerprint,
        op9_quality_mil,
        op10_secret_ledger,
        op11_pii_sanitise,
        op12_token_alignment,
        op13_collocations,
    )
}

ORACLES = {
    "op3_substring_dedup": """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') as words from documents),
s as (select doc_id, unnest(range(0, greatest(len(words) - 19, 0))) as a, words from w),
g as (select doc_id, a, row_number() over (partition by array_to_string(words[a + 1 : a + 20], ' ') order by doc_id, a) as k from s),
c as (select distinct doc_id, unnest(range(a, a + 20)) as i from g where k > 1),
x as (select doc_id, unnest(words) as word, unnest(range(0, len(words))) as i from w),
k as (select x.doc_id, string_agg(word, ' ' order by x.i) as kept, count(*) as n from x anti join c on c.doc_id = x.doc_id and c.i = x.i group by x.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
""",
    "op7_url_filter": """
with u as (
    select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages),
r(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
       (select h || p from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1) as rule,
       coalesce((select v from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1), 'allow') as verdict
from u
""",
    "op13_collocations": """
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w from d),
s as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, w[i : i + m - 1] as g from s, (values (1), (2), (3), (4), (5)) v(m) where i + m - 1 <= len(w)),
f as (select lang, g, count(*) as f from g group by all),
t as (select lang, sum(f) as n from f where len(g) = 1 group by lang),
c as (select lang, g, f as a from f where len(g) > 1 and f >= 100),
e as (select lang, g, a, unnest(range(2, len(g))) as m from c where len(g) > 2),
b as (select lang, g, a, m, unnest(range(1, len(g) - m + 2)) as s from e),
z as (select lang, g[s : s + m - 1] as g, max(a) as longer from b group by all),
k as (select c.* from c left join z using (lang, g) where longer is null or 100 * longer < 100 * a),
u as (select lang, g, a, unnest(range(1, len(g))) as k from k),
v as (select u.lang, u.g, u.a, u.k, l.f as l, r.f as r, t.n, (1000::hugeint * u.a * t.n) // (l.f::hugeint * r.f) as score
      from u join f l on l.lang = u.lang and l.g = u.g[1 : u.k] join f r on r.lang = u.lang and r.g = u.g[u.k + 1 : len(u.g)] join t on t.lang = u.lang),
y as (select *, row_number() over (partition by lang, g order by score, k) as best from v),
q as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from y where best = 1)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from q) where rank <= 2000
""",
}
