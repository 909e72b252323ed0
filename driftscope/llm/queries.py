"""The registered queries of this folder: one per operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftscope.llm import alignment, decontamination, extraction, langid, lines, mixing, ranked, sharding, topk, urlfilter, warc
from driftscope.llm import tokens as token_files
from driftscope.llm.scratch import Scratch, table
from driftscope.llm.simhash import fingerprint_hex, near_duplicates


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "first_word")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    model = langid.learn(docs, usable=~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix-sources")
    docs = table(spark, sf_dir, "documents")
    sizes = scratch.keep(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")), "sizes")
    targets = scratch.keep(mixing.source_targets(scratch, sizes), "targets")
    mixed = mixing.with_copies(sizes, targets)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "kd-shards")
    docs = table(spark, sf_dir, "documents")
    placed = sharding.with_slots(scratch, sharding.kd_shards(docs, shards=24, scratch=scratch))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    ranges = warc.write_archives(scratch, pages)
    return warc.lookup(scratch, ranges, pages.select(
        warc.url_key(F.col("url")).alias("key"), "page_id", warc.payload_digest(F.col("html")).alias("digest")))


#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "alignment")
    index = alignment.pair_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"), scratch=scratch)
    return alignment.scored_documents(scratch, index)


def op13_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_kd_shards": op2_kd_shards,
    "op3_main_text": op3_main_text,
    "op4_threshold_top_k": op4_threshold_top_k,
    "op5_warc_index": op5_warc_index,
    "op6_url_rules": op6_url_rules,
    "op7_token_files": op7_token_files,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_language_id": op10_language_id,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op11_ranked_search": op11_ranked_search,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_repeated_lines": op13_repeated_lines,
}

MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), by_source AS (
    SELECT source, sum(size)::BIGINT AS s,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
    FROM sized GROUP BY source
), levels AS (
    SELECT *, coalesce(sum(3 * s) OVER earlier, 0) AS fixed, sum(w) OVER later AS rest, sum(s) OVER () AS total
    FROM by_source
    WINDOW earlier AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), water AS (
    SELECT min_by(fixed, fixed) AS fixed, max(rest) AS rest, max(total) AS total
    FROM levels WHERE (total - fixed) * w <= 3 * s * rest
), targets AS (
    SELECT source, s, CASE WHEN (total - water.fixed) * w > 3 * s * water.rest THEN (3 * s)::DOUBLE
                           ELSE ((total - water.fixed) * w)::DOUBLE / water.rest::DOUBLE END AS target
    FROM by_source, water
), rated AS (
    SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
           ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, s AS source_size, target,
       size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken
FROM rated
"""

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

WARC_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS n,
           sha256(coalesce(html, '')) AS digest
    FROM pages
), f AS (
    SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""

URL_SQL = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), split AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
    FROM parts
), rules(verdict, h, p) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
       coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""

RANKED_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), i AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), size AS (
    SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d
), tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * size.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, size.n
), scored AS (
    SELECT item_id, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * tf.n * size.n) // size.l)))))::BIGINT AS score
    FROM i JOIN tf USING (term) JOIN w USING (term), size GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

LINES_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
    SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
    SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
    SELECT r, doc_id, line, pos, length(k.key) < 10 OR first_id IS NOT DISTINCT FROM doc_id AS stays
    FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": MIX_SQL,
    "op4_threshold_top_k": TOP_K_SQL,
    "op5_warc_index": WARC_SQL,
    "op6_url_rules": URL_SQL,
    "op11_ranked_search": RANKED_SQL,
    "op13_repeated_lines": LINES_SQL,
}
