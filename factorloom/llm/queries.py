"""Queries over the test tables, one for each operator of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import codes, html_text, lines, minhash, packing, quality, resampling, sharding, simhash, spm, topk, toxicity, urlrules
from factorloom.llm.common import read_table

SHARD_BYTES = 1 << 20
END_ID = 2
#: The score from which a document counts as toxic.
TOXIC_FROM = 0.3


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, of at most a mebibyte of text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.shard(docs, ["doc_id"], F.octet_length("text"), SHARD_BYTES)
    return found.select("doc_id", "depth", "prefix", "page", "n_bytes")


def sharding_sql(max_bytes: int = SHARD_BYTES) -> str:
    """For each document the shortest prefix of its hash under which all documents fit."""
    return f"""
    WITH sizes AS (
        SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
               ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
        FROM documents
    ), leaves AS (
        SELECT s.doc_id, s.n_bytes, d.depth, CAST(s.h >> (60 - d.depth) AS BIGINT) AS prefix,
               sum(s.n_bytes) OVER cell AS bytes, min(s.h) OVER cell = max(s.h) OVER cell AS single
        FROM sizes s, (SELECT CAST(range AS INT) AS depth FROM range(61)) d
        WINDOW cell AS (PARTITION BY d.depth, s.h >> (60 - d.depth))
    ), found AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
        FROM leaves WHERE bytes <= {max_bytes} OR single
    )
    SELECT doc_id, depth, prefix, CAST(0 AS BIGINT) AS page, CAST(n_bytes AS BIGINT) AS n_bytes FROM found WHERE nth = 1
    """


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of power-of-two lengths, each a sequence of its own."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, with_ids=False)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", html_text.main_texts(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and the text that they stand for."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = spm.encode(docs, model)
    return found.select("doc_id", "ids", spm.decode(F.col("ids"), model).alias("text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document, and whether the quality rules keep it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = quality.judge(docs, labels, with_text=False)
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's labels aren't to be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model of the labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model = toxicity.fit(docs, labels)
    found = docs.select("doc_id", held_out().alias("held_out"), toxicity.scores(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fiftieth vector the five with the largest inner products."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), products AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS score
    FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM products
)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE n <= 5
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand elsewhere already."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_removed")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near every document's words are to those of the benchmark, and the tenth of the documents that is drawn by that."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    target = read_table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target)


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, coalesce(text, '') FROM benchmark)
), numbered AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM words),
one AS (SELECT r, doc_id, unnest(w) AS word FROM numbered),
crcs AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda b, k: xor(b >> 1, (b & 1) * 3988292384)))) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM one)
), counts AS (
    SELECT bucket, count(doc_id) AS s, count(*) - count(doc_id) AS t FROM one JOIN crcs USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS gain FROM counts
), sums AS (SELECT r, sum(gain) AS total FROM one JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
    SELECT doc_id, n, CAST(floor(coalesce(total / n, 0)) AS BIGINT) AS weight,
           CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
    FROM numbered LEFT JOIN sums USING (r) WHERE doc_id IS NOT NULL
), ranked AS (
    SELECT *, weight + noise AS score, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY weight + noise DESC, doc_id) END AS place,
           count(*) FILTER (n >= 20) OVER () AS of
    FROM scored
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * of // 100 THEN place END AS rank FROM ranked
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document, and whether it is the one that stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, by codebooks of 256 entries for each of its four parts."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.compress(vectors)


def codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """The rounds one after the other, each part compared with all entries of its book."""
    nearest = (
        "SELECT vec_id, label, p, x, min(row(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k)) AS best"
        " FROM parts JOIN {book} USING (p) GROUP BY vec_id, label, p, x"
    )
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.format(book=f'book{r}')})")
        steps.append(
            f"""book{r + 1} AS MATERIALIZED (
            SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN (
                SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
                    SELECT p, k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best[2] AS k, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{r})
                    GROUP BY p, k, i) GROUP BY p, k
            ) m ON b.p = m.p AND b.k = m.k)"""
        )
    return f"""
    WITH whole AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM whole, range({parts}) t(p)
    ), book0 AS MATERIALIZED (
        SELECT p, n - 1 AS k, x AS e FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM parts) WHERE n <= {entries}
    ), {', '.join(steps)},
    last AS ({nearest.format(book=f'book{rounds}')}),
    coded AS (
        SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
        FROM last GROUP BY vec_id
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) FROM book{rounds}) AS codebooks_sha256
    FROM coded
    """


def url_rules() -> list[urlrules.Rule]:
    """The five host rules, and wildcards for what they leave: calendars, print views and session ids."""
    return [
        urlrules.host_rule("com", "/en/", "block"),
        urlrules.host_rule("example.com", "/en/7", "allow"),
        urlrules.host_rule("net", "/de/", "allow"),
        urlrules.host_rule("example.net", "/de/8", "block"),
        urlrules.host_rule("org", "/es/", "block"),
        urlrules.glob_rule("**", "**/calendar/**", "block"),
        urlrules.glob_rule("**", "**/print/**", "block"),
        urlrules.glob_rule("**", "**;jsessionid=**", "block"),
    ]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, url_rules(), "allow").select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
    SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN '.' || host LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN '.' || host LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN '.' || host LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/'
        END AS rule
    FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN path LIKE '%/calendar/%' OR path LIKE '%/print/%' OR path LIKE '%;jsessionid=%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator's query by its name."""
    found = [
        op1_sharding,
        op2_packing,
        op3_main_text,
        op4_simhash,
        op5_sentencepiece,
        op6_quality,
        op7_toxicity,
        op8_top_k,
        op9_url_filter,
        op10_line_dedup,
        op11_resampling,
        op12_minhash,
        op13_codes,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op1_sharding": sharding_sql(), "op8_top_k": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_resampling": OP11_SQL, "op13_codes": codes_sql()}
