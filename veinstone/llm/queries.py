"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kmeans, langid, lines, mixing, quality, simhash, tokens, topk, urls, vectors, whitening, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=3)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        shards = tokens.write_ids(table(spark, sf_dir, "documents"), f.read())
    return tokens.read_ids(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, least=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, offset=100_000)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=10).drop("spans")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, seed=3)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_url_filter": op3_url_filter,
        "op4_line_dedup": op4_line_dedup,
        "op5_simhash": op5_simhash,
        "op6_language_id": op6_language_id,
        "op7_embedding_dups": op7_embedding_dups,
        "op8_token_ids": op8_token_ids,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_whitening": op11_whitening,
        "op12_decontaminate": op12_decontaminate,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op3_url_filter": op3_sql(), "op4_line_dedup": OP4_SQL, "op12_decontaminate": OP12_SQL, "op13_centroids": op13_sql()}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev,
         row_number() OVER (ORDER BY cap / weight, source) AS place
  FROM w),
first AS (SELECT min(place) AS place FROM l WHERE weight * lev <= cap),
lev AS (SELECT lev FROM l, first WHERE l.place = first.place),
t AS (
  SELECT source, source_size, CASE WHEN l.place < (SELECT place FROM first) THEN cap ELSE weight * (SELECT lev FROM lev) END AS target
  FROM l),
d AS (
  SELECT sized.doc_id, sized.source, size, draw, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN before + size / 2.0::DOUBLE <= target - source_size * whole THEN 1 ELSE 0 END END AS repeats FROM d)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(repeats AS BIGINT) AS repeats, CAST(repeats * size AS BIGINT) AS taken
FROM r
"""


OP2_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
f AS (
  SELECT doc_id, no, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS k FROM f),
w AS (
  SELECT doc_id, k, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS win
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS occurrence FROM w WHERE win IS NOT NULL) WHERE occurrence > 1),
c AS (SELECT DISTINCT doc_id, k + i AS k FROM r, (SELECT unnest([0, 1, 2]) AS i)),
g AS (SELECT n.doc_id, n.no, c.k IS NOT NULL AS gone FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.k = c.k),
-- A blank line goes if the lines before and after it both go.
m AS (
  SELECT l.doc_id, l.no, l.line, coalesce(g.gone,
    last_value(g.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AND first_value(g.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS gone,
    g.no IS NOT NULL AS counted
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, coalesce(x.lines_removed, 0) AS lines_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text, CAST(count(*) FILTER (gone AND counted) AS BIGINT) AS lines_removed
  FROM m GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""


def op3_sql() -> str:
    ranked = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    fits = [(f"('.' || host) LIKE '%.{r.host}' AND starts_with(path, '{r.path}')", r) for r in ranked]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in fits)
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits)
    terms = ", ".join(f"('{t.term}', {t.weight})" for t in urls.read_terms())
    return rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after
  FROM pages),
q AS (
  SELECT page_id, u, translate(regexp_extract(after, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
t AS (SELECT * FROM (VALUES {terms}) AS v(term, weight)),
h AS (SELECT u, sum(weight) AS weight FROM (SELECT DISTINCT u FROM p), t WHERE regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY u)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN coalesce(h.weight, 0) >= {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN h USING (u)
"""


OP12_SQL = r"""
WITH fold AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS size FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, list_aggregate(w[p : p + size - 1], 'string_agg', ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, p, list_aggregate(w[p : p + size - 1], 'string_agg', ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM fold, sizes WHERE len(w) >= size)),
hit AS (SELECT r, size, p, win FROM places WHERE win IN (SELECT win FROM windows)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS k FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hit JOIN windows USING (win) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


def op13_sql() -> str:
    """Ten rounds of exact assignment to all centroids, one after the other."""
    nearest = "SELECT n, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.n, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {at} c) GROUP BY n"
    steps = ["c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 8))"]
    for k in range(11):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(at=f'c{k}')})")
        if k < 10:
            steps.append(f"s{k} AS MATERIALIZED (SELECT best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS m FROM a{k} JOIN v USING (n), range(1, 65) t(i) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{k} LEFT JOIN (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS y FROM s{k} GROUP BY c) USING (c))")
    return f"""
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(e, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS x FROM raw WHERE len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
{", ".join(steps)}
SELECT vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN v USING (n) JOIN c10 ON best.c = c10.c
"""
