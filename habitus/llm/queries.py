"""The registered queries of the operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.llm import bpe, brown_lm, decontaminate, group_join, hard_negatives, importance, language_id, mpeg_audio, pii, prefix_trie, secret_scan, superkmer, token_store
from habitus.llm.text import stored
from habitus.session import prepare, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the name of its function, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents")))


@query()
def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(mpeg_audio.store(table(spark, sf_dir, "documents")), "media")
    return mpeg_audio.inspect(media)


@query()
def op8_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.report(spark, path)


WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, least(10, len(w)) AS n, w FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM b, unnest(range(1, len(w) - n + 2)) AS t(s)),
size AS (SELECT DISTINCT n FROM item),
win AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM d, size, unnest(range(1, len(w) - n + 2)) AS t(s)),
occ AS (SELECT DISTINCT doc_id, s, n, k FROM win SEMI JOIN item USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ JOIN item USING (n, k)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query(DECONTAMINATION)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SUBSTRINGS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(s)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
word AS (SELECT doc_id, p, w[p] AS v FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query(SUBSTRINGS)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.dedup(table(spark, sf_dir, "documents")).drop("kept")


LINKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + least(4, len(w)) - 1], ' ') AS k
  FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT x AS doc_id, x AS r FROM link UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) USING (doc_id)"""


@query(LINKS)
def op10_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.link_components(table(spark, sf_dir, "documents"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(table(spark, sf_dir, "documents"))


@query()
def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.held_out_scores(table(spark, sf_dir, "documents"))


@query()
def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query(HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    moved = embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.vectors(moved), F.col("vec_id") % 50 == 0)


CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"""
TRIE = f"""
WITH o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, w, {CRC32.format('conv_id')} % 9 AS h FROM o),
s AS (SELECT h.conv_id, list_concat(coalesce(o.w[1:h], []), h.w[h + 1:]) AS w FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, w[1:d] AS k, len(w) = d AS ends FROM s, unnest(range(0, len(w) + 1)) AS u(d)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN ends THEN conv_id END, ',' ORDER BY conv_id), '') AS e FROM m GROUP BY d, k),
c AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.d, k, (n - 1) * coalesce(strlen(k[n.d].x), 0) AS saved, children IS NULL AS leaf FROM n LEFT JOIN c USING (d, k)),
t AS (SELECT a AS d, k[1:a] AS k, sum(saved) AS saved, sum(leaf::INT) AS leaves FROM v, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(n.e) AS ends_sha256
FROM n JOIN t USING (d, k) LEFT JOIN c USING (d, k) LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""


@query(TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query()
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.report(secret_scan.find(documents, secret_scan.fit(documents)))
