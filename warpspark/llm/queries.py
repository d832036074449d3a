"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, embedding_dedup, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, resampling, secrets, substring_dedup, token_counts, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_links(table(spark, sf_dir, "documents"), 4, 85)


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(4) == 2
    scored = quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(5) == 0
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets.count(s, k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.joined(s, ("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(s).alias("spans"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_kept(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_ngram_jaccard, op4_quality_classifier, op5_toxicity, op6_secret_scans, op7_token_counts, op8_substring_dedup, op9_embedding_dedup, op10_packing, op11_importance_resampling, op12_periodic_runs, op13_decontamination)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: All pairs that share a shingle, counted; then what each document can reach.
_OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  e AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM e JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
  both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
  c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id), k AS (SELECT x AS doc_id, count(*) AS n_links FROM both_ways GROUP BY x)
  SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: Every window that also begins earlier, and the words that such windows cover.
_OP8 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
  win AS (SELECT doc_id, i - 1 AS start, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
  later AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS nth FROM win) WHERE nth > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM later),
  word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
  kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.pos) AS text, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos WHERE gone.pos IS NULL GROUP BY word.doc_id)
  SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


#: crc32 byte by byte over the UTF-8 bytes of each distinct feature; then counts, gains, sums and ranks.
_OP11 = f"""WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS t),
  w AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents
    UNION ALL SELECT 'b', item_id, 0, regexp_extract_all({_LOWER}, {_LETTERS}) FROM benchmark),
  f AS (SELECT side, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS f FROM w),
  bytes AS (SELECT f, flatten(list_transform(string_split(f, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
      WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END)) AS x FROM (SELECT DISTINCT f FROM f)),
  bucket AS (SELECT f, xor(list_reduce(x, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM bytes, crc),
  n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN bucket USING (f) GROUP BY b),
  total AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
  gain AS (SELECT b, floor(1000 * ln(((n.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE) / ((n.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS g FROM n, total),
  weight AS (SELECT row_id, sum(g) AS weight, count(*) AS n FROM f JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY row_id),
  scored AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN weight USING (row_id) WHERE side = 'd'),
  fit AS (SELECT *, words >= 20 AND score IS NOT NULL AS fit FROM scored),
  ranked AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, n_features) END AS nth, count(*) FILTER (fit) OVER () AS total FROM fit)
  SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 5 * total // 100 THEN nth END AS rank FROM ranked"""

#: All windows of all documents, joined as words.
_OP13 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM benchmark),
  i AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k+9], ' ')) END) AS g FROM b WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT size FROM i),
  x AS (SELECT row_id, size, unnest(range(len(w) - size + 1)) AS start, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k+size-1], ' '))) AS g FROM d, sizes WHERE len(w) >= size),
  hit AS (SELECT x.row_id, x.start, x.size, i.item_id FROM x JOIN i ON x.g = i.g AND x.size = i.size),
  words AS (SELECT row_id, count(DISTINCT pos) AS n FROM (SELECT row_id, unnest(range(start, start + size)) AS pos FROM (SELECT DISTINCT row_id, start, size FROM hit)) GROUP BY row_id),
  named AS (SELECT row_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY row_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (row_id) LEFT JOIN named USING (row_id)"""


def oracle_sql() -> dict[str, str]:
    """The others rest on trained models, tokenizers, sketches or bounded search, which tests hold against brute force."""
    return {"op3_ngram_jaccard": _OP3, "op8_substring_dedup": _OP8, "op11_importance_resampling": _OP11, "op13_decontamination": _OP13}
