"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_quality_rules, op02_token_store, op03_substring_dedup, op04_jaccard_join, op05_ngram_lm, op06_html_blocks, op07_bpe_codec, op08_decontaminate, op09_ann_projections, op10_toxicity_mil, op11_filter_audit, op12_hard_negatives, op13_divergence
from .storage import Scratch, batches_of_texts, spread


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_of_texts(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "store").path  # deleted as the driver exits
    op02_token_store.write_store(table(spark, sf_dir, "documents"), tokenizer(), store)
    return op02_token_store.read_digests(spark, store)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_substring_dedup.duplicate_passages(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_ngram_lm.language_model(table(spark, sf_dir, "documents"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_html_blocks.extract(table(spark, sf_dir, "pages"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ann_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_ann_projections.neighbours(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity_mil.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives_(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return op12_hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, moved)


def op13_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_store": op2_token_store,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_html_blocks": op6_html_blocks,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann_projections": op9_ann_projections,
    "op10_toxicity_mil": op10_toxicity,
    "op11_filter_audit": op11_filter_audit_,
    "op12_hard_negatives": op12_hard_negatives_,
    "op13_divergence_rules": op13_divergence_rules,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 grams AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
 many AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
 again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT a.r, unnest([a.i, a.i + 1, a.i + 2]) AS j FROM grams a JOIN many m ON m.r = a.r AND m.g = a.g) GROUP BY r),
 x AS (SELECT d.*, len(w) AS nw, length(t) AS nc, coalesce(a.n, 0) AS repeats, length(regexp_replace(t, '\p{Ll}+', '', 'g')) AS l1, length(regexp_replace(t, '[\p{Ll}\x20\x09-\x0D]+', '', 'g')) AS l2, length(regexp_replace(t, '[\p{Ll}\p{Lu}\x20\x09-\x0D]+', '', 'g')) AS l3,
  length(regexp_replace(t, '[\p{L}\p{M}\x20\x09-\x0D]+', '', 'g')) AS l4, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g')) AS l5, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\p{P}\x20\x09-\x0D]+', '', 'g')) AS l6 FROM d LEFT JOIN again a ON a.r = d.r),
 c AS (SELECT *, [nc - l1, l1 - l2, l2 - l3, l3 - l4, l4 - l5, l5 - l6, l6] AS cells FROM x),
 fit AS (SELECT * FROM c WHERE nw >= 50),
 voc AS (SELECT lang, word, sum(u) AS n FROM (SELECT lang, 100000000 // nw AS u, unnest(w) AS word FROM fit) WHERE strlen(word) <= 8 GROUP BY lang, word),
 best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM voc QUALIFY k <= 24),
 sizes AS (SELECT lang, sum(nw) AS n, sum((100000000 // nw) * nw) AS u FROM fit GROUP BY lang),
 wref AS (SELECT lang, k, n FROM best UNION ALL SELECT b.lang, 0, any_value(s.u) - sum(b.n) FROM best b JOIN sizes s ON s.lang = b.lang GROUP BY b.lang),
 cref AS (SELECT lang, k, sum(n) AS n FROM (SELECT lang, 10000 * unnest(cells) // nc AS n, unnest(range(7)) AS k FROM fit) GROUP BY lang, k),
 hits AS (SELECT o.r, b.k, count(*) AS n FROM (SELECT r, lang, unnest(w) AS word FROM c WHERE nw >= 50) o JOIN best b ON b.lang = o.lang AND b.word = o.word GROUP BY o.r, b.k),
 whist AS (SELECT r, k, n FROM hits UNION ALL SELECT c.r, 0, any_value(nw) - coalesce(sum(h.n), 0) FROM c LEFT JOIN hits h ON h.r = c.r WHERE nw >= 50 GROUP BY c.r),
 cells AS (SELECT 0 AS kind, c.r, w.k, CAST(coalesce(h.n, 0) AS DOUBLE) / nw AS p, CAST(w.n AS DOUBLE) / s.u AS q FROM c JOIN sizes s ON s.lang = c.lang AND s.n >= 1000 JOIN wref w ON w.lang = c.lang LEFT JOIN whist h ON h.r = c.r AND h.k = w.k WHERE nw >= 50
  UNION ALL SELECT 1, o.r, z.k, CAST(o.n AS DOUBLE) / o.nc, CAST(z.n AS DOUBLE) / sum(z.n) OVER (PARTITION BY o.r) FROM (SELECT r, lang, nc, unnest(cells) AS n, unnest(range(7)) AS k FROM c WHERE nc >= 200) o JOIN sizes s ON s.lang = o.lang AND s.n >= 1000 JOIN cref z ON z.lang = o.lang AND z.k = o.k),
 far AS (SELECT r, sum(CASE WHEN kind = 0 THEN (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 END) AS dw, sum(CASE WHEN kind = 1 THEN (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 END) AS dc FROM cells GROUP BY r),
 lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
 told AS (SELECT c.*, dw, dc, coalesce(l.n, 0) AS dup, nw < 50 OR 100 * repeats > 50 * nw AS failed FROM c LEFT JOIN far f ON f.r = c.r LEFT JOIN lines l ON l.r = c.r)
 SELECT id AS doc_id, CAST(nw AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(repeats AS BIGINT) AS n_repeat_words, failed AS base_failed,
 NOT failed AND coalesce(dc <= 0.3 * 0.3 + 6 / (8 * ln(2) * nc), true) AND coalesce(dw <= 0.25 * 0.25 + 24 / (8 * ln(2) * nw), true) AS kept, round(dc, 6) AS class_divergence, round(dw, 6) AS word_divergence FROM told"""

#: The other operators train models, tokenize, or search approximately, which SQL can't express.
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 grams AS (SELECT id, w[i : i + 4] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) UNION SELECT id, w FROM d WHERE len(w) BETWEEN 1 AND 4),
 sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
 common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
 links AS (SELECT x, y FROM common JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
 ties AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach AS (SELECT id AS x, id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN ties b ON b.x = r.y)
 SELECT d.id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN sizes s ON s.id = d.id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.id""",
    "op8_decontaminate": rf"""WITH d AS (SELECT CAST(doc_id AS BIGINT) AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 items AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 windows AS (SELECT item, item_id, j, k, w[j : j + k - 1] AS g FROM (SELECT item, item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM items WHERE len(w) > 0)),
 places AS (SELECT id, k, i, w[i : i + k - 1] AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM windows) ON len(w) >= k)),
 hits AS (SELECT p.id, p.i, p.k, x.item, CAST(x.item_id AS VARCHAR) AS item_id, p.i - x.j AS shift FROM places p JOIN windows x ON x.k = p.k AND x.g = p.g),
 hit_words AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest(range(i, i + k)) AS x FROM hits) GROUP BY id),
 hit_items AS (SELECT id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT id, item_id AS s FROM hits) GROUP BY id),
 runs AS (SELECT id, item_id, min(i) - 1 AS start, count(*) + any_value(k) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, item, shift ORDER BY i) AS island FROM hits) GROUP BY id, item, item_id, shift, island),
 best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, start, item_id) = 1)
 SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, CAST(b.n AS INT) AS longest, CAST(b.start AS INT) AS longest_at, b.item_id AS longest_item FROM d LEFT JOIN hit_words h ON h.id = d.id LEFT JOIN hit_items t ON t.id = d.id LEFT JOIN best b ON b.id = d.id""",
    "op11_filter_audit": r"""WITH d AS (SELECT CAST(doc_id AS BIGINT) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 known AS (SELECT CAST(doc_id AS BIGINT) AS id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.id > min(d.id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d LEFT JOIN known k ON k.id = d.id),
 masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
 steps AS (SELECT o, step, CAST(1 << (ascii(substr(o, step, 1)) - 65) AS INT) AS own, CAST(list_sum([0] || [1 << (ascii(substr(o, j, 1)) - 65) for j in range(1, step)]) AS INT) AS past FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
 told AS (SELECT part, o, step, own, sum(CASE WHEN mask & (own | past) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own > 0 AND mask & past > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS alone, sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN good ELSE 0 END) AS good, sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN toxic ELSE 0 END) AS toxic FROM masks, steps GROUP BY part, o, step, own)
 SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails, CAST(good AS BIGINT) AS good_lost, CAST(toxic AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told""",
    "op12_hard_negatives": """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
 p AS (SELECT a, b, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
 SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INT) AS "rank", s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
 FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY "rank" <= 3""",
    "op13_divergence_rules": _DIVERGENCE,
}
