"""One query for each operator over its whole table, with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import audit, langid, lines, media, mixing, packing, phrases, quality, secret_scan, simhash, substring, urls, warc

#: Verdict, and host with path prefix.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    return langid.predict(docs, langid.learn(docs.where("not held_out")), ["doc_id", "held_out"])


def op3_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4, blocks=3)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op4_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs), ["doc_id"], clean_too=False)
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_image_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table is derived from ``embeddings``: a picture for each vector, and a cropped and dimmed copy of it."""
    return media.copies(media.rendered(_table(spark, sf_dir, "embeddings")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), remembered=300_000)


def op10_window_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(_table(spark, sf_dir, "documents"), length=35, digests=True)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_chunks, op2_language_backoff, op3_simhash_vantage, op4_url_markov, op5_pareto_mix, op6_secret_network, op7_image_corners, op8_quality_rules, op9_differencing_packs, op10_window_repeats, op11_filter_audit, op12_phrase_streams, op13_line_runs)}

#: op5 in SQL: the same targets and chances in closed form, the same order of documents and the same cut, from one running sum a source.
ORACLE: dict[str, str] = {
    "op5_pareto_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM totals),
filling AS (SELECT *, most::DOUBLE / weight::DOUBLE AS fills_at FROM weighted),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fills_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY fills_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM filling),
level AS (SELECT min_by(level, fills_at) AS level FROM levels WHERE level <= fills_at),
shares AS (SELECT source, source_size, least(most::DOUBLE, level.level * weight) AS target FROM levels, level),
classes AS (SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
scaled AS (
  SELECT c.*, s.source_size, s.target,
         (s.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / nullif(sum(words * digits) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE, 0) AS scale
  FROM classes c JOIN shares s ON c.source IS NOT DISTINCT FROM s.source),
expected AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3::DOUBLE, coalesce(max(CASE WHEN scale * digits <= 3 THEN scale END) OVER (PARTITION BY source), 3::DOUBLE) * digits) ELSE 0 END AS copies
  FROM scaled),
chances AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS chance,
         target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS BIGINT) AS missing FROM expected),
ranked AS (
  SELECT s.*, c.source_size, c.target, c.whole, c.missing, c.chance,
         ((draw / (1 - draw)) / (chance / (1 - chance))) AS odds
  FROM sized s JOIN chances c ON s.source IS NOT DISTINCT FROM c.source AND length(bin(s.size)) = c.digits),
run AS (
  SELECT *, odds / (1 + odds) AS rank, sum(CASE WHEN chance > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY chance > 0 DESC, odds / (1 + odds), doc_id) - size AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN chance > 0 AND upto + size / 2::DOUBLE <= missing THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM run
""",
    # every order walked through the masks
    "op11_filter_audit": r"""
WITH firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
judged AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failing AS (
  SELECT w.doc_id, part,
         (len(words) < 50)::INT AS fa, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS fb,
         (100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * len(w.text))::INT AS fc, regexp_matches(w.text, '[#$%&*|]')::INT AS fd,
         coalesce(w.doc_id > f.first, FALSE)::INT AS fe, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM worded w JOIN firsts f ON w.text = f.text LEFT JOIN judged j ON w.doc_id = j.doc_id),
masks AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
walked AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM walked
""",
    "op12_phrase_streams": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded WHERE len(w) > 2),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
split AS (SELECT lang, k, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail FROM cand, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT s.lang, s.k, s.phrase, s.a, s.c, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * s.a * s.a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM split s JOIN f h ON h.lang = s.lang AND h.k = s.c AND h.phrase = s.head JOIN f t ON t.lang = s.lang AND t.k = s.k - s.c AND t.phrase = s.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
held AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM cand WHERE k = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN longer g ON o.k = 2 AND o.lang = g.lang AND o.phrase = g.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
""",
    "op13_line_runs": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS largest FROM keyed WHERE len(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, coalesce(k.doc_id <> f.largest, FALSE) AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
