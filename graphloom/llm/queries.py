"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (
    chat_rotation,
    decontaminate,
    embedding_links,
    filter_audit,
    html_extract,
    importance,
    license_scan,
    mixing,
    quality,
    substring_dedup,
    superminhash,
    token_counts,
    toxicity,
)

VOCABULARY = "byte_bpe_50k"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_draws and draws (shard:place of each, in order of epochs) tell where the splitting tree put what it takes."""
    place = F.transform("draws", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["place"].cast("string")))
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"), F.array_join(place, ",").alias("draws"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = token_counts.Encoder(public_tokenizers.path(f"{VOCABULARY}.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), encoder, limit=512)


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents"), F.col("lang"))
    return filter_audit.audit(filter_audit.labelled(failed, table(spark, sf_dir, "labels")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_links": op5_embedding_links,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_superminhash": op9_superminhash,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance": op12_importance,
    "op13_substring_dedup": op13_substring_dedup,
}
#: As SQL: a text with A-Z alone lower-cased.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        items AS (SELECT *, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark) WHERE len(w) > 0),
        item_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS found FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS k FROM items)),
        windows AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS found FROM (
            SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM words, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)),
        hits AS (SELECT r, k, size, item_id FROM windows JOIN item_windows USING (size, found)),
        counts AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + size - 1)) AS p FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS digest FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN counts USING (r) LEFT JOIN named USING (r)
    """,
    "op9_superminhash": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 4], ' ')) AS s FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op11_filter_audit": """
        WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS smallest FROM docs),
        marked AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > smallest, false) AS INT) AS mask FROM words),
        known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, mask),
        orders(o, n) AS (SELECT '', 0 UNION ALL SELECT o || f, n + 1 FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE n < 5 AND NOT contains(o, f)),
        steps AS (SELECT o, CAST(s AS INT) AS step, 1 << (ascii(o[s]) - 65) AS bit, list_sum([1 << (ascii(o[i]) - 65) FOR i IN range(1, s)]) AS earlier
            FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS s FROM orders WHERE n = 5)),
        counted AS (SELECT part, o, step, bit, coalesce(sum(n) FILTER (WHERE alone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND NOT alone), 0) AS redundant,
                coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE alone), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE alone), 0) AS toxic_lost, sum(n) AS total
            FROM (SELECT *, (mask & bit) > 0 AS fails, (mask & bit) > 0 AND (mask & CAST(coalesce(earlier, 0) AS BIGINT)) = 0 AS alone FROM masks, steps) GROUP BY part, o, step, bit)
        SELECT part, o AS filter_order, step, CAST(total - sum(removed) OVER (PARTITION BY part, o ORDER BY step) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted
    """,
    "op12_importance": f"""
        WITH crc AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY k) AS steps FROM (SELECT unnest(generate_series(0, 255)) AS k)),
        words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        wanted AS (SELECT unnest(regexp_extract_all({LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
        mine AS (SELECT r, unnest(w) AS word FROM words),
        vocabulary AS (SELECT word, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT) FOR i IN generate_series(1, length(h) // 2)]),
                lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM mine UNION SELECT word FROM wanted)), crc),
        s AS (SELECT bucket, count(*) AS n FROM mine JOIN vocabulary USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM wanted JOIN vocabulary USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM mine) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM wanted) + 10000) AS DOUBLE))) AS BIGINT) AS g
            FROM s FULL JOIN t USING (bucket)),
        weights AS (SELECT r, sum(g) AS weight FROM mine JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY r),
        scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM words LEFT JOIN weights USING (r)),
        placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM placed WHERE able) * 10 // 100 THEN place END AS rank FROM placed
    """,
    "op13_substring_dedup": """
        WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS (SELECT r, doc_id, k, hash(array_to_string(w[k:k + 49], ' ')) AS found FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS k FROM words WHERE len(w) >= 50)),
        smallest AS (SELECT found, min(doc_id) AS doc_id FROM windows GROUP BY found),
        gone AS (SELECT DISTINCT r, unnest(generate_series(k, k + 49)) AS place FROM windows JOIN smallest USING (found) WHERE windows.doc_id > smallest.doc_id),
        cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
        kept AS (SELECT r, string_agg(w[place], ' ' ORDER BY place) AS text FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS place FROM words WHERE len(w) > 0) ANTI JOIN gone USING (r, place) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
    """,
    "op8_chat_rotation": """
        WITH grouped AS (SELECT conv_id, turn, role, text, count(*) AS copies, CAST(coalesce(floor(turn / 256), -1) AS BIGINT) AS segment FROM conversations GROUP BY ALL),
        turns AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 512 AS part FROM grouped),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
        pieces AS (
            SELECT t.conv_id, s.perspective, t.segment, t.part, t.turn, t.role, t.text, t.copies,
                coalesce(t.role = s.perspective, false) AS mine,
                CASE WHEN t.role = s.perspective THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
                    ELSE '<|user ' || regexp_replace(coalesce(t.role, 'unknown'), '[<|>\\s]+', '_', 'g') || '|>' END || chr(10) AS head,
                replace(coalesce(t.text, ''), '<|', '< |') AS body
            FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment, part
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at
            FROM pieces)
        SELECT conv_id, perspective, segment, part, count(*) AS n_turns, CAST(sum(copies) - count(*) AS BIGINT) AS n_repeats,
            string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
            coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin_at + length(body) AS BIGINT) AS VARCHAR), ','
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE mine), '') AS mask_spans
        FROM placed GROUP BY conv_id, perspective, segment, part
    """,
}
