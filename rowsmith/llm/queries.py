"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, hyperminhash, mixing, ngram_join, nra, quality, rollups, secrets, shallot, substring, toxicity, warc, whitening
from rowsmith.llm.frames import scratch, table, written

CENTROIDS, ROUNDS = 40, 5


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), size=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, with_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = [secrets.n_of(F.col("base"), k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *count, F.sha2(secrets.labels(F.col("base")), 256).alias("base_sha256"), secrets.labels(F.col("spans")).alias("spans"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = warc.captures(table(spark, sf_dir, "pages"))
    flat = whole.select(
        "capture", "copies", F.element_at("metadata.fields", "pageId").cast("long").alias("page_id"),
        F.coalesce(F.col("response.payload_bytes").cast("long"), F.element_at("metadata.fields", "payloadBytes").cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_sha256", F.expr("substring_index(response.payload_digest, ':', -1)")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"))
    flat = written(flat, "captures")
    target = flat.filter("record_type = 'response'").select(F.col("capture").alias("to"), F.col("page_id").alias("refers_to"))
    flat = flat.join(target, "to", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return flat.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nra.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def _decided(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; then every tenth is revised and another tenth deleted, in a batch that is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    kept = rollups.TokenRollups(spark, scratch(spark, "rollups"))
    kept.apply("1", docs.withColumns({"op": F.lit("insert"), "seq": F.lit(1)}))
    op = F.when(F.col("doc_id") % 10 == 3, "revise").when(F.col("doc_id") % 10 == 7, "delete")
    second = docs.withColumns({"op": op, "seq": F.lit(2), "text": F.concat_ws(" ", "text", "lang", "source")}).filter("op IS NOT NULL")
    kept.apply("2", second)
    kept.apply("2", second)
    return kept.totals()


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_toxicity, op3_quality, op4_substring_dedup, op5_secret_scan, op6_token_rollups, op7_benchmark_decontamination, op8_warc_transactions, op9_minhash_near_dedup, op10_top_k_search,
        op11_embedding_whitening, op12_ngram_jaccard_join, op13_centroid_clustering)}


def _clustering_sql(k: int, rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""
        WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM f),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS j, x
            FROM (SELECT x, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS MATERIALIZED (
            SELECT no, min(struct_pack(d := d, j := j)) AS b FROM (SELECT v.no, c.j, {distance} AS d FROM v, c{r} c) GROUP BY no)""")
        if r < rounds:
            parts.append(f"""
        s{r} AS (
            SELECT j, list(CAST(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x
            FROM (SELECT a.b.j AS j, g.i AS i, sum(v.x[g.i]) AS t, count(*) AS n FROM v JOIN a{r} a USING (no), range(1, 65) g(i) GROUP BY 1, 2) GROUP BY j),
        c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON c.j = s.j)""")
    return ",".join(parts) + f"""
        SELECT v.vec_id, a.b.j AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.j) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (no) JOIN c{rounds} c ON c.j = a.b.j"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query: text and hashing without state or sketches."""
    return {
        "op13_centroid_clustering": _clustering_sql(CENTROIDS, ROUNDS),
        "op12_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS MATERIALIZED (
                SELECT row_number() OVER () AS no, doc_id,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
                FROM documents),
            s AS MATERIALIZED (
                SELECT no, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
                    range(1, greatest(len(words) - 2, 2)), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) END AS members FROM w),
            t AS MATERIALIZED (SELECT no, len(members) AS n, unnest(members) AS token FROM s),
            p AS (
                SELECT a.no AS u, b.no AS v, a.n + b.n AS n, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.no <> b.no GROUP BY ALL),
            l AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * c >= 85 * (n - c)),
            r(no, other) AS (SELECT no, no FROM s UNION SELECT r.no, l.v FROM r JOIN l ON r.other = l.u)
            SELECT s.doc_id, len(s.members) AS n_shingles, min(o.doc_id) AS component_id
            FROM s JOIN r ON s.no = r.no JOIN s o ON o.no = r.other GROUP BY s.no, s.doc_id, len(s.members)""",
        "op8_warc_transactions": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM f""",
        "op10_top_k_search": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op4_substring_dedup": """
            WITH w AS (
                SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS words FROM documents),
            t AS (SELECT doc_id, len(words) AS n, words FROM w),
            s AS (SELECT doc_id, n, words, unnest(range(1, n - 33)) AS pos FROM t WHERE n >= 35),
            h AS (SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS h FROM s),
            r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
            c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS k FROM h JOIN r USING (h)),
            g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
            SELECT t.doc_id, n AS n_words, coalesce(len(gone), 0) AS n_removed,
                   sha256(array_to_string(CASE WHEN gone IS NULL THEN words
                       ELSE list_transform(list_filter(list_zip(words, range(1, n + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
            FROM t LEFT JOIN g USING (doc_id)""",
    }
