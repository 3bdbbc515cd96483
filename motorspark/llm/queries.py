"""The queries of this folder and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm import whitening
from motorspark.llm.codebooks import compressed, hex_code, with_label_error
from motorspark.llm.common import ship
from motorspark.llm.language_id import identified
from motorspark.llm.licenses import license_scan
from motorspark.llm.near_duplicates import near_duplicates
from motorspark.llm.packing import packed_documents
from motorspark.llm.permutation_index import nearest
from motorspark.llm.pieces import decoded, encoded
from motorspark.llm.quality import held_out, quality_scores
from motorspark.llm.repeats import without_repeats
from motorspark.llm.token_files import through_files
from motorspark.llm.top_k import exact_top_k
from motorspark.llm.url_filters import url_verdicts

#: The rules of the url query, as host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(read(spark, sf_dir, "pages"), rules)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = through_files(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1, spaces=False, specials=True)
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("first").alias("is_first"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    found = decoded(encoded(read(spark, sf_dir, "documents"), path), path)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.concat_ws(",", "labels_of_phrases").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
    )


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, size=1024, with_ids=False, specials=True)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", F.col("n").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, scale=64, components=32)
    rows = whitening.whitened(vectors, model, keep=("vec_id",), scale=64)
    explained = F.array(*(F.lit(float(x)) for x in model.explained)) if model else F.array().cast("array<double>")
    error = whitening.identity_error(vectors, model, scale=64) if model else 0.0
    each = rows.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compressed(read(spark, sf_dir, "embeddings"), keep=("vec_id", "label"), parts=8, entries=16, rounds=6, scale=4096)
    whole = [F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("error", "label_error")]
    return with_label_error(found.rows).select("row.vec_id", hex_code("codes").alias("code"), *whole, F.lit(found.digest).alias("codebooks_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    found = identified(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filters": op2_url_filters,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_license_scan": op7_license_scan,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_permutation_index": op10_permutation_index,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_id": op13_language_id,
}


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op12 written out one after the other."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, label, embedding AS raw,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"size AS MATERIALIZED (SELECT CAST(ceil(max(len(v)) / {float(parts)}) AS BIGINT) AS s FROM kept)",
        f"""pieces AS MATERIALIZED (SELECT n, p, list_transform(range(p * s, p * s + s), lambda i: coalesce(v[i + 1], 0)) AS x
  FROM kept, size, (SELECT unnest(range({parts})) AS p))""",
        f"""book0 AS MATERIALIZED (SELECT p, e, x FROM pieces JOIN (SELECT n, row_number() OVER (ORDER BY vec_id NULLS LAST, raw) - 1 AS e
  FROM kept) USING (n) WHERE e < {entries})""",
    ]
    nearest = """(SELECT n, p, min({{'d': list_sum(list_transform(list_zip(pieces.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
  FROM pieces JOIN book{r} b USING (p) GROUP BY n, p)"""
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED {nearest.format(r=r)}")
        steps.append(
            f"""mean{r} AS MATERIALIZED (SELECT p, e, list(CAST((t - ((t % c + c) % c)) // c AS BIGINT) ORDER BY i) AS x FROM
  (SELECT p, m.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS c FROM near{r} JOIN pieces USING (n, p), size, unnest(range(1, s + 1)) AS u(i) GROUP BY ALL)
  GROUP BY p, e)"""
        )
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.x, book{r}.x) AS x FROM book{r} LEFT JOIN mean{r} USING (p, e))")
    steps.append(f"last AS MATERIALIZED {nearest.format(r=rounds)}")
    steps.append("codes AS MATERIALIZED (SELECT n, string_agg(format('{:02x}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY n)")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (n)"""


SQL: dict[str, str] = {
    "op12_vector_codes": vector_codes_sql(),
    "op2_url_filters": """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
parts AS (SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
fits AS (SELECT p.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.place = 1""",
    "op3_exact_top_k": """
WITH numbered AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM numbered q JOIN numbered c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
