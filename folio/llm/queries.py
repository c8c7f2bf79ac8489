"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, bpe, chaining, chat, fingerprints, jaccard, language, packing, pieces, resample, secrets, suffix, topk


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; they come with the package public_tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_curve_packing(spark, sf_dir):
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_fuzzy_passages(spark, sf_dir):
    return chaining.find_passages(_docs(spark, sf_dir))


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(_docs(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_formatting(spark, sf_dir):
    return chat.digest(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op6_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_pairs(_docs(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    return suffix.scan(_docs(spark, sf_dir))


def op8_topk_search(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_jaccard_join(spark, sf_dir):
    return jaccard.similar_components(_docs(spark, sf_dir))


def op10_secret_scans(spark, sf_dir):
    return secrets.find_secrets(_docs(spark, sf_dir))


def op11_importance_resampling(spark, sf_dir):
    return resample.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_tokenizer_alignment(spark, sf_dir):
    return align.align_documents(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_sentencepiece(spark, sf_dir):
    return pieces.round_trip(_docs(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_curve_packing, op3_fuzzy_passages, op4_byte_bpe, op5_chat_formatting, op6_document_fingerprints, op7_suffix_dedup, op8_topk_search, op9_jaccard_join, op10_secret_scans, op11_importance_resampling, op12_tokenizer_alignment, op13_sentencepiece)}
ORACLES: dict[str, str] = {
    "op9_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r(doc_id, near) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near)
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(near) FROM r WHERE r.doc_id = t.doc_id) AS component_id
        FROM t LEFT JOIN n ON n.doc_id = t.doc_id
    """,
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_importance_resampling": r"""
        WITH crc AS (SELECT list(v ORDER BY i) AS step FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END) AS v FROM range(256) r(i))),
        words AS (SELECT 0 AS target, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
                  UNION ALL SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        kinds AS (
            SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) + 1), lambda k: ('0x' || substr(hex(w), 2 * k - 1, 2))::BIGINT)), lambda s, b: xor(step[(xor(s, b) & 255) + 1], s >> 8))) % 10000 AS bucket
            FROM (SELECT DISTINCT w FROM words), crc
        ),
        f AS (SELECT target, id, bucket FROM words JOIN kinds USING (w)),
        n AS (SELECT b AS bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM range(10000) r(b) LEFT JOIN f ON f.bucket = b GROUP BY b),
        g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
        w AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE target = 0 GROUP BY id),
        d AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN w ON w.id = doc_id
        ),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE n_features >= 20)
        SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM d LEFT JOIN r ON r.doc_id = d.doc_id
    """,
}
