"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import roundtrip

    return roundtrip(_table(spark, sf_dir, "pages"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenid import read_ids, write_ids

    return read_ids(*write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import roundtrip

    return roundtrip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordbpe import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, roundtrip

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(*own.columns)
    return digests(roundtrip(rows.unionByName(own)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_embeddings": op3_embeddings,
    "op4_personal_data": op4_personal_data,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_token_ids": op7_token_ids,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scores": op10_lm_scores,
    "op11_search": op11_search,
    "op12_spelling": op12_spelling,
    "op13_chat": op13_chat,
}

SQL: dict[str, str] = {
    "op1_minhash": """
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM t),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
        r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
    """,
    "op3_embeddings": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (
            SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.9),
        r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root)
        SELECT m.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.root AS component_id, m.id = m.root AS kept
        FROM (SELECT id, min(root) AS root FROM r GROUP BY id) m LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = m.id
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op11_search": """
        WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        g AS (SELECT sum(len(w))::BIGINT AS l, count(*)::BIGINT AS n FROM t WHERE len(w) > 0),
        p AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t),
        f AS MATERIALIZED (SELECT doc_id, term, any_value(n)::BIGINT AS n, count(*)::BIGINT AS tf FROM p GROUP BY doc_id, term),
        q AS MATERIALIZED (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, g.n),
        s AS (SELECT item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * f.n * g.n) // g.l))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_chat": """
        WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|/?INST\\]|/?SYS\\]|ROLE:|/ROLE\\]|SEP\\])', '\\1\\2\\\\\\3', 'g')) AS n,
                     lag(role) OVER w IS DISTINCT FROM role OR lag(conv_id) OVER w IS NULL AS new
              FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        m AS (SELECT *, n + CASE WHEN NOT new THEN 5 WHEN role = 'user' THEN 15 WHEN role = 'system' THEN 13 WHEN role = 'assistant' THEN 5
                             ELSE 16 + length(regexp_replace(role, '([\\\\\\]])', '\\\\\\1', 'g')) END AS piece FROM e),
        c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, 3 + sum(piece) AS formatted_chars
              FROM m GROUP BY conv_id)
        SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
