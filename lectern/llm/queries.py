"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contentsort, decontaminate, langid, merkle, minmax, packing, pii, planes, sharding, trie, vectors, warc
from .common import table
from .tokenizing import tokenizer_path

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), "answer")


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the ring with bounded loads."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in bit-plane files, read back."""
    return planes.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents over two-word shingles."""
    found = minmax.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of all documents."""
    return pii.report(table(spark, sf_dir, "documents"))


CONTROL_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one made of control strings, formatted,
    written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.round_trip(spark, turns.unionByName(extra))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and witness of every document; every fifth one is
    verified with a tampered text."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.every_fifth())


def op12_truncation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest id of each group stays."""
    return contentsort.copies(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language,
        op2_decontamination,
        op3_ring_sharding,
        op4_bit_planes,
        op5_warc,
        op6_embedding_neighbours,
        op7_harmonic_packing,
        op8_minmax,
        op9_pii,
        op10_chat,
        op11_merkle_manifest,
        op12_truncation_trie,
        op13_content_sort,
    )
}


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text in DuckDB: a byte, then eight shifts, as
    steps of one fold."""
    steps = f"flatten(list_transform(range(length({text})), lambda i: [ascii(substr({text}, i + 1, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN s >= 0 THEN xor(crc, s) ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), lambda crc, s: {step}), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """Unrolled levels, enough for 16 ** levels documents a source."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def leaf(text: str) -> str:
        values = ["doc_id", "source", "lang", "n_chars", text]
        parts = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
        return f"sha256({' || '.join(parts)})"

    def tree(p: str) -> list[str]:
        out = []
        for k in range(levels):
            run = "OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(
                f"{p}s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, "
                f"coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {p}n{k})"
            )
            out.append(
                f"{p}n{k + 1} AS (SELECT t.g, t.i // 16 AS i, CASE WHEN max(t.n) > 1 THEN sha256(string_agg(t.h, '' ORDER BY t.i)) "
                f"ELSE max(t.h) END AS h, (max(t.n) + 15) // 16 AS n FROM {p}n{k} t GROUP BY t.g, t.i // 16)"
            )
        return out

    def walk(w: str, p: str) -> list[str]:
        return [
            f"{w}{k + 1} AS (SELECT doc_id, source, w.g, w.i // 16 AS i, leaf, CASE WHEN n > 1 THEN sha256(pre || f || post) ELSE f END AS f, "
            f"proof || CASE WHEN n > 1 THEN pre || post ELSE '' END AS proof FROM {w}{k} w JOIN {p}s{k} s ON w.g = s.g AND w.i = s.i)"
            for k in range(levels)
        ]

    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS source, {leaf('text')} AS leaf, CASE WHEN "
        f"{_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS changed FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "an0 AS (SELECT source AS g, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM r)",
        *tree("a"),
        f"bn0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM an{levels})",
        *tree("b"),
        "aw0 AS (SELECT doc_id, source, source AS g, i, leaf, coalesce(changed, leaf) AS f, '' AS proof FROM r)",
        *walk("aw", "a"),
        f"bw0 AS (SELECT doc_id, source, 0 AS g, b.i, leaf, f, proof FROM aw{levels} w JOIN bn0 b ON w.source = b.name)",
        *walk("bw", "b"),
    ]
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified
        FROM bw{levels} w JOIN an{levels} a ON w.source = a.g CROSS JOIN bn{levels} b"""


ORACLES: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, h, strlen(h) AS n,
                          CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first
                   FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM q
    """,
    "op10_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), t AS (
            SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
                   4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '\\|</turn>|### ')) + 9 AS chars
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(length(said)) AS BIGINT) AS loss_chars,
               sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op12_truncation_trie": f"""
        WITH r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
                          sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS value
                   FROM conversations WHERE conv_id IS NOT NULL),
             t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, value) - 1 AS i FROM r),
             c AS (SELECT DISTINCT conv_id, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM r),
             s AS (SELECT c.conv_id, 0 AS part, i, value, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i < h
                   UNION ALL SELECT conv_id, 1, i, value, chars FROM t JOIN c USING (conv_id) WHERE i >= h),
             b AS (SELECT conv_id, list(value ORDER BY part, i) AS v, list(chars ORDER BY part, i) AS w FROM s GROUP BY conv_id),
             f AS (SELECT conv_id, coalesce(v, []::VARCHAR[]) AS v, coalesce(w, []::BIGINT[]) AS w FROM c LEFT JOIN b USING (conv_id)),
             p AS (SELECT conv_id, v, w, unnest(range(0, len(v) + 1)) AS depth FROM f),
             n AS (SELECT depth, array_to_string(v[1:depth], ',') AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
                          any_value(v[1:depth]) AS vs, coalesce(any_value(w[depth]), 0) AS chars,
                          coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(v) = depth), '') AS ended
                   FROM p GROUP BY 1, 2),
             e AS (SELECT *, array_to_string(vs[1:depth - 1], ',') AS pk FROM n),
             k AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY 1, 2),
             m AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN k USING (depth, k)),
             a AS (SELECT vs, unnest(range(0, depth + 1)) AS depth, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * chars AS saved FROM m),
             u AS (SELECT depth, array_to_string(vs[1:depth], ',') AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY 1, 2)
        SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ended) AS ends_sha256
        FROM m JOIN u USING (depth, k) LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.k = m.pk
    """,
    "op13_content_sort": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
