"""One query for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import warc

    records = warc.read_back(warc.written(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from scriptorium.llm import packing

    pieces = packing.tokenized(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import hmm, language_id

    fold = language_id.fold(10)
    return hmm.scores(_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import quality_rules

    return quality_rules.rules(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import decontamination

    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from scriptorium.llm import chat

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.windows(chats, public_tokenizers.path("byte_bpe_50k.json")))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import substring_dedup

    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import language_id

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.fold(3) != 1))
    docs = docs.select("doc_id", "text", F.coalesce(language_id.fold(3) == 1, F.lit(False)).alias("held_out"))
    return language_id.with_language(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import weak_labels

    return weak_labels.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import ngram_join

    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import turn_repair

    chats = _table(spark, sf_dir, "conversations")
    return turn_repair.report(chats, turn_repair.damaged(chats))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from scriptorium.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.decoded(byte_bpe.encoded(_table(spark, sf_dir, "documents"), path), path)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import lexical_search

    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_hmm_language_model, op3_robust_outliers, op4_decontamination, op5_packing, op6_chat, op7_compact_windows, op8_language_id, op9_weak_labels, op10_ngram_jaccard_join, op11_turn_repair, op12_byte_bpe, op13_lexical_search)}

SQL = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op11_turn_repair": r"""
        WITH RECURSIVE crcs AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
        ), kinds AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 20 AS kind
            FROM conversations, crcs
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM kinds, range(2) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged
        ), judged AS (
            SELECT *, substr(role, 1, 1) AS initial,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), moves(q, said, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
        ), inserts(p, q, before) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'IJ'), (1, 2, 'I'), (1, 3, 'IJ'), (2, 3, 'J'), (3, 2, 'I')
        ), edits AS (
            SELECT p, r, initial, fault, 2 * len(before) + cost AS cost, before || edit AS script
            FROM inserts, (VALUES ('s'), ('u'), ('a'), ('x')) AS i(initial), (VALUES ('blank'), ('duplicate'), ('truncated'), ('')) AS f(fault),
                 LATERAL (SELECT 'D' AS edit, q AS r, 3 AS cost
                          UNION ALL SELECT e, m.r, c + CAST(fault = 'truncated' AS INTEGER) FROM moves m, (VALUES ('K', 0), ('R', 2), ('S', 2)) AS k(e, c)
                          WHERE m.q = inserts.q AND fault NOT IN ('blank', 'duplicate') AND m.said = CASE e WHEN 'K' THEN initial WHEN 'R' THEN 'u' ELSE 'a' END)
        ), walked(conv_id, place, q, best) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'script': ''} FROM judged
            UNION ALL
            SELECT j.conv_id, j.place, e.r, min({'cost': w.best.cost + e.cost, 'script': w.best.script || e.script})
            FROM walked w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place + 1
            JOIN edits e ON e.p = w.q AND e.fault = j.fault AND e.initial = CASE WHEN j.initial IN ('s', 'u', 'a') THEN j.initial ELSE 'x' END
            GROUP BY j.conv_id, j.place, e.r
        ), sizes AS (
            SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM judged GROUP BY conv_id
        ), scripts AS (
            SELECT w.conv_id, min({'cost': best.cost + 2 * len(l.last), 'script': best.script || l.last}) AS best
            FROM walked w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.place
            JOIN (VALUES (0, ''), (1, 'IJ'), (2, 'J'), (3, '')) AS l(q, last) USING (q) GROUP BY w.conv_id
        ), letters AS (
            SELECT conv_id, unnest(string_split(best.script, '')) AS edit, generate_subscripts(string_split(best.script, ''), 1) AS number FROM scripts WHERE best.script <> ''
        ), numbered AS (
            SELECT *, count(*) FILTER (edit NOT IN ('I', 'J')) OVER (PARTITION BY conv_id ORDER BY number) AS place FROM letters
        ), digests AS (
            SELECT n.conv_id, sha256(string_agg(CASE edit WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'R' THEN 'user:' || text WHEN 'S' THEN 'assistant:' || text ELSE role || ':' || text END, chr(10) ORDER BY number)) AS digest
            FROM numbered n LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.place = n.place
            WHERE edit <> 'D' GROUP BY n.conv_id
        ), illegals AS (
            SELECT conv_id, count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM judged) GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(translate(best.script, 'JS', 'IR'), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN illegals i ON i.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN scripts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), i AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL
        ), total AS (
            SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
        ), tf AS (
            SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(terms) AS n, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM i) GROUP BY doc_id, r, n, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
        ), s AS (
            SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM tf JOIN w USING (term) JOIN i USING (term), total GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0
        QUALIFY rank <= 20
    """,
}
