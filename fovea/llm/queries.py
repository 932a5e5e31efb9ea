"""Queries of this subpackage over the given tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fovea.llm import bpe_stream, chat_format, exact_dedup, html_extract, lexical_search, near_dedup, packing, phrase_mining, quality_classifier, quality_rules, sharding, substring_dedup, token_counts

N_SHARDS = 24
TOKEN_LIMIT = 512
SEQUENCE_TOKENS = 2048
GOOD_SCORE = 0.3
# The conversation that is added to the table.
ADDED_CONVERSATION, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), N_SHARDS)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKEN_LIMIT)


@query
def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score_documents(docs, labels, GOOD_SCORE)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), SEQUENCE_TOKENS)


@query
def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.fertility_rules(table(spark, sf_dir, "documents"))


@query
def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op7_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


@query
def op8_relative_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_decode(table(spark, sf_dir, "documents"))


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    added = chat_format.message_record(rows, ADDED_CONVERSATION, [("user", ADDED_TEXT), ("assistant", ADDED_TEXT)])
    return chat_format.digests(chat_format.format_chats(chat_format.row_records(rows).unionByName(added)))


@query
def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


LLM_SQL["op7_grace_dedup"] = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY text)"""

# Jump hash as a walk per document; CRC-32 as a fold over the bytes with the table of its polynomial.
LLM_SQL["op1_jump_shards"] = f"""
    WITH RECURSIVE
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    bytes AS (SELECT doc_id, rowid AS rid, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h
              FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
    digits AS (SELECT doc_id, rid, n, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(h, '..')] AS b FROM bytes),
    crc AS (SELECT doc_id, rid, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM digits, crc_table),
    walk AS (
        SELECT rid, w.shards, coalesce(doc_id, -1)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM crc, (VALUES ({N_SHARDS}), ({N_SHARDS + 1})) w(shards)
        UNION ALL
        SELECT rid, shards, s, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT rid, shards, j, ((CASE WHEN k < 0 THEN k + 18446744073709551616 ELSE k END)::UHUGEINT * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS s FROM walk WHERE j < shards)),
    ends AS (SELECT rid, shards, max(b) AS shard FROM walk GROUP BY rid, shards)
    SELECT doc_id, (n + 8)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, a.shard::INT AS shard,
           row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, n) - 1 AS slot, g.shard::INT AS grown_shard
    FROM crc JOIN ends a ON a.rid = crc.rid AND a.shards = {N_SHARDS} JOIN ends g ON g.rid = crc.rid AND g.shards = {N_SHARDS + 1}"""

LLM_SQL["op8_relative_factors"] = r"""
    WITH w AS (SELECT doc_id, rid, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words
               FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
    win AS (SELECT doc_id, rid, i, array_to_string(words[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(words) - 11)) u(i)),
    low AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING count(*) > 1),
    hit AS (SELECT rid, i FROM win JOIN low USING (k) WHERE least < doc_id),
    gone AS (SELECT DISTINCT rid, j FROM hit, unnest(range(i, i + 13)) u(j)),
    flags AS (SELECT rid, list(j) AS js FROM gone GROUP BY rid),
    spelled AS (SELECT rid, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM w),
    each AS (SELECT s.rid, string_agg(word, ' ' ORDER BY s.j) AS kept FROM spelled s LEFT JOIN gone g ON g.rid = s.rid AND g.j = s.j WHERE g.rid IS NULL GROUP BY s.rid)
    SELECT doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN flags USING (rid) LEFT JOIN each USING (rid)"""

LLM_SQL["op11_chat_format"] = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT * FROM (VALUES ({ADDED_CONVERSATION}, 0, 'user', '{ADDED_TEXT}'), ({ADDED_CONVERSATION}, 1, 'assistant', '{ADDED_TEXT}')) v),
    e AS (SELECT *, length('### ' || url_encode(role) || ':?' || '?</turn>?') + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) AS n FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""

LLM_SQL["op12_dual_tree_search"] = r"""
    WITH terms AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM terms WHERE len(terms) > 0),
    items AS (SELECT item_id, row_number() OVER () AS iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
    q AS (SELECT item_id, iid, term, count(*) AS times FROM items GROUP BY ALL),
    tf AS (SELECT rid, doc_id, len(terms) AS n, term, count(*) AS tf FROM terms, unnest(terms) u(term) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
    scored AS (SELECT iid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
               FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY iid, item_id, rid, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid)::INT AS rank, doc_id, score FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid) <= 10"""

LLM_SQL["op13_phrase_mining"] = r"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
    w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS words FROM p),
    g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) a(k), unnest(range(1, len(words) - k + 2)) b(i)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT * FROM f x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.a = x.a AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
    parts AS (SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest FROM c, unnest(range(1, k)) u(j)),
    cuts AS (SELECT p.lang, p.phrase, p.a, j, l.a AS l, r.a AS r, n, ((1000::HUGEINT * p.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
             FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = head JOIN f r ON r.lang = p.lang AND r.phrase = rest JOIN totals t ON t.lang = p.lang),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score FROM best
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
