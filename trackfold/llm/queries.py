"""The ``opN_<name>`` queries with production parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive, bytebpe, chat, contamination, infill, langid, licences, nearcopies, partcodes, pieces, surrogates, tokenfiles, urlrules
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine; workers have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words hit by 13-word benchmark windows, items found, and whether it is contaminated."""
    report = contamination.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class of near copies (the smallest doc_id in it), copies of its shingles, and size of the class."""
    return nearcopies.near_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_class")


def op5_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each row whose vec_id is divisible by 100."""
    return additive.neighbours(read_table(spark, sf_dir, "embeddings"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its piece ids, digest of the text decoded from them."""
    return pieces.piece_digests(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its predicted language, and the score."""
    return langid.language_report(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its ids start, how many there are, and their checksum, read back from the token files."""
    return tokenfiles.token_report(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


#: The rules of op7 as (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits best, and the verdict."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.with_verdict(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def pii_key(spark: SparkSession) -> bytes:
    """The surrogates' key: ``trackfold.pii.key`` of the session.  Where it is unset a random one is made for the session,
    so that nobody can invert the surrogates; set the key to get the same surrogates in another session."""
    if not spark.conf.get("trackfold.pii.key", None):
        spark.conf.set("trackfold.pii.key", secrets.token_hex(32))
    return spark.conf.get("trackfold.pii.key").encode()


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text with surrogates, the kinds of entities found, and their number."""
    return surrogates.pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the licence families that its lines state, how many do, and how many only speak of licences."""
    return licences.licence_report(read_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its turns and the text under the loss mask as read back from the formatted output."""
    report = chat.chat_report(read_table(spark, sf_dir, "conversations"), tokenizer_file("byte_bpe_50k.json"))
    return report.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: codes of its eight parts, squared error, error of its label, digest of all codebooks."""
    return partcodes.compressed(read_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its byte-level BPE ids, digest of the bytes decoded from them."""
    import public_tokenizers

    return bytebpe.token_digests(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its units, its fill-in-middle form, and digests of the output and of the text rebuilt from it."""
    return infill.rearranged(read_table(spark, sf_dir, "documents"), texts=False)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_language, op3_token_files, op4_near_copies, op5_additive, op6_pieces, op7_url_rules, op8_surrogates, op9_licences, op10_chat, op11_part_codes, op12_byte_bpe, op13_infill)}
_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_CONTROL = r"([<\[])(\\*)(/TURN\]|/INST\]|/ROLE\]|/SYS\]|INST\]|ROLE\]|SYS\]|/s>|s>)"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, array_to_string(w[p + 1 : p + 13], ' ') AS g, least(13, len(w)) AS n FROM (SELECT *, unnest(range(greatest(1, len(w) - 12))) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d CROSS JOIN sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, item, p, dw.n FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_chat": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), e AS (
            SELECT *, regexp_replace(text, '{_CONTROL}', '\\1\\\\\\2\\3', 'g') AS t, regexp_replace(role, '{_CONTROL}', '\\1\\\\\\2\\3', 'g') AS r FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               3 + sum(length(t) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4 ELSE 20 + length(r) END) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op13_infill": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
            FROM documents
        ), h AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS head, coalesce(array_to_string(u[a + 1:b], ''), '') AS body, coalesce(array_to_string(u[b + 1:n], ''), '') AS tail FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(body) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body ELSE '<S>' || tail || '<P>' || head || '<M>' || body END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op7_url_rules": """
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), r(h, p, v) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), m AS (
            SELECT page_id, host, path, r.h || r.p AS rule, r.v AS verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS n
            FROM p LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
    """,
}
