"""The registered queries over these operators: thin wrappers that read a table and derive the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, conversation_trie, exact, packing, personal, sharding, simhash, spelling, substring, suffix_array, toxicity, warc
from .common import table

THRESHOLD = 0.3


def held_out() -> Column:
    """Rows that no training sees: those whose crc32(doc_id) leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).drop("part")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats_by_index(table(spark, sf_dir, "documents")).drop("spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")), "UTF-8"))
    gone = F.when(h % 199 == 0, h % F.char_length("run"))
    return spelling.variants(spelling.words_of(table(spark, sf_dir, "documents"), gone))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    return conversation_trie.prefix_trie(*conversation_trie.splice(turns, base=conv - conv % 5, reach=F.crc32(conv.cast("string").cast("binary")) % 9, most=8))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_simhash, op4_sharding, op5_packing, op6_substring_dedup, op7_warc, op8_suffix_array_dedup, op9_exact_dedup, op10_ann, op11_personal_data, op12_spelling_variants, op13_conversation_trie)}

#: CRC-32 (polynomial 0xEDB88320, reflected) of a decimal number's digits, in DuckDB: one step a bit of each byte.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

#: DuckDB twins, where SQL can express the result over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND m <> page_id THEN m END AS refers_to FROM s""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
        f AS (SELECT s, min(doc_id) AS m FROM h GROUP BY s HAVING count(DISTINCT doc_id) > 1),
        r AS (SELECT doc_id, list(i) AS places FROM (SELECT h.doc_id, h.i FROM h JOIN f USING (s) WHERE h.doc_id > f.m) GROUP BY doc_id),
        c AS (SELECT r.doc_id, list_distinct(flatten(list_transform(places, lambda x: range(x, x + 13)))) AS gone FROM r),
        k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END AS kept FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op13_conversation_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS d FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT DISTINCT c, {_CRC32.format("c")} % 9 AS h FROM t),
        b AS (SELECT k.c, t.d, r, x FROM k JOIN t ON t.c = k.c - k.c % 5 AND t.d <= h UNION ALL SELECT t.c, 100 + t.d, r, x FROM t JOIN k USING (c) WHERE t.d > h),
        m AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY d) AS d, strlen(x) AS n, sha256(concat(strlen(r), ':', r, x)) AS s FROM b),
        p AS (SELECT c, d, n, sha256(string_agg(s, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM m UNION ALL SELECT c, 0, 0, 'root' FROM k),
        q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM p),
        v AS (SELECT node, min(c) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, max(n) AS n, coalesce(string_agg(CASE WHEN last THEN c END::VARCHAR, ',' ORDER BY c), '') AS ends FROM q GROUP BY node),
        g AS (SELECT parent AS node, count(*) AS n_children FROM v WHERE parent IS NOT NULL GROUP BY parent),
        w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN g USING (node)),
        u AS (SELECT a.node, sum((w.n_children = 0)::BIGINT) AS n_leaves, sum((w.n_convs - 1) * w.n) AS saved_tokens FROM w JOIN q AS a ON a.c = w.conv_id AND a.d <= w.depth GROUP BY a.node)
        SELECT w.conv_id, w.depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
        FROM w JOIN u USING (node) LEFT JOIN w AS o ON o.node = w.parent""",
}
