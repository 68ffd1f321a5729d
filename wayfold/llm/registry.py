"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    hash_tree,
    html_extract,
    language_id,
    ngram_join,
    prefix_trie,
    role_repair,
    secret_scan,
    source_mix,
    toxicity,
    url_lists,
)
from wayfold.llm.common import table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The list history and the fetch days that the query derives from the pages: every page adds one dated
#: entry for its host, or for the parent domain if its id leaves 3 when divided by 4, and is one capture.
LIST_START = "2024-01-01"
LIST_ACTIONS = ("block", "allow", "remove", "block")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.to_date(F.lit(LIST_START))
    host = url_lists.url_host("url")
    action = F.element_at(F.array(*map(F.lit, LIST_ACTIONS)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    parent = F.when((F.pmod("page_id", F.lit(4)) == 3) & (F.size(F.split(host, r"\.")) > 2), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    entries = pages.select(
        parent.alias("domain"), F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(360)).cast("int")).alias("day"), action.alias("action"), F.col("page_id").alias("entry_id")
    )
    captures = pages.withColumn("fetch_day", F.date_add(start, F.pmod(F.col("page_id") * 101, F.lit(360)).cast("int")))
    return url_lists.judge_captures(captures, entries).select(
        "capture.page_id", "capture.url", "capture.fetch_day", "host", "listed_domain", "action", "valid_from", "valid_to", "blocked"
    )


#: A conversation of control strings that the query adds to the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    return chat_format.digest_chats(chat_format.format_chats(turns.unionByName(added), turn_local=True))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    told = language_id.predict_languages(docs, fold != 2)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


#: Shards of the query's tree: two regions of two racks of two; the grown tree has one more, in a new region.
SHARDS = 8


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"), hash_tree.layout(SHARDS), hash_tree.layout(SHARDS + 1))


#: The longest opening that the query lends, plus one, and the ids that share a lender.
OPENING, LENDER = 6, 100


def lend_openings(gathered: DataFrame) -> DataFrame:
    """Conversations whose first turns, crc32(id) % 6 of them, are those of the conversation whose id ends in 00."""
    own = gathered.withColumn("_h", (F.crc32(F.col("conv_id").cast("string")) % OPENING).cast("int"))
    lenders = gathered.filter(F.col("conv_id") % LENDER == 0).select(F.col("conv_id").alias("_lender"), F.slice("turns", 1, OPENING - 1).alias("_opening"))
    joined = own.withColumn("_lender", F.col("conv_id") - F.col("conv_id") % LENDER).join(lenders, "_lender", "left")
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    lent = F.slice("_opening", F.lit(1), F.col("_h"))
    return joined.select("conv_id", F.when(lent.isNull(), rest).otherwise(F.concat(lent, rest)).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(lend_openings(prefix_trie.gather(table(spark, sf_dir, "conversations"))))


def damage(turns: DataFrame) -> DataFrame:
    """Rows that are dropped, emptied, cut off, repeated or given another role, by crc32(``conv_id:turn``) % 20."""
    space = F.lit(" ")
    turns = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    hurt = turns.withColumn("_fault", fault).filter("_fault <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return hurt.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("_copy"),
    ).drop("_copy")


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return role_repair.repair(damage(turns), turns.select("conv_id"))


#: CRC-32 of a list of bytes, with its table made by its rule.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _draw_sql(key: str, weights: dict[str, str]) -> str:
    """The child of the smallest draw; ``weights``: SQL of a child's path to SQL of its weight."""
    drawn = ", ".join(f"{{'s': -ln((CAST('0x' || md5({key} || '|' || {p})[:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {w}, 'p': {p}}}" for p, w in weights.items())
    return f"list_sort([{drawn}])[1].p"


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, {_CRC_TABLE}
), r AS (SELECT *, {_draw_sql("k", {"'0/r0'": "4.0", "'0/r1'": "4.0"})} AS region, {_draw_sql("k", {"'0/r0'": "4.0", "'0/r1'": "4.0", "'1/r2'": "1.0"})} = '1/r2' AS moves FROM d
), c AS (SELECT *, {_draw_sql("k", {"region || '/k0'": "2.0", "region || '/k1'": "2.0"})} AS rack, FROM r
), n AS (SELECT *, CAST(region[4:] AS INTEGER) * 4 + CAST(rack[-1:] AS INTEGER) * 2 AS low FROM c
), s AS (SELECT *, CAST(string_split({_draw_sql("k", {"rack || '/' || low": "1.0", "rack || '/' || (low + 1)": "1.0"})}, '/')[4] AS INTEGER) AS shard FROM n)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CASE WHEN moves THEN 8 ELSE shard END AS grown_shard
FROM s
"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT c, {_crc_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM t, {_CRC_TABLE}
), rebuilt AS (
  SELECT ids.c, 0 AS part, t.i, t.h, t.chars FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND t.i <= ids.h
  UNION ALL SELECT ids.c, 1, t.i, t.h, t.chars FROM ids JOIN t ON t.c = ids.c AND t.i > ids.h
), turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, h, chars FROM rebuilt
), members AS (
  SELECT c, d, string_agg(h, '/') OVER (PARTITION BY c ORDER BY d) AS path, chars FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM ids
), lens AS (SELECT c, max(d) AS len FROM members GROUP BY c
), nodes AS (
  SELECT path, any_value(d) AS d, min(c) AS owner, count(*) AS n, any_value(chars) AS chars,
         string_agg(CASE WHEN len = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM members JOIN lens USING (c) GROUP BY path
), up AS (
  SELECT x.*, p.path AS parent, p.owner AS parent_owner
  FROM nodes x LEFT JOIN members m ON m.c = x.owner AND m.d = x.d - 1 LEFT JOIN nodes p ON p.path = m.path
), kids AS (SELECT parent AS path, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT m.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((x.n - 1) * x.chars) AS saved
  FROM nodes x JOIN members m ON m.c = x.owner AND m.d <= x.d LEFT JOIN kids k ON k.path = x.path GROUP BY m.path
)
SELECT owner AS conv_id, CAST(d AS BIGINT) AS depth, parent_owner AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM up JOIN below USING (path) LEFT JOIN kids USING (path)
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         nullif(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')), '\.$', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id * 101 % 360 AS INTEGER) AS DATE) AS fetch_day
  FROM pages
), e AS (
  SELECT CASE WHEN page_id % 4 = 3 AND len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS domain,
         CAST(DATE '2024-01-01' + CAST(page_id * 37 % 360 AS INTEGER) AS DATE) AS day,
         CASE page_id % 4 WHEN 1 THEN 'allow' WHEN 2 THEN 'remove' ELSE 'block' END AS action, page_id AS entry_id
  FROM p
), daily AS (
  SELECT domain, day, arg_max(action, entry_id) AS action FROM e WHERE domain IS NOT NULL GROUP BY ALL
), intervals AS (
  SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM daily
), chains AS (
  SELECT page_id, fetch_day, s.i AS steps_up, array_to_string(string_split(host, '.')[s.i:], '.') AS domain
  FROM p, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i) s WHERE host IS NOT NULL
), hits AS (
  SELECT c.page_id, i.*, row_number() OVER (PARTITION BY c.page_id ORDER BY c.steps_up) AS r
  FROM chains c JOIN intervals i ON c.domain = i.domain AND i.valid_from <= c.fetch_day AND (i.valid_to IS NULL OR c.fetch_day < i.valid_to)
  WHERE i.action <> 'remove'
)
SELECT p.page_id, p.url, p.fetch_day, p.host, h.domain AS listed_domain, h.action, h.valid_from, h.valid_to, coalesce(h.action = 'block', FALSE) AS blocked
FROM p LEFT JOIN (SELECT * FROM hits WHERE r = 1) h ON p.page_id = h.page_id
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_source_mix": op3_source_mix,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_chat_format": op8_chat_format,
    "op9_html_extract": op9_html_extract,
    "op10_language_id": op10_language_id,
    "op11_hash_tree": op11_hash_tree,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_role_repair": op13_role_repair,
}
ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op7_url_filter": OP7_SQL,
    "op11_hash_tree": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
