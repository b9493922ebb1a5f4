"""Text operators bound to the driver tables: pages, documents, conversations, customers.

Messages with references (attachments, image links) are built from each document's own text plus fixed-format
references derived from its columns, so the work grows with the documents table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.operators import text as to
from wellspark.sources.tables import table

FETCH_FAILED = "The page could not be fetched."
SMALL_BUDGET_TOKENS = 1000  # a 1 000-token model budget: 4 000-character chunks


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return to.page_text(p, "url", "html").select("page_id", "url_ok", "is_pdf", "text")


def fetched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 over stored fetches: the visible text of a page that was fetched, else the message of a failed fetch. A page
    whose URL has a fragment plays a failed fetch (404), every other one 200."""
    p = table(spark, sf_dir, "pages").withColumn(
        "status", F.when(F.col("url").contains("#"), F.lit(404)).otherwise(F.lit(200)))
    text = tx.status_text("status", tx.html_visible_text("html"), FETCH_FAILED)
    return p.select("page_id", "status", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return to.chunk_text(d, ["doc_id"], "text").withColumn("chunk_no", F.col("chunk_no").cast("long"))


def text_chunks_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return to.chunk_text(d, ["doc_id"], "text", max_tokens=SMALL_BUDGET_TOKENS).withColumn(
        "chunk_no", F.col("chunk_no").cast("long")
    )


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return to.token_budget(d, ["doc_id"], "text")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to.reply_pairs(_conversations(spark, sf_dir), "conv_id", "turn", "role", "text")


def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = to.reply_pairs(_conversations(spark, sf_dir), "conv_id", "turn", "role", "text")
    return to.history_text(pairs, "conv_id", "turn")


def attachment_message(doc_id: Column, lang: Column, source: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Saved chart address:charts/doc_"), doc_id.cast("string"), F.lit(".png and table address:tables/doc_"),
        doc_id.cast("string"), F.lit("_"), lang, F.lit(".csv. "), text, F.lit(" Raw data address:raw/"), source,
        F.lit(".json"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    msg = d.select(
        "doc_id", attachment_message(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("msg")
    )
    return to.attachments(msg, ["doc_id"], "msg")


def image_message(doc_id: Column, lang: Column, text: Column) -> Column:
    prefix = (
        F.when(lang == "en", F.concat(F.lit("Look at https://img.example.com/doc"), doc_id.cast("string"),
                                      F.lit(".jpg). ")))
        .when(lang == "de", F.concat(F.lit("/images/doc"), doc_id.cast("string"), F.lit(".PNG ")))
        .otherwise(F.lit(""))
    )
    return F.concat(prefix, text)


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    msg = d.select("doc_id", image_message(F.col("doc_id"), F.col("lang"), F.col("text")).alias("msg"))
    return to.image_refs(msg, "msg").select("doc_id", "url", "local_path", "question", "route")


def search_response(url: Column) -> Column:
    return (
        F.when(url.like("%/en/%"), F.concat(F.lit('{"answer_box": {"link": "'), url,
                                            F.lit('"}, "organic_results": [{"link": "'), url, F.lit('?alt=1"}]}')))
        .when(url.like("%/fr/%"), F.lit('{"answer_box": {"title": "no link"}}'))
        .when(url.like("%#%"), F.lit("{}"))
        .otherwise(F.concat(F.lit('{"organic_results": [{"link": "'), url,
                            F.lit('"}, {"link": "https://other.example.com/"}]}')))
    )


def search_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", search_response(F.col("url")).alias("response"))
    return to.search_pick(p, "response").select("page_id", "pick")


def kv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    out = to.kv_roundtrip(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ["c_custkey"])
    return out.select(
        "c_custkey", "kv_text", F.col("kv")["c_name"].alias("parsed_name"),
        F.col("kv")["c_mktsegment"].alias("parsed_segment"),
    )


QUERIES = {
    "page_text": page_text,
    "fetched_text": fetched_text,
    "text_chunks": text_chunks,
    "text_chunks_1k": text_chunks_1k,
    "token_budget": token_budget,
    "reply_pairs": reply_pairs,
    "history_text": history_text,
    "attachments": attachments,
    "image_refs": image_refs,
    "search_pick": search_pick,
    "kv_text": kv_text,
}


def _q(s: str) -> str:
    return s.replace("'", "''")


# the same blocks for an engine without back-references: one alternative per element
_INVISIBLE = "(?is)<!--.*?-->|<!doctype[^>]*>|" + "|".join(
    rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ("script", "style", "template"))


def _map(entries: dict[str, str]) -> str:
    quoted = lambda xs: ", ".join(f"'{_q(x)}'" for x in xs)
    return f"map([{quoted(entries)}], [{quoted(entries.values())}])"


_EDGES = "^[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+$"
_NUMBER = "^#([0-9]+|[xX][0-9a-fA-F]+);?"
_NAME = "^[^\\t\\n\\f <&#;]{1,32};?"
_VALUE = f"""TRY_CAST(CASE WHEN regexp_matches(p, '^#[xX]') THEN '0x' || substr(regexp_extract(p, '{_NUMBER}', 1), 2)
  ELSE regexp_extract(p, '{_NUMBER}', 1) END AS BIGINT)"""
# the character of a number v, as browsers read it
_CHARACTER = """CASE WHEN v IS NULL OR v > 1114111 OR v BETWEEN 55296 AND 57343 THEN chr(65533)
  WHEN numbers[v::VARCHAR] IS NOT NULL THEN numbers[v::VARCHAR]
  WHEN v < 9 OR v = 11 OR v BETWEEN 14 AND 31 OR v = 127 OR v BETWEEN 64976 AND 65007 OR v % 65536 >= 65534 THEN ''
  ELSE chr(v::INTEGER) END"""
_OLDER = ", ".join(f"names[substr(p, 1, {n})] || substr(p, {n + 1})" for n in tx.OLD_NAMES)
_DECODED = f"""array_to_string(list_transform(string_split(node, '&'), lambda p, i:
    CASE WHEN i = 1 THEN p
         WHEN regexp_matches(p, '{_NUMBER}')
         THEN list_transform([{_VALUE}], lambda v: {_CHARACTER})[1] || regexp_replace(p, '{_NUMBER}', '')
         ELSE COALESCE(names[regexp_extract(p, '{_NAME}')] || regexp_replace(p, '{_NAME}', ''), {_OLDER}, '&' || p)
    END), '')"""
_VISIBLE = f"""array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_replace(html, '{_INVISIBLE}', ' ', 'g'), '<[^>]*>'),
    lambda node: regexp_replace({_DECODED}, '{_EDGES}', '', 'g')), lambda p: length(p) > 0), ' ')"""

_PAGES = f"""
  WITH u AS (SELECT page_id, html,
                    COALESCE(lower(NULLIF(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '')) IN ('http', 'https'),
                             FALSE) AS url_ok,
                    lower(url) LIKE '%.pdf' AS is_pdf, {_map(tx.NAMED_ENTITIES)} AS names,
                    {_map({str(n): c for n, c in tx.REPLACED_NUMBERS.items()})} AS numbers
             FROM pages)
  SELECT page_id, url_ok, is_pdf, CASE WHEN url_ok AND NOT is_pdf THEN {_VISIBLE} END AS text FROM u"""


def _chunks(n: int) -> str:
    return f"""
  SELECT doc_id, CAST(s // {n} AS BIGINT) AS chunk_no, substr(text, s + 1, {n}) AS chunk
  FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, {n})) AS s FROM documents)"""


_PAIRS = """
  n AS (SELECT conv_id, turn, role, COALESCE(text, '') AS text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(COALESCE(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations),
  p AS (SELECT conv_id, turn, text AS user_text,
               CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS reply_text
        FROM n WHERE role = 'user')"""

_ATT = "address:([a-zA-Z0-9/_-]+\\.(?:png|csv|json))"
_ATT_MSG = """concat('Saved chart address:charts/doc_', CAST(doc_id AS VARCHAR), '.png and table address:tables/doc_',
                     CAST(doc_id AS VARCHAR), '_', lang, '.csv. ', text, ' Raw data address:raw/', source, '.json')"""
_IMG_MSG = """concat(CASE WHEN lang = 'en' THEN concat('Look at https://img.example.com/doc', CAST(doc_id AS VARCHAR), '.jpg). ')
                          WHEN lang = 'de' THEN concat('/images/doc', CAST(doc_id AS VARCHAR), '.PNG ')
                          ELSE '' END, text)"""
_URL_RE2 = "(https?://\\S+|data:image/\\w+;base64,[A-Za-z0-9+/=]+)"
_PATH_RE2 = "(?:^|\\s)(/[^ \\n\\t]+\\.(?:jpg|jpeg|png|webp|gif|bmp))"

ORACLES = {
    "page_text": _PAGES,
    "fetched_text": f"""
  WITH s AS (SELECT *, CASE WHEN contains(url, '#') THEN 404 ELSE 200 END AS status,
               {_map(tx.NAMED_ENTITIES)} AS names, {_map({str(n): c for n, c in tx.REPLACED_NUMBERS.items()})} AS numbers
             FROM pages),
  t AS (SELECT page_id, status, CASE WHEN status = 200 THEN {_VISIBLE} ELSE '{FETCH_FAILED}' END AS text FROM s)
  SELECT page_id, status, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM t""",
    "text_chunks": _chunks(10000 * 4),
    "text_chunks_1k": _chunks(SMALL_BUDGET_TOKENS * 4),
    "token_budget": """
  SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, length(text) / 4.0 AS est_tokens,
         length(text) / 4.0 > 10000 AS over_budget, CAST((length(text) + 39999) // 40000 AS BIGINT) AS n_chunks,
         CASE WHEN (length(text) + 39999) // 40000 > 0
              THEN CAST(least(2000, 10000 // ((length(text) + 39999) // 40000)) AS BIGINT) END AS chunk_budget
  FROM documents""",
    "reply_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "history_text": f"""WITH {_PAIRS}
  SELECT conv_id, COUNT(*) AS n_pairs,
         string_agg(concat(chr(10), '------------', chr(10), 'User: ', user_text, chr(10), 'CHA: ', reply_text, chr(10),
                           '------------', chr(10)), '' ORDER BY turn) AS history
  FROM p GROUP BY 1""",
    "attachments": f"""
  WITH m AS (SELECT doc_id, {_ATT_MSG} AS msg FROM documents),
  x AS (SELECT doc_id, regexp_extract_all(msg, '{_ATT}', 0) AS matches, regexp_split_to_array(msg, '{_ATT}') AS pieces
        FROM m),
  y AS (SELECT doc_id, unnest(list_transform(matches, lambda mt, i: {{
          'k': i - 1, 'path': regexp_extract(mt, '{_ATT}', 1),
          'start': list_sum(list_transform(list_slice(pieces, 1, i), lambda p: length(p)))
                   + COALESCE(list_sum(list_transform(list_slice(matches, 1, i - 1), lambda q: length(q))), 0),
          'len': length(mt)}})) AS a
        FROM x)
  SELECT doc_id, CAST(a.k AS INTEGER) AS att_no, a.path AS path, CAST(a.start AS BIGINT) AS start_pos,
         CAST(a.start + a.len AS BIGINT) AS end_pos
  FROM y""",
    "image_refs": f"""
  WITH m AS (SELECT doc_id, {_IMG_MSG} AS msg FROM documents),
  r AS (SELECT doc_id, msg,
               NULLIF(regexp_replace(regexp_extract(msg, '{_URL_RE2}', 1, 'i'), '[).,;''"]+$', ''), '') AS url,
               NULLIF(regexp_extract(msg, '{_PATH_RE2}', 1, 'i'), '') AS local_path,
               regexp_replace(regexp_replace(regexp_replace(
                 regexp_replace(msg, 'https?://\\S+', '', 'g'), '{_PATH_RE2}', ' ', 'gi'),
                 '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS q
        FROM m)
  SELECT doc_id, url, local_path,
         COALESCE(NULLIF(q, ''), '{_q(tx.DEFAULT_IMAGE_QUESTION)}') AS question,
         CASE WHEN url IS NOT NULL THEN 'url' WHEN local_path IS NOT NULL THEN 'local_path' ELSE 'text' END AS route
  FROM r""",
    "search_pick": """
  WITH r AS (SELECT page_id,
               CASE WHEN url LIKE '%/en/%' THEN concat('{"answer_box": {"link": "', url, '"}, "organic_results": [{"link": "', url, '?alt=1"}]}')
                    WHEN url LIKE '%/fr/%' THEN '{"answer_box": {"title": "no link"}}'
                    WHEN url LIKE '%#%' THEN '{}'
                    ELSE concat('{"organic_results": [{"link": "', url, '"}, {"link": "https://other.example.com/"}]}') END AS j
             FROM pages)
  SELECT page_id,
         COALESCE(CASE WHEN json_extract(j, '$.answer_box') IS NOT NULL THEN json_extract_string(j, '$.answer_box.link')
                       ELSE json_extract_string(j, '$.organic_results[0].link') END,
                  'Could not get the proper response from the search. Try another search query.') AS pick
  FROM r""",
    "kv_text": """
  WITH k AS (SELECT c_custkey,
               concat('c_custkey = ', COALESCE(CAST(c_custkey AS VARCHAR), 'None'), ', c_name = ', COALESCE(c_name, 'None'),
                      ', c_nationkey = ', COALESCE(CAST(c_nationkey AS VARCHAR), 'None'),
                      ', c_mktsegment = ', COALESCE(c_mktsegment, 'None')) AS kv_text
             FROM customer)
  SELECT c_custkey, kv_text,
         trim(regexp_extract(kv_text, 'c_name =([^,=]*)', 1)) AS parsed_name,
         trim(regexp_extract(kv_text, 'c_mktsegment =([^,=]*)', 1)) AS parsed_segment
  FROM k""",
}
