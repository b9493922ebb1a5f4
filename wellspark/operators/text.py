"""Text, page and transcript-text operators over whole tables.

All work is column expressions (regex, split/transform/filter/aggregate on arrays); results grow with the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.operators.ordered import lead_across_buckets

HISTORY_BLOCK_TURNS = 512  # turns that are sorted together on the way to a conversation's text


def chunk_text(
    df: DataFrame, keys: Sequence[str], text_col: str, max_tokens: int = tx.DEFAULT_MAX_TOKENS
) -> DataFrame:
    """fixed-size chunks of ``max_tokens * 4`` characters, in order; empty text gives no chunk.

    Output: keys, ``chunk_no`` (0-based), ``chunk``.
    """
    n = max_tokens * tx.CHARS_PER_TOKEN
    t = F.col(text_col)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(n)))
    return df.select(*keys, t.alias("__t"), F.posexplode(starts).alias("chunk_no", "__start")).select(
        *keys, "chunk_no", F.substr(F.col("__t"), F.col("__start") + 1, F.lit(n)).alias("chunk")
    )


def token_budget(
    df: DataFrame, keys: Sequence[str], text_col: str, max_tokens: int = tx.DEFAULT_MAX_TOKENS
) -> DataFrame:
    """F4/F5 per text: characters, token estimate (chars/4), over-budget flag, number of chunks and the per-chunk
    answer budget ``min(2000, int(10000 / n_chunks))`` - all closed form, no window or shuffle."""
    n = max_tokens * tx.CHARS_PER_TOKEN
    length = F.length(F.col(text_col))
    n_chunks = F.floor((length + F.lit(n - 1)) / F.lit(n)).cast("long")
    return df.select(
        *keys,
        length.cast("long").alias("n_chars"),
        tx.token_estimate(text_col).alias("est_tokens"),
        (tx.token_estimate(text_col) > F.lit(max_tokens)).alias("over_budget"),
        n_chunks.alias("n_chunks"),
        F.when(
            n_chunks > 0,
            F.least(F.lit(tx.MAX_CHUNK_ANSWER_TOKENS).cast("long"), F.floor(F.lit(max_tokens) / n_chunks).cast("long")),
        ).alias("chunk_budget"),
    )


def page_text(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """URL checks and visible text of every stored page.

    Adds ``url_ok`` (http/https), ``is_pdf`` and ``text`` (visible text; NULL for rejected or PDF URLs, which the
    reference hands to other readers or errors on)."""
    ok = tx.url_scheme_ok(url_col)
    pdf = tx.is_pdf_url(url_col)
    return df.withColumns({"url_ok": ok, "is_pdf": pdf}).withColumn(
        "text", F.when(F.col("url_ok") & ~F.col("is_pdf"), tx.html_visible_text(html_col))
    )


def reply_pairs(
    df: DataFrame,
    conv: str,
    turn: str,
    role: str,
    text: str,
    bucket_turns: int = HISTORY_BLOCK_TURNS,
) -> DataFrame:
    """Every user message with the reply that follows it (empty when the next row is not an assistant)."""
    bucket = F.floor(F.col(turn) / F.lit(bucket_turns))
    nxt = lead_across_buckets(df, [conv], [turn], [role, text], prefix="next_", bucket=bucket)
    return nxt.where(F.col(role) == "user").select(
        conv,
        turn,
        F.col(text).alias("user_text"),
        F.when(F.col(f"next_{role}") == "assistant", F.col(f"next_{text}")).otherwise(F.lit("")).alias("reply_text"),
    )


def history_text(
    pairs: DataFrame, conv: str, turn: str, block_turns: int = HISTORY_BLOCK_TURNS
) -> DataFrame:
    """one transcript text per conversation, ``\\n------------\\nUser: u\\nCHA: r\\n------------\\n`` per pair, concatenated in turn
    order. Blocks of ``block_turns`` turns are put together first, so that only a block's turns are sorted at once and
    the last step joins a few strings per conversation."""
    sep = tx.HISTORY_SEPARATOR
    piece = F.concat(
        F.lit(f"\n{sep}\nUser: "), F.col("user_text"), F.lit("\nCHA: "), F.col("reply_text"), F.lit(f"\n{sep}\n")
    )
    return (
        pairs.withColumn("block_no", F.floor(F.col(turn) / F.lit(block_turns)).cast("long"))
        .withColumn("__piece", piece)
        .groupBy(conv, "block_no")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.expr(f"listagg(__piece, '') WITHIN GROUP (ORDER BY {turn})").alias("history"),
        )
        .groupBy(conv)
        .agg(
            F.sum("n_pairs").alias("n_pairs"),
            F.expr("listagg(history, '') WITHIN GROUP (ORDER BY block_no)").alias("history"),
        )
    )


def attachments(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """every ``address:<path>.(png|csv|json)`` with 0-based start/end offsets of the whole match.

    Offsets come from the split pieces: start of match k = lengths of pieces 0..k + lengths of matches 0..k-1.
    """
    t = F.col(text_col)
    found = F.struct(F.regexp_extract_all(t, F.lit(tx.ATTACHMENT_PATTERN), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(t, F.lit(tx.ATTACHMENT_PATTERN), F.lit(1)).alias("path"),
                     F.split(t, tx.ATTACHMENT_PATTERN, -1).alias("pieces"))

    def placed(m: Column) -> Column:
        both = F.zip_with(F.slice(m["pieces"], F.lit(1), F.size(m["whole"])), m["whole"],
                          lambda piece, whole: F.length(piece) + F.length(whole))
        ends = F.transform(F.arrays_zip(tx.running_totals(both).alias("before"), both.alias("both"),
                                        m["whole"].alias("whole"), m["path"].alias("path")),
                           lambda x: F.struct(x["path"].alias("path"), F.length(x["whole"]).alias("length"),
                                              (x["before"] + x["both"]).alias("end")))
        return F.when(F.size(m["whole"]) > 0, ends)

    out = df.select(*keys, F.posexplode(tx.let(found, placed)).alias("att_no", "__a"))
    return out.select(
        *keys,
        "att_no",
        F.col("__a.path").alias("path"),
        (F.col("__a.end") - F.col("__a.length")).cast("long").alias("start_pos"),
        F.col("__a.end").cast("long").alias("end_pos"),
    )


def image_refs(df: DataFrame, text_col: str) -> DataFrame:
    """First URL, first local image path, the question left over, and the route label."""
    return df.withColumns(
        {
            "url": tx.first_url(text_col),
            "local_path": tx.first_local_image(text_col),
            "question": tx.question_or_default(text_col),
        }
    ).withColumn(
        "route",
        F.when(F.col("url").isNotNull(), F.lit("url"))
        .when(F.col("local_path").isNotNull(), F.lit("local_path"))
        .otherwise(F.lit("text")),
    )


def with_upload(refs: DataFrame, uploaded: str = "uploaded_path") -> DataFrame:
    """F11 with uploads: over :func:`image_refs`, ``image`` is the URL, else the local path, else the uploaded image,
    whose route is "uploaded"."""
    return refs.withColumn("image", F.coalesce("url", "local_path", uploaded)).withColumn(
        "route", F.when((F.col("route") == "text") & F.col(uploaded).isNotNull(), F.lit("uploaded"))
        .otherwise(F.col("route")))


def latest_upload(df: DataFrame, session: str, seq: str, path: str) -> DataFrame:
    """Per session, the most recent uploaded path that looks like an image (grouped ``max_by``, no window)."""
    suffix = r"(?i)\.(?:" + "|".join(tx.IMAGE_SUFFIXES) + r")$"
    return (
        df.where(F.col(path).rlike(suffix))
        .groupBy(session)
        .agg(F.max_by(F.col(path), F.col(seq)).alias("uploaded_path"))
    )


def search_pick(df: DataFrame, json_col: str) -> DataFrame:
    """Answer-box link if an answer box exists (missing link -> error text), else first organic link,
    else the fixed error text."""
    j = F.col(json_col)
    has_box = F.get_json_object(j, "$.answer_box").isNotNull()
    pick = F.when(has_box, F.get_json_object(j, "$.answer_box.link")).otherwise(
        F.get_json_object(j, "$.organic_results[0].link")
    )
    return df.withColumn("pick", F.coalesce(pick, F.lit(tx.SEARCH_ERROR_TEXT)))


def kv_roundtrip(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """rows -> ``col = val, ...`` text, and the text parsed back to a string map."""
    return df.select(*keys, tx.kv_line(list(cols)).alias("kv_text")).withColumn("kv", tx.kv_parse("kv_text"))


def message_parts(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """a message as ordered parts - text between attachments and the attachment paths - with empty text
    parts dropped. Offsets are absolute (the reference reuses offsets of the whole reply on a shrinking string,
    which misplaces every split after the first; here each split is where the match is)."""
    t = F.col(text_col)
    found = F.struct(F.regexp_extract_all(t, F.lit(tx.ATTACHMENT_PATTERN), F.lit(1)).alias("paths"),
                     F.split(t, tx.ATTACHMENT_PATTERN, -1).alias("pieces"))
    part = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))

    def parts(m: Column) -> Column:  # a piece and the path behind it, side by side; the last piece has none
        pairs = F.transform(F.arrays_zip(m["pieces"].alias("piece"), m["paths"].alias("path")), lambda p: F.array(
            part("text", p["piece"]), part("attachment", p["path"])))
        return F.filter(F.flatten(pairs), lambda x: F.length(x["content"]) > 0)

    kept = tx.let(found, parts)
    return df.select(*keys, F.posexplode(kept).alias("part_no", "__p")).select(
        *keys, F.col("part_no").cast("long").alias("part_no"), F.col("__p.kind").alias("kind"),
        F.col("__p.content").alias("content"),
    )
