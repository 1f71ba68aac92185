"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.llm import (chat, decontam, licenses, mixing, neardup, phrases, quality, secrets, spans, tokens, urls,
                         warc, whitening)
from airshed.llm.tables import kept
from airshed.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- 1 mixing

@register("op1_mixing")
def op1_mixing(spark, sf):
    """Words that the mix takes of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies",
                                          "shards")


# ---------------------------------------------------------------- 2 url filters

@register("op2_url_filter")
def op2_url_filter(spark, sf):
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


# ---------------------------------------------------------------- 3 license scans

def _license_sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, t.license_id, t.text.replace("'", "''"))
                       for i, t in enumerate(licenses.TEMPLATES))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    cut = "array_to_string(w[i:i + 2], ' ')"
    return f"""
WITH t AS (SELECT number, license_id, {words} AS w FROM (VALUES {values}) v(number, license_id, text)),
ts AS (SELECT DISTINCT number, license_id, {cut} AS s
       FROM (SELECT number, license_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
tn AS (SELECT number, count(*) AS n FROM ts GROUP BY number),
tc AS (SELECT number, n, cast(pow(2, ceil(log2(n))) AS integer) AS cls FROM tn),
tw AS (SELECT number, n, greatest(1, cls // 2) AS step, CASE WHEN cls > 1 THEN 3 * (cls // 2) ELSE 1 END AS size FROM tc),
ds AS (SELECT doc_id, i - 1 AS i, {cut} AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
             FROM (SELECT doc_id, {words} AS w FROM documents))),
hit AS (SELECT ds.doc_id, ts.number, ts.license_id, ds.s, n,
               unnest(range(greatest(0, cast(floor((i - (size - step)) / step) AS bigint)), i // step + 1)) * step AS start
        FROM ds JOIN ts ON ds.s = ts.s JOIN tw ON ts.number = tw.number),
win AS (SELECT doc_id, number, license_id, start, count(DISTINCT s) / any_value(n) AS share
        FROM hit GROUP BY doc_id, number, license_id, start)
SELECT doc_id, license_id, max(share) AS containment, count(*) AS n_windows
FROM win WHERE share >= 0.8e0 GROUP BY doc_id, license_id
"""


@register("op3_license_scan", _license_sql())
def op3_license_scan(spark, sf):
    """Licenses found in every document's whole text."""
    return licenses.scan(spark, table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- 4 token counts

@register("op4_token_counts")
def op4_token_counts(spark, sf):
    """Tokens of every whole text, as the published 32k piece model splits it."""
    import public_tokenizers
    return tokens.count_tokens(spark, table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# ---------------------------------------------------------------- 5 quality rules

_WS = r"[^\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WS}')) AS lines
  FROM documents),
c AS (
  SELECT doc_id, len(w) AS n_words, len(list_distinct(lines)) AS n_distinct, len(lines) AS n_lines,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM d),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM win) WHERE k > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars,
       cast(n_symbols AS bigint) AS n_symbols, cast(n_lines - n_distinct AS bigint) AS n_dup_lines,
       cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words
         AND n_symbols / n_words <= 0.1e0 AND n_stop_words / n_words >= 0.03e0
         AND (n_lines - n_distinct) / n_lines <= 0.3e0 AS kept
FROM f
"""


@register("op5_quality_rules", _QUALITY_SQL)
def op5_quality_rules(spark, sf):
    """Quality counts and verdict of every document."""
    return quality.judge(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ---------------------------------------------------------------- 6 substring dedup

@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf):
    """Every document's text without sentences of repeated spans."""
    return spans.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- 7 benchmark decontamination

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECONTAM_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS l
      FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT l FROM b),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.l AS l, i FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@register("op7_decontamination", _DECONTAM_SQL)
def op7_decontamination(spark, sf):
    """Words of every document that lie in a 10-word benchmark window."""
    found = decontam.find(spark, table(spark, sf, "documents").select("doc_id", "text"),
                          table(spark, sf, "benchmark"), exact=True)
    n_hit = decontam.covered_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


# ---------------------------------------------------------------- 8 WARC

_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, b, min(page_id) OVER (PARTITION BY b) AS first,
             unhex(sha1(b)) AS s FROM p),
bits AS (
  SELECT page_id, n, first, (SELECT string_agg(bin, '' ORDER BY i) FROM (
    SELECT i, lpad(bin(cast('0x' || substr(hex(s), 2 * i + 1, 2) AS integer)), 8, '0') AS bin
    FROM range(20) t(i))) AS bits FROM h)
SELECT page_id, cast(n AS bigint) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + list_sum(list_transform(range(5), lambda k: cast(substr(bits, 5 * j + k + 1, 1) AS integer) * (16 >> k)))::integer,
          1), '' ORDER BY j) FROM range(32) t(j)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""


@register("op8_warc", _WARC_SQL)
def op8_warc(spark, sf):
    """Write every page into archives, read them back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(spark, table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to")


# ---------------------------------------------------------------- 9 chat formatting

@register("op9_chat_format")
def op9_chat_format(spark, sf):
    """Raw transcripts of all conversations, parsed into roles and rendered canonically."""
    parts = kept(spark, chat.parts(spark, table(spark, sf, "conversations")), "parts")
    model = chat.train(spark, parts)
    return chat.format_transcripts(spark, kept(spark, chat.transcripts(parts), "transcripts"), model)


# ---------------------------------------------------------------- 10 near-duplicates

@register("op10_near_dedup")
def op10_near_dedup(spark, sf):
    """Near-duplicate class of every document (the smallest doc_id in it)."""
    return neardup.classes(spark, table(spark, sf, "documents").select("doc_id", "text")) \
        .select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "copy_of")


# ---------------------------------------------------------------- 11 phrase collocations

_PHRASES_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1),
                                       lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT t.lang, t.k, t.phrase, t.a, t.cut, x.f AS l, y.f AS r,
             cast(cast(t.a AS hugeint) * t.a * 1000000 // (cast(x.f AS hugeint) * y.f) AS bigint) AS score
      FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:t.cut], ' ')
      JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[t.cut + 1:t.k], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT lang, phrase FROM (
             SELECT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND x.k = 2 AND y.k = 3
               AND x.w = y.w[1:2] AND 100 * y.a >= 50 * x.a
             UNION ALL SELECT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND x.k = 2 AND y.k = 3
               AND x.w = y.w[2:3] AND 100 * y.a >= 50 * x.a)),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
           FROM best b ANTI JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT ranked.lang, rank, phrase, a, l, r, cast(n AS bigint) AS n, score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


@register("op11_phrase_mining", _PHRASES_SQL)
def op11_phrase_mining(spark, sf):
    """The first 2,000 collocations of every language."""
    return phrases.collocations(spark, table(spark, sf, "documents").select("lang", "text"))


# ---------------------------------------------------------------- 12 embedding whitening

@register("op12_whitening")
def op12_whitening(spark, sf):
    """Whitened coordinates of every usable embedding."""
    return whitening.whiten(spark, table(spark, sf, "embeddings").select("vec_id", "embedding")) \
        .withColumnRenamed("id", "vec_id")


# ---------------------------------------------------------------- 13 secret scans

@register("op13_secret_scan")
def op13_secret_scan(spark, sf):
    """Secrets in every document's whole text."""
    found = secrets.scan(spark, table(spark, sf, "documents").select("doc_id", "text"))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))
