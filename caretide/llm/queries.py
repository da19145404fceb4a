"""Registered queries of this subpackage with, where plain SQL can say it, the equivalent statement."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from caretide.llm import collocations, conversation_repair, decontaminate, html_extract, language_id, license_scan, near_dedup, packing, quality_model, quality_rules, simhash, suffix_index, url_filters
from caretide.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, keep=["doc_id"])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents outside of the held-out fifth; predicts all."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def fetch_day(page_id: Column) -> Column:
    """The tables have no fetch time: pages are taken as fetched over two years, in an order of its own."""
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(page_id * 7919, F.lit(730)).cast("int"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: every fifth page has its host listed on a day, every seventh has
    it taken off, every eleventh has the domain above it listed."""
    from_pages = pages.select("page_id", html_extract.host_of(F.col("url")).alias("host")).filter("host != ''")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 104729, F.lit(730)).cast("int"))
    above = F.regexp_replace("host", r"^[^.]*\.", "")
    kinds = [(5, F.col("host"), "spam", "add"), (7, F.col("host"), "spam", "remove"), (11, above, "adult", "add"), (13, above, "adult", "remove")]
    each = [
        F.struct(F.when(F.pmod("page_id", F.lit(n)) == 0, p).alias("pattern"), F.lit(c).alias("category"), day.alias("day"), F.lit(a).alias("action"))
        for n, p, c, a in kinds
    ]
    return from_pages.select(F.inline(F.array(*each))).filter("pattern is not null")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", fetch_day(F.col("page_id")))
    judged = url_filters.judge(captures, list_entries(pages))
    return judged.select("page_id", F.col("fetched").cast("string").alias("fetched"), "blocked", "n_entries", "pattern", "category")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         DATE '2023-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS fetched,
         DATE '2023-01-01' + CAST((page_id * 104729) % 730 AS INTEGER) AS listed
  FROM pages
), e AS (
  SELECT host AS pattern, 'spam' AS category, listed AS day, 'add' AS action FROM p WHERE page_id % 5 = 0 AND host <> ''
  UNION ALL SELECT host, 'spam', listed, 'remove' FROM p WHERE page_id % 7 = 0 AND host <> ''
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'adult', listed, 'add' FROM p WHERE page_id % 11 = 0 AND host <> ''
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'adult', listed, 'remove' FROM p WHERE page_id % 13 = 0 AND host <> ''
), d AS (
  SELECT pattern, category, day, max(action) AS action FROM e GROUP BY ALL
), i AS (
  SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS next FROM d
), a AS (
  SELECT p.page_id, i.pattern, i.category
  FROM p JOIN i ON (p.host = i.pattern OR p.host LIKE '%.' || i.pattern) AND i.action = 'add'
    AND p.fetched >= i.day AND (i.next IS NULL OR p.fetched < i.next)
), v AS (
  SELECT page_id, count(*) AS n, min(struct_pack(l := -length(pattern), p := pattern, c := category)) AS best FROM a GROUP BY page_id
)
SELECT p.page_id, CAST(p.fetched AS VARCHAR) AS fetched, v.n IS NOT NULL AS blocked, coalesce(v.n, 0) AS n_entries,
       v.best.p AS pattern, v.best.c AS category
FROM p LEFT JOIN v USING (page_id)
"""


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs conversations damaged by a fixed rule: turns dropped, emptied, cut, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    turns = table(spark, sf_dir, "conversations").withColumn("damage", F.crc32(key) % 20)
    damage, whole = F.col("damage"), F.coalesce("text", F.lit(" "))
    turns = turns.withColumns(
        {
            "text": F.when(damage == 1, "").when(damage == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole),
            "role": F.when(damage == 4, "user").otherwise(F.coalesce("role", F.lit(" "))),
        }
    )
    return conversation_repair.repair(turns, copies=F.when(damage == 3, 2).otherwise(1), gone=damage == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), c AS (
  SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), s AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS sizes(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100
), a AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), u AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(w[1 : k - 1], ' ') AS phrase FROM a UNION ALL SELECT lang, f, array_to_string(w[2 : k], ' ') FROM a
  ) GROUP BY ALL
), d AS (
  SELECT a.lang, a.k, a.phrase, a.f, a.w FROM a LEFT JOIN u USING (lang, phrase) WHERE u.longer IS NULL OR 100 * u.longer < 100 * a.f
), x AS (
  SELECT lang, phrase, f AS a, w, k, unnest(range(1, k)) AS cut FROM d
), y AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, c.n, (1000 * x.a::HUGEINT * c.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM x JOIN c ON x.lang = c.lang
  JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.cut], ' ')
  JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1 : x.k], ' ')
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS worst FROM y
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE worst = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op11_conversation_repair": (op11_conversation_repair, None),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_simhash": (op13_simhash, None),
    "op5_quality_model": (op5_quality_model, None),
    "op4_url_filters": (op4_url_filters, OP4_SQL),
    "op2_html_extract": (op2_html_extract, None),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op10_near_dedup": (op10_near_dedup, None),
    "op9_packing": (op9_packing, None),
    "op1_language_id": (op1_language_id, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op3_license_scan": (op3_license_scan, None),
    "op6_quality_rules": (op6_quality_rules, None),
}
