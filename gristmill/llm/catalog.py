"""The queries of this package and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.site import SITE_SQL
from gristmill.llm import layout, line_templates, mixing, near_duplicates, packing, prose, reading, render, residue, spam, term_bitmaps
from gristmill.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.repeated_lines(table(spark, sf_dir, "pagelog"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_templates.without_repeated_lines(table(spark, sf_dir, "pagelog"))
    return clean.select("log_id", "text_clean", "n_removed")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_bitmaps.marked_terms(table(spark, sf_dir, "pagelog"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("mark is not null").select("term")


def _common(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    return prose.stop_words(table(spark, sf_dir, "stop_words"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.scored(cut(spam.with_features(table(spark, sf_dir, "documents"), _common(spark, sf_dir))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_scores(spark, sf_dir).where("p_spam >= 0.5").select("doc_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, sf_dir, "documents"), threshold=0.7, width=3)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.furniture_lines(table(spark, sf_dir, "pagelog"))


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the log without their furniture lines."""
    pages = table(spark, sf_dir, "pagelog")
    drop = p6_found(spark, sf_dir).groupBy("log_id").agg(F.collect_list("line_no").alias("_drop"))
    joined = pages.select("log_id", "text").join(drop, "log_id", "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_drop"), i.cast("int")))
    return joined.select("log_id", F.array_join(kept, "\n").alias("main_text"))


def p6_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each response's HTML, rendered with its layout."""
    return render.rendered(table(spark, sf_dir, "responses"), "resp_id", "raw.content", main_only=True)


def p5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.with_reasons(prose.with_stats(table(spark, sf_dir, "documents"), _common(spark, sf_dir)))


def _measured(spark: SparkSession, sf_dir: str, stats: str, also=None) -> DataFrame:
    """Spam features and text statistics of all documents, from one pass over their texts."""
    return cut(spam.with_features(table(spark, sf_dir, "documents"), _common(spark, sf_dir), stats=stats, also=also))


def _spam_pages(measured: DataFrame) -> DataFrame:
    return spam.scored(measured).where("p_spam >= 0.5").select("doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose recorded reasons hold the deciding one, with the spam pages and without residue."""
    measured = _measured(spark, sf_dir, "all")
    stats = measured.select("doc_id", *[F.col(f"s_{c.split()[0]}").alias(c.split()[0]) for c in prose.STATS.split(", ")])
    failed = prose.with_reasons(stats).where(F.array_contains("reasons", prose.DECIDING)).select("doc_id")
    return failed.union(_spam_pages(measured)).distinct().join(p7_found(spark, sf_dir), "doc_id", "left_anti")


def p7_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_residue(spark, sf_dir).select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading.with_level(documents, reading.fit(documents, table(spark, sf_dir, "reading_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of the hardest band; the level, the features and the statistics of a
    document are measured in one pass."""
    model = reading.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    measured = _measured(spark, sf_dir, "deciding", (reading.LEVEL, reading.measurer(spark, model)))
    hard = measured.where("level = 5 and english")
    prose_only = hard.where(~prose.rules("s_")[prose.DECIDING]).select("doc_id")
    return prose_only.join(_spam_pages(measured), "doc_id", "left_anti").join(p7_found(spark, sf_dir), "doc_id", "left_anti")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


BLANKS_SQL = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+"

P4_FOUND = r"""
WITH f AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS g
  FROM f WHERE len(w) >= 50),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT s.doc_id, s.g FROM s JOIN rare USING (g)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b
FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
WHERE shared >= 0.7 * (p.n + q.n - shared)"""

P4_CLASSES = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS g
  FROM f WHERE len(w) >= 50),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.g FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE shared >= 0.8 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
roots AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT r.x AS doc_id, class_id, count(l.y) AS n_links FROM roots r LEFT JOIN links l ON l.x = r.x GROUP BY 1, 2"""

LINES_SQL = rf"""
lines AS (
  SELECT log_id, {SITE_SQL.format("fetch_url")} AS site, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM pagelog WHERE text IS NOT NULL),
parsed AS (
  SELECT log_id, site, CAST(line_no AS INT) AS line_no,
         regexp_replace(trim(regexp_replace(lower(line), '{BLANKS_SQL}', ' ', 'g')), '[0-9]+', '0', 'g') AS t
  FROM lines WHERE site IS NOT NULL AND regexp_matches(line, '\p{{L}}')),
sizes AS (SELECT {SITE_SQL.format("fetch_url")} AS site, count(*) AS n FROM pagelog GROUP BY 1),
frequent AS (
  SELECT p.site, p.t FROM parsed p JOIN sizes s ON p.site = s.site
  GROUP BY p.site, p.t, s.n
  HAVING count(DISTINCT log_id) >= 5 AND count(DISTINCT log_id) >= 0.02 * s.n)
"""

P1_FOUND = f"""WITH {LINES_SQL}
SELECT p.log_id, p.line_no FROM parsed p JOIN frequent f ON p.site = f.site AND p.t = f.t"""

P1_CLEAN = f"""WITH {LINES_SQL},
hits AS (SELECT p.log_id, list(p.line_no) AS nos FROM parsed p JOIN frequent f ON p.site = f.site AND p.t = f.t GROUP BY p.log_id)
SELECT g.log_id, array_to_string([string_split(g.text, chr(10))[i + 1] FOR i IN range(len(string_split(g.text, chr(10)))) IF NOT list_contains(coalesce(h.nos, []), i)], chr(10)) AS text_clean,
       CAST(coalesce(len(h.nos), 0) AS INT) AS n_removed
FROM pagelog g LEFT JOIN hits h ON h.log_id = g.log_id"""

TERMS_SQL = """
words AS (
  SELECT log_id, unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) AS term FROM pagelog),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT log_id) AS n_rows FROM words GROUP BY term),
total AS (SELECT count(*) AS n FROM pagelog)
"""

P2_TERMS = f"""WITH {TERMS_SQL}
SELECT term, n_occurrences, n_rows,
       CASE WHEN n_rows < 3 THEN 'rare' WHEN n_rows > 0.4 * n THEN 'common' END AS mark
FROM counts, total"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_clean": p1_clean,
        "p2_found": p2_found,
        "p2_terms": p2_terms,
        "p3_found": p3_found,
        "p3_scores": p3_scores,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_found": p5_found,
        "p5_stats": p5_stats,
        "p6_found": p6_found,
        "p6_main_text": p6_main_text,
        "p6_render": p6_render,
        "p7_found": p7_found,
        "p7_residue": p7_residue,
        "p8_pack": p8_pack,
        "p8_report": p8_report,
        "p9_mix": p9_mix,
        "p9_report": p9_report,
        "p10_found": p10_found,
        "p10_levels": p10_levels,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_clean": P1_CLEAN,
        "p2_terms": P2_TERMS,
        "p4_found": P4_FOUND,
        "p4_classes": P4_CLASSES,
        "p2_found": f"SELECT term FROM ({P2_TERMS}) WHERE mark IS NOT NULL",
    }
