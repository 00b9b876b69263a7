"""Queries of the text scalars over every line of every document: the SQL applies the same rules to the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .base import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, t (a line) and a (its ASCII characters)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "t", F.regexp_replace("t", r"[^\x00-\x7F]", "").alias("a"))


def line_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line gives as a name: quality, words in title case, the words of a roster line, the cleaned name, and whether it may be one."""
    t, a = F.col("t"), F.col("a")
    return _lines(spark, sf_dir).select(
        "doc_id", "line_no", tx.name_quality(t).cast("long").alias("quality"), tx.title_score(t).cast("long").alias("title"), tx.player_line(t).alias("player"), tx.clean_name(a).alias("name"),
        tx.plausible_name(t).cast("int").alias("plausible"), tx.header_team(a).alias("team"),
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line gives as a scoreboard: an overlay or not, the score and the shots, and its digits."""
    a = F.col("a")
    return _lines(spark, sf_dir).select("doc_id", "line_no", tx.looks_like_banner(a).cast("int").alias("banner"), tx.parse_score(a).alias("score"), tx.parse_shots(a).alias("shots"), tx.digit_line(a).alias("digits"), tx.stable_id(a).alias("id"))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every document that tells a result, else its first."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.score_line(F.coalesce("text", F.lit(""))).alias("line"))


_L = r"l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS t, regexp_replace(lines[i], '[^\x00-\x7F]', '', 'g') AS a FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"
ORACLES = {
    "line_names": rf"""WITH {_L}, w AS (SELECT *, string_split_regex(trim(t), '\s+') AS w, string_split_regex(trim(regexp_replace(a, '[^A-Za-z\s''-]', ' ', 'g')), '\s+') AS n FROM l)
      SELECT doc_id, line_no, least(4, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}{{3,}}')))) AS quality, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{Lu}}[^\p{{Lu}}]*\p{{Ll}}[^\p{{Lu}}]*'))) AS title,
        array_to_string(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))[1:3], ' ') AS player, array_to_string(list_filter(n, lambda x: regexp_full_match(x, '[A-Za-z]{{3,15}}') AND regexp_matches(x, '[AEIOUaeiou]'))[1:3], ' ') AS name,
        (regexp_matches(trim(t), '^\p{{L}}') AND len(list_filter(w, lambda x: length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= 3)) > 0)::INT AS plausible, trim(regexp_extract(upper(trim(a)), 'PAUSE\s+(.+?)\s+STATS', 1)) AS team FROM w""",
    "line_scores": rf"""WITH {_L}, s AS (SELECT *, list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(a, '\d{{1,2}}:\d{{2}}', '', 'g'), '([A-Z]{{2,3}})O\b', '\1 0', 'g'), '\bO\b', '0', 'g'), ':?\d+'), lambda x: length(x) = 1) AS d FROM l)
      SELECT doc_id, line_no, regexp_matches(upper(a), 'GOAL|QOAL|GOAI|ASSIST|SCORED|SCORER|[A-Z]{{5,}}')::INT AS banner, d[-1]::INT AS score, CASE WHEN regexp_full_match(trim(a), '\d{{1,2}}') THEN trim(a)::INT END AS shots,
        regexp_replace(a, '[FIlO|]', '1', 'g') AS digits, 'local-' || regexp_replace(a, '[^A-Za-z0-9_-]+', '_', 'g') AS id FROM s""",
    "document_scores": r"WITH s AS (SELECT doc_id, string_split(trim(coalesce(text, '')), chr(10)) AS l FROM documents) SELECT doc_id, coalesce(trim(coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)(END|GAME|OVER|\d\s*[-–]\s*\d)'))[1], l[1])), '') AS line FROM s",
}
QUERIES = {name: globals()[name] for name in ORACLES}
