"""Operator 11: fill-in-middle forms by lookaround splitting.

A unit grammar is a pair of neighbouring character classes: a new unit begins
wherever a character of the first stands before one of the second. As a regex that
is a zero-width boundary, ``(?<=[before])(?=[after])``; Spark's ``split`` cuts there
and keeps every character, so the pieces are the units. An empty text has no unit
(``split`` would give one).

Two cuts of a text's units part it into prefix, middle and suffix, which are put in
another order between three marks. A text that holds a mark itself stays plain, so
every form can be read back. Everything is decided by a hash of the seed and the
doc_id: rows don't depend on each other, nothing is shuffled, and the work runs where
a text lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands on either side of a boundary, as regex classes. ``tokens``: spaces and the word after them, or spaces that end a text.
UNITS = {
    "tokens": (r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"),
    "lines": (r"[\n]", r"[\s\S]"),
    "characters": (r"[\s\S]", r"[\s\S]"),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80


def boundary(units: str) -> str:
    """The zero-width regex between two units."""
    before, after = UNITS[units]
    return f"(?<={before})(?={after})"


def pieces(text: Column, units: str = "tokens") -> Column:
    """The units of a text, in order; none for an empty one."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(units), -1))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of seed and id (a null id counts as no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, units: str = "tokens", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output of every row of ``docs`` (doc_id, text).

    A null text counts as empty; empty texts and texts that hold a mark are plain.
    Repeated rows and rows without an id are each transformed; other columns of
    ``docs`` are left out. A text is cut whole, however long: its units are one array
    of one row. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", pieces(F.col("text"), units).alias("u"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    rows = rows.withColumn("n", F.size("u").cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumn("a", F.least(first, second).cast("int")).withColumn("b", F.greatest(first, second).cast("int"))

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("u", start, length), "")

    cut = F.when(F.col("form") != "plain", F.struct(
        joined(F.lit(1), F.col("a")).alias("prefix"),
        joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        joined(F.col("b") + 1, F.greatest(F.size("u") - F.col("b"), F.lit(0))).alias("suffix"),
    ))
    rows = rows.select("doc_id", "n", "form", "text", cut.alias("c"))
    psm = F.concat(F.lit(PREFIX), F.col("c.prefix"), F.lit(SUFFIX), F.col("c.suffix"), F.lit(MIDDLE), F.col("c.middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("c.suffix"), F.lit(PREFIX), F.col("c.prefix"), F.lit(MIDDLE), F.col("c.middle"))
    return rows.select(
        "doc_id", "n", "form",
        F.length("c.prefix").cast("long").alias("prefix_chars"), F.length("c.middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of this form was made from.

    Pieces hold no mark, and no mark begins inside another, so the marks are where the output says.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: form, cuts and digests of the output and of the text read back from it."""
    rows = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"),
    )


#: Units matched by their own grammar, left to right.
_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

QUERIES = {"op11_fim": op11_fim}
ORACLES = {"op11_fim": _SQL}
