"""Fill-in-middle forms against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import fim

GRAMMARS = {"tokens": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+", "characters": r"[\s\S]"}
ODD = ["", None, " ", "a", " \n\t ", "a b", "  lead and trail \n", "x\ny\n\nz", "😀 é　日本 \x85\xa0 ok", "a <P> b", "<S>", "<M", "a <", "P> b <S c S>", "<<S >> M>", "\x1c\x1d \x0b\x0c", "word " * 30_000, "😀" * 2_000]


def plain(doc_id, text, units, fim_percent, spm_percent, seed=42):
    text = text or ""
    u = re.findall(GRAMMARS[units], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return len(u), "plain", None, None, text
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm_percent:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("units", sorted(GRAMMARS))
@pytest.mark.parametrize("percents", [(50, 80), (100, 100), (100, 0), (0, 50)])
def test_same_as_plain_python_and_restored(spark, units, percents):
    draw = random.Random(7)
    texts = ODD + ["".join(draw.choice(["a", "bc", " ", "\n", "\t", "<", "P>", "S>", "M>", "é", "😀", "\xa0"]) for _ in range(draw.randrange(60))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again a b"), (3, "again a b"), (None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("u", F.lit(1)).withColumn("form", F.lit("x")).withColumn("n", F.lit(2)).withColumn("output", F.lit("y"))
    out = fim.transformed(df, units, fim_percent=percents[0], spm_percent=percents[1]).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((i, *plain(i, t, units, *percents), t or "") for i, t in rows), key=repr)
    assert got == want


def test_empty_table(spark):
    assert fim.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_is_shuffled(spark):
    plan = fim.transformed(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
