"""Sources and sinks: file listings, labelled folders, run logs, observation caches, and the reports of a reel."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans as sc

# The kinds of files that are taken, transfer functions of high dynamic range, endings of made files, and the least size of a whole one.
MEDIA = (".mp4", ".mov", ".mkv", ".avi", ".webm")
HDR = ("smpte2084", "arib-std-b67")
NORMAL, TONE_MAPPED, LEAST_BYTES = "_norm", "_sdr", 10_000


def file_columns(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds folder, name, stem and suffix (lower case, with its point; a leading point is no suffix)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = rows.withColumn("folder", F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).withColumn("name", name)
    return rows.withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")).withColumn("suffix", F.lower(F.regexp_extract("name", r".(\.[^.]*)$", 1)))


def wanted(rows: DataFrame, suffixes: tuple[str, ...] = MEDIA, root: str | None = None, path: str = "path") -> DataFrame:
    """Files of the wanted kinds, with :func:`file_columns`; of ``root`` those that stand right in it."""
    found = file_columns(rows, path).where(F.col("suffix").isin(*suffixes))
    return found if root is None else found.where(F.col("folder") == root.rstrip("/"))


def list_media(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = MEDIA, recursive: bool = True) -> DataFrame:
    """path, modified_us, length, folder, name, stem and suffix of every file of the wanted kinds; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return wanted(reader.load(folder).select("path", F.unix_micros("modificationTime").alias("modified_us"), "length"), suffixes)


def with_label(rows: DataFrame) -> DataFrame:
    """Adds label, the name of the folder that a file stands in."""
    return rows.withColumn("label", F.regexp_extract("folder", r"([^/]*)$", 1))


def labelled_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, label (the folder's name) and stem of every file one folder below ``root``."""
    return with_label(list_media(spark, root)).select("path", "label", "stem")


def segment_files(rows: DataFrame, root: str, suffix: str = ".mp4") -> DataFrame:
    """Segments below ``root`` (match, name and pos, from 1, in the order of both): those in folders of matches, or if there are none those right in it."""
    below = file_columns(rows).where((F.col("suffix") == suffix) & F.col("folder").startswith(root.rstrip("/")))
    deep = below.withColumn("match", F.regexp_extract(F.substr("folder", F.lit(len(root.rstrip("/")) + 1)), r"^/([^/]+)$", 1))
    deep = deep.where((F.col("match") != "") | (F.col("folder") == root.rstrip("/")))
    any_match = deep.agg(F.coalesce(F.bool_or(F.col("match") != ""), F.lit(False))).scalar()
    chosen = sc.ranged(deep.where(any_match == (F.col("match") != "")), ["match"], "name")
    return sc.scan(chosen, ["match"], ["name"], {"pos": sc.row_number()}).drop(sc.PART)


def is_hdr(transfer: Column) -> Column:
    """Whether a probe's transfer function is of high dynamic range; an unread one is not."""
    return F.coalesce(F.lower(F.trim(transfer)).isin(*HDR), F.lit(False))


def ingest_actions(files: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """What to do with each file (columns stem, hdr): target (the output's stem, null if it is taken as it is) and action.

    A file that is normal already is used as it is unless it is of high dynamic
    range; else its output is kept if it is there and whole (outputs: stem, length),
    made again if it is too small, and made if it isn't there.
    """
    normal = F.col("stem").endswith(NORMAL)
    rows = files.withColumn("target", F.when(~normal, F.concat("stem", F.lit(NORMAL))).when(F.col("hdr"), F.concat("stem", F.lit(TONE_MAPPED))))
    made = outputs.groupBy(F.col("stem").alias("target")).agg(F.max("length").alias("_length"))
    there = F.when(F.col("_length") > LEAST_BYTES, "skip").when(F.col("_length").isNotNull(), "remake").otherwise("make")
    action = F.when(F.col("target").isNull(), "as_is").otherwise(F.lit("make") if overwrite else there)
    return rows.join(made, "target", "left").withColumn("action", action).drop("_length")


def missing_outputs(inputs: DataFrame, outputs: DataFrame, on: str = "stem", least_bytes: int = LEAST_BYTES, force: bool = False) -> DataFrame:
    """Inputs without an output of more than ``least_bytes``; all of them by ``force``."""
    return inputs if force else inputs.join(outputs.where(F.col("length") > least_bytes).select(on).distinct(), on, "left_anti")


_KINDS = {bool: "boolean", int: "long", float: "double", str: "string"}


def yaml_json(document: Column) -> Column:
    """A YAML document of nested block mappings, lists of scalars and comments as JSON; null where it is more than that (flow collections, anchors, several lines of text). Documents are small: one a file."""

    def scalar(text: str):
        if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
            return text[1:-1]
        if text in ("", "~", "null"):
            return None
        if text in ("true", "false"):
            return text == "true"
        if text[0] in "[{&*|>!%@`":
            raise ValueError(text)
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    def bare(line: str) -> str:
        quote = ""
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and (not line[:i].strip(" -") or line[i - 1] in " :"):
                quote = c
            elif c == "#" and (not i or line[i - 1] in " \t"):
                return line[:i].rstrip()
        return line.rstrip()

    def parsed(text: str | None) -> str | None:
        top: dict = {}
        open_: list[tuple[int, dict | list | None, dict | None, str | None]] = [(-1, top, None, None)]
        try:
            for raw in (text or "").splitlines():
                line = bare(raw)
                if not line.strip() or line in ("---", "..."):
                    continue
                depth, body = len(line) - len(line.lstrip(" ")), line.strip()
                item = body.startswith("- ") or body == "-"
                while depth < open_[-1][0] or (depth == open_[-1][0] and not (item and not isinstance(open_[-1][1], dict))):
                    open_.pop()
                level, inside, parent, name = open_[-1]
                if item:
                    if not isinstance(inside, list):
                        inside = parent[name] = []  # the value of the key above
                        open_[-1] = (depth, inside, parent, name)
                    inside.append(scalar(body[1:].strip()))
                    continue
                key, colon, value = body.partition(":")
                if not colon or (value and value[0] not in " \t"):
                    raise ValueError(body)
                if not isinstance(inside, dict):
                    inside = parent[name] = {}
                    open_[-1] = (level, inside, parent, name)
                key = str(scalar(key.strip()))
                inside[key] = scalar(value.strip())
                if not value.strip():
                    open_.append((depth, None, inside, key))
        except (ValueError, TypeError):
            return None
        return json.dumps(top)

    return F.pandas_udf(lambda texts: texts.map(parsed), "string")(document)


def settings(document: Column, defaults: dict) -> Column:
    """A settings document (JSON; YAML through :func:`yaml_json`) as a struct: each value of ``defaults``, one level deep, unless the document has its own."""
    kinds = ", ".join(f"`{k}` {_KINDS[type(v)]}" for k, v in defaults.items())
    own = F.from_json(document, kinds)
    return F.struct(*(F.coalesce(own[k], F.lit(v)).alias(k) for k, v in defaults.items()))


def log_lines(rows: DataFrame, line: str) -> DataFrame:
    """Of the lines ``HH:MM:SS text`` clock (seconds of the day) and text; others are left out."""
    n = lambda i: F.regexp_extract(line, r"^(\d{2}):(\d{2}):(\d{2})\s+(.*)$", i)
    found = rows.where(n(1) != "")
    return found.withColumn("clock", n(1).cast("long") * 3600 + n(2).cast("long") * 60 + n(3).cast("long")).withColumn("text", n(4))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, clock (seconds of the day) and text of every ``HH:MM:SS text`` line, in order within its file."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return log_lines(rows, "line").select("file", F.col("line_no").cast("long").alias("line_no"), "clock", "text")


def pad_frames(frames: Column, n: int) -> Column:
    """An array of ``n``: the last element repeated, or cut."""
    return F.slice(F.concat(frames, F.array_repeat(F.element_at(frames, -1), n)), 1, n)


def uniform_samples(first: Column, last: Column, n: int) -> Column:
    """``n`` even places from first to last, truncated to whole ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (first + F.floor(i * (last - first) / max(n - 1, 1))).cast("long"))


def write_tables(rows: DataFrame, by: list[str], path: str) -> None:
    """One CSV folder for each value of ``by``; cells are quoted where they need it."""
    rows.write.mode("overwrite").partitionBy(*by).option("header", True).option("escape", "\"").csv(path)


def timeline_json(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each group's rows in order as one JSON array, keys and all: ``by`` and json."""
    cells = F.struct(*[c for c in rows.columns if c not in by])
    return rows.groupBy(*by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), cells.alias("c")))), lambda x: x["c"])).alias("json"))


def timeline_text(rows: DataFrame, by: list[str], order: str, start: Column, end: Column, kind: Column) -> DataFrame:
    """Each group's lines ``NN  start - end  kind``, numbered from 1."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    line = F.format_string("%2d  %s - %s  %s", number, start, end, kind)
    lines = rows.select(*by, F.col(order).alias("_o"), line.alias("line"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"]), "\n").alias("text"))


def edit_list(rows: DataFrame, by: list[str], seq: str, path: str, start: str, end: str, fallback: str) -> DataFrame:
    """What to cut from which file, in order; a part without a made file takes the source."""
    return rows.select(*by, F.col(seq).alias("pos"), F.coalesce(path, fallback).alias("path"), F.col(start).alias("start_us"), F.col(end).alias("end_us"))


def cut_list(rows: DataFrame, label: Column, source: str, start: str, end: str, root: str, suffix: str = ".mp4") -> DataFrame:
    """Where each part of a source goes as a training clip: source, start and end (kept from zero on) and target, in a folder of its label, named by source and start in milliseconds."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", "")
    at = F.greatest(F.col(start), F.lit(0))
    millis = F.floor(at / 1_000).cast("string")
    name = F.concat(stem, F.lit("_"), F.when(F.length(millis) < 9, F.lpad(millis, 9, "0")).otherwise(millis), F.lit(suffix))
    kept = rows.withColumn("_label", label).where(F.col("_label").isNotNull() & (F.col(end) > at))
    return kept.select(F.col(source).alias("source"), at.alias("start_us"), F.col(end).alias("end_us"), F.concat(F.lit(root.rstrip("/") + "/"), F.col("_label"), F.lit("/"), name).alias("target"))


def failure_cause(stderr: Column, code: Column) -> Column:
    """Why a program failed: disk full, a signal, or another error."""
    return F.when(F.lower(stderr).contains("no space left"), "disk full").when(code < 0, F.concat(F.lit("signal "), (-code).cast("string"))).when(code != 0, "error")


def in_rank_order(rows: DataFrame, by: list[str], rank: str, seq: str, ranks: tuple[str, ...] = ("FIRST", "SECOND", "THIRD")) -> DataFrame:
    """Of each listed rank the last row, with its place (from 1) in the order of ``ranks``."""
    place = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(rank))
    w = Window.partitionBy(*by, rank).orderBy(F.col(seq).desc())
    return rows.withColumn("place", place).where("place > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def description(lines: DataFrame, by: list[str], order: str, line: str, title: str = "__TITLE__") -> DataFrame:
    """Each group's lines in order below a title to be filled in."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n")
    return lines.groupBy(*by).agg(F.concat(F.lit(title + "\n\n"), text).alias("text"))


def newest_of_name(files: DataFrame, name: str, modified: str, path: str) -> DataFrame:
    """Of the files of one name the one written last (the first path of ties)."""
    w = Window.partitionBy(name).orderBy(F.col(modified).desc(), path)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
