"""Scalars that clean what was read from a screen: every one a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns, texts and limits that decide the results.
BANNER_WORDS = ("GOAL", "QOAL", "GOAI", "ASSIST", "SCORED", "SCORER")
CLOCK, LONE_DIGIT, SHOTS = r"\d{1,2}:\d{2}", r"(?<![:\d])(\d)(?!\d)", r"^\d{1,2}$"
ENDING_O, LONE_O = r"([A-Z]{2,3})O\b", r"\bO\b"
ONE_LIKE = "[FIlO|]"
STAR_STATS = r"^GOALS: (\d+) \| ASSISTS: (\d+) \| HITS: (\d+)$"
SCORE_LINE = r"(?i)(END|GAME|OVER|\d\s*[-–]\s*\d)"
HEADER = r"PAUSE\s+(.+?)\s+STATS"
WATCH_ID = r"/watch\?v=([A-Za-z0-9_-]+)"
KINDS = {"intro": "VS screen → opening faceoff", "game_end": "final buzzer / scoreboard", "end_of_regulation": "3rd-period buzzer", "banner": "banner-confirmed", "inferred": "faceoff-pattern inferred"}
PERIOD_NAMES = {2: "2ND PERIOD", 3: "3RD PERIOD"}
OVERTIME = "OVERTIME"
NAME_CHARS, NAME_WORD, NAME_VOWEL, NAME_WORDS = r"[^A-Za-z\s'-]", "^[A-Za-z]{3,15}$", "[AEIOUaeiou]", 3
FULL_CLOCK_MINUTES, NEAR_ZERO_SECONDS, RUNNING_SECONDS = 20, 5, 5
CARD_MATCH, CARD_DEVIATION, CARD_BRIGHTNESS = 0.65, 10, 140

_DIGITS = r"^\d+$"


def looks_like_banner(text: Column) -> Column:
    """An overlay and no scoreboard: a keyword, or five capitals in a row."""
    return F.upper(text).rlike("|".join(BANNER_WORDS) + "|[A-Z]{5,}")


def parse_score(text: Column) -> Column:
    """The last lone digit, without a clock; an O that ends two or three capitals, or stands alone, is a zero."""
    s = F.regexp_replace(text, CLOCK, "")
    s = F.regexp_replace(s, ENDING_O, "$1 0")
    s = F.regexp_replace(s, LONE_O, "0")
    found = F.regexp_extract_all(s, F.lit(LONE_DIGIT), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def parse_shots(text: Column) -> Column:
    """One or two digits and nothing else, else null."""
    return F.when(F.trim(text).rlike(SHOTS), F.trim(text).cast("int"))


def parse_board(text: Column) -> Column:
    """``away|shots|clock`` over ``home|shots``: a struct of four numbers, all null for an overlay."""
    lines = F.split(text, "\n")
    away, home = F.split(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"\|"), F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\|")
    ok = ~looks_like_banner(text)
    pick = lambda parts, i, f: F.when(ok, f(F.get(parts, F.lit(i))))
    return F.struct(pick(away, 0, parse_score).alias("score_away"), pick(home, 0, parse_score).alias("score_home"), pick(away, 1, parse_shots).alias("shots_away"), pick(home, 1, parse_shots).alias("shots_home"))


def clean_numeric(value: Column, column: Column) -> Column:
    """A numeric cell: O and o are 0, I and l are 1; ``-`` where no number is left, empty where nothing was read."""
    v = F.translate(value, "OoIl", "0011")
    zeros = F.translate(value, "Oo", "00")
    share = F.when(zeros.startswith("-"), F.concat(F.lit("."), F.substr(zeros, F.lit(2)))).when(zeros.rlike(r"^\d"), F.concat(F.lit("."), zeros)).otherwise(zeros)
    digits = F.regexp_replace(v, r"\D", "")
    minutes = F.when(v.rlike(r"^\d{1,2}:\d{2}$"), v).when(F.length(digits) == 4, F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))).otherwise("-")
    plain = F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v).otherwise("-")
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(column == "SV%", share).when(column == "MIN", minutes).otherwise(plain)


def _number(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)).cast("long")


def clock_class(text: Column) -> Column:
    """What a clock and its period label say: game_start, period_start, period_end, regulation_end, ot_period_end or null."""
    up = F.upper(text)
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    start = (F.size(n) >= 2) & (_number(n, 0) == FULL_CLOCK_MINUTES) & (_number(n, 1) == 0)
    head = F.regexp_extract_all(F.element_at(F.split(text, r"\."), 1), F.lit(r"(\d+)"), F.lit(1))
    point = F.when(F.size(head) == 0, F.lit(True)).otherwise(F.element_at(F.when(F.size(head) > 0, head).otherwise(F.array(F.lit("1"))), -1).cast("long") == 0)
    whole = F.when(F.size(n) >= 2, (_number(n, 0) == 0) & (_number(n, 1) <= NEAR_ZERO_SECONDS)).when(F.size(n) == 1, _number(n, 0) <= NEAR_ZERO_SECONDS).otherwise(False)
    near = F.when(text.contains("."), point).otherwise(whole)
    end = F.when(up.contains("OT"), "ot_period_end").when(up.contains("3RD"), "regulation_end").when(up.rlike("1ST|2ND"), "period_end")
    return F.when(start, F.when(up.contains("1ST"), "game_start").when(up.rlike("2ND|3RD|OT"), "period_start").otherwise("game_start")).when(near, end)


def mid_period(text: Column) -> Column:
    """A confident reading of a running clock: 0 to 19 minutes, or 20 and over five seconds."""
    head = F.element_at(F.split(F.trim(text), "\n"), 1)
    n = F.regexp_extract_all(head, F.lit(r"(\d+)"), F.lit(1))
    read = head.rlike("[:.]") & (F.size(n) >= 2)
    return F.coalesce(read & ((_number(n, 0) < FULL_CLOCK_MINUTES) | ((_number(n, 0) == FULL_CLOCK_MINUTES) & (_number(n, 1) > RUNNING_SECONDS))), F.lit(False))


def clean_name(name: Column) -> Column:
    """At most three words of 3 to 15 letters with a vowel."""
    words = F.split(F.trim(F.regexp_replace(name, NAME_CHARS, " ")), r"\s+")
    return F.concat_ws(" ", F.slice(F.filter(words, lambda w: w.rlike(NAME_WORD) & w.rlike(NAME_VOWEL)), 1, NAME_WORDS))


def name_quality(name: Column) -> Column:
    """Words of three letters or more, four at most."""
    return F.least(F.lit(4), F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w.rlike(r"^\p{L}{3,}$"))))


def title_score(name: Column) -> Column:
    """Words with a capital first and small letters after."""
    return F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$")))


def plausible_name(name: Column) -> Column:
    """Begins with a letter, and some word has three letters."""
    words = F.split(F.trim(name), r"\s+")
    return F.coalesce(F.trim(name).rlike(r"^\p{L}") & F.exists(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 3), F.lit(False))


def player_line(line: Column) -> Column:
    """Words with a letter, three at most; a first ``0.`` is not one, so an initial O read as zero is mended first."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    first = F.when(F.get(words, F.lit(0)) == "0.", F.concat(F.array(F.lit("O.")), F.slice(words, 2, 1_000))).otherwise(words)
    return F.concat_ws(" ", F.slice(first, 1, 3))


def safe_int(text: Column) -> Column:
    return F.when(F.trim(text).rlike(_DIGITS), F.trim(text).cast("long"))


def star_line(stats: Column) -> Column:
    """``GOALS: 2 | ASSISTS: 0 | HITS: 8`` as ``2 G, 0 A, 8 hits``; other text stays."""
    s = F.trim(stats)
    return F.when(s.rlike(STAR_STATS), F.regexp_replace(s, STAR_STATS, "$1 G, $2 A, $3 hits")).otherwise(s)


def skater_line(player: Column, minutes: Column, goals: Column, assists: Column, points: Column, hits: Column) -> Column:
    """One line for a skater; null where the name is no name or goals and assists don't make the points."""
    name = F.replace(F.trim(player), F.lit(","), F.lit("."))
    g, a, p, h = safe_int(goals), safe_int(assists), safe_int(points), safe_int(hits)
    ice = F.when(F.trim(minutes).rlike(r"^\d{1,2}:\d{2}$"), F.trim(minutes)).otherwise("-")
    line = F.concat(name, F.lit(" — "), ice, F.lit(" | "), g.cast("string"), F.lit(" G, "), a.cast("string"), F.lit(" A, "), p.cast("string"), F.lit(" P"), F.coalesce(F.concat(F.lit(" | "), h.cast("string"), F.lit(" hits")), F.lit("")))
    return F.when(plausible_name(name) & (g + a == p), line)


def goalie_line(player: Column, shots: Column, share: Column, against: Column) -> Column:
    """One line for a goalie; null without a name or any number."""
    name = F.replace(F.trim(player), F.lit(","), F.lit("."))
    parts = F.array_compact(F.array(F.concat(safe_int(shots).cast("string"), F.lit(" shots")), F.when(F.trim(share).rlike(r"^[01]?\.\d{2,3}$"), F.concat(F.trim(share), F.lit(" SV%"))), F.concat(safe_int(against).cast("string"), F.lit(" GA"))))
    return F.when(plausible_name(name) & (F.size(parts) > 0), F.concat(name, F.lit(" — "), F.concat_ws(", ", parts)))


def scene_label(path: Column) -> Column:
    """The number after ``scene-`` in a file's stem, else the stem."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    number = F.regexp_extract(stem, r"scene-(\d+)", 1)
    return F.when(number != "", number).otherwise(stem)


def timecode(seconds: Column) -> Column:
    """MM:SS, rounded half to even."""
    t = F.bround(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(t / 60), t % 60)


def duration_text(seconds: Column) -> Column:
    """``1h 23m``, ``5m 12s`` or ``47s``."""
    t = F.greatest(F.lit(0), seconds.cast("long"))
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def stable_id(stem: Column) -> Column:
    return F.concat(F.lit("local-"), F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_"))


def strip_suffix(stem: Column, labels: list[str]) -> Column:
    """Without the first of the labels, in their order, that ends the stem after an underscore."""
    out = stem
    for label in reversed(labels):
        out = F.when(stem.endswith("_" + label), F.substring(stem, F.lit(1), F.length(stem) - len(label) - 1)).otherwise(out)
    return out


def digit_line(text: Column) -> Column:
    """Letters that a one is taken for."""
    return F.regexp_replace(text, ONE_LIKE, "1")


def id_from_output(text: Column) -> Column:
    """The id of the first watch address in a program's output, else null."""
    found = F.regexp_extract(text, WATCH_ID, 1)
    return F.when(found != "", found)


def score_line(text: Column) -> Column:
    """The first line with END, GAME, OVER or a score, else the first line, else empty."""
    lines = F.split(F.trim(text), "\n")
    hit = F.filter(lines, lambda x: x.rlike(SCORE_LINE))
    return F.coalesce(F.trim(F.coalesce(F.get(hit, F.lit(0)), F.get(lines, F.lit(0)))), F.lit(""))


def clip_name(prefix: Column, seconds: Column) -> Column:
    """A name with the time as seven characters, one decimal, zeros before."""
    return F.format_string("%s_%07.1f", prefix, seconds)


def group_kind(row: dict[str, Column]) -> Column:
    """What a group of the output is: a struct (kind, detail); the first flag that holds decides."""
    pair = lambda k, d: F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail"))
    name = F.coalesce(*(F.when(row["to_period"] == n, text) for n, text in PERIOD_NAMES.items()), F.lit(OVERTIME))
    return (
        F.when(row["transition"], F.struct(F.lit("transition").alias("kind"), name.alias("detail")))
        .when(row["intro"], pair("intro", KINDS["intro"]))
        .when(row["game_end"], pair("game_end", KINDS["game_end"]))
        .when(row["regulation_end"], pair("end_of_regulation", KINDS["end_of_regulation"]))
        .when(row["banner"], pair("goal", KINDS["banner"]))
        .when(row["inferred"], pair("goal", KINDS["inferred"]))
        .otherwise(F.struct(F.coalesce(row["label"], F.lit("highlight")).alias("kind"), F.lit("").alias("detail")))
    )


def header_team(text: Column) -> Column:
    """The team that a statistics screen's header names, in capitals; empty where it names none."""
    return F.trim(F.regexp_extract(F.upper(F.trim(text)), HEADER, 1))


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is in the text, whatever its case."""
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | up.contains(w.upper())
    return out


def settled_picture(match: Column, deviation: Column, brightest: Column) -> Column:
    """A card has stopped moving: its label matches, or it is lively and bright enough."""
    return (match >= CARD_MATCH) | ((deviation >= CARD_DEVIATION) & (brightest > CARD_BRIGHTNESS))
