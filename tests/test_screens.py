"""Tables and cards read off screens, and the time that runs take, against plain Python."""

import json
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import aggregates as ag
from spanloom.operators import joins as jn
from spanloom.operators import progress as pg
from spanloom.operators import screens as scr
from spanloom.sources import media


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_words_go_to_the_nearest_cell_of_their_own_screen(spark):
    draw = random.Random(3)
    columns = {s: sorted(draw.sample(range(0, 400, 3), 5)) for s in (1, 2)}
    lines = {s: sorted(draw.sample(range(0, 300, 7), 6)) for s in (1, 2)}
    names = ["PLAYER", "G", "A", "S", "MIN"]
    words = [(s, draw.choice(["7", "12", "O1", " ", ""]), draw.randrange(100), float(draw.randrange(420)), float(draw.randrange(320)), i) for i, s in enumerate([1, 2] * 120)]
    words.append((1, "5", 99, (columns[1][1] + columns[1][2]) / 2, float(lines[1][0]), -1))  # halfway: the lower column
    want = {}
    for s, text, conf, x, y, o in sorted(words, key=lambda w: w[5]):
        if text.strip() and conf >= 20:
            c = min(range(5), key=lambda i: abs(columns[s][i] - x))
            r = min(range(6), key=lambda i: abs(lines[s][i] - y))
            if names[c] != "PLAYER":
                v = text.replace("O", "0")
                want.setdefault((s, r, names[c]), "-" if names[c] == "MIN" else v)
    got = scr.cells(
        spark.createDataFrame(words, "screen long, text string, conf int, x double, y double, ord long"), ["screen"],
        spark.createDataFrame([(s, n, float(c)) for s, own in columns.items() for n, c in zip(names, own)], "screen long, column string, cx double"),
        spark.createDataFrame([(s, i, float(c)) for s, own in lines.items() for i, c in enumerate(own)], "screen long, row_no int, cy double"),
    )
    assert {tuple(r[:3]): r.value for r in got.collect()} == want and (1, 0, names[1]) in want


def test_tables_end_at_the_third_empty_row(spark):
    grid = spark.createDataFrame([(s, i, float(10 * i)) for s in (1, 2) for i in range(8)], "screen long, row_no int, cy double")
    columns = spark.createDataFrame([(s, n, c) for s in (1, 2) for n, c in (("PLAYER", 0.0), ("G", 100.0))], "screen long, column string, cx double")
    words = spark.createDataFrame([(1, "3", 90, 100.0, 0.0, 0), (1, "x", 90, 100.0, 10.0, 1), (1, "4", 90, 100.0, 60.0, 2), (2, "1", 90, 100.0, 30.0, 3)], "screen long, text string, conf int, x double, y double, ord long")
    names = spark.createDataFrame([(2, 0, "0. Bo Lee x y"), (2, 1, "|"), (2, 4, "Al")], "screen long, row_no int, line string")
    got = [(r.screen, r.row_no, r.name, r.cells) for r in scr.tables(words, ["screen"], columns, grid, names).orderBy("screen", "row_no").collect()]
    # Row 1 of screen 1 holds no number and counts as empty, as do 2 and 3: the table ends there.
    assert got == [(1, 0, "", {"G": "3"}), (2, 0, "Bo Lee x", {}), (2, 1, "", {}), (2, 2, "", {}), (2, 3, "", {"G": "1"}), (2, 4, "Al", {})]


def test_votes_at_each_position(spark):
    draw = random.Random(8)
    data, want = [], {}
    for card in range(30):
        reads = [([draw.choice(["1", "2", "7", "-", None]) for _ in range(draw.randrange(0, 5))], draw.choice([1, 2])) for _ in range(draw.randrange(1, 9))]
        data += [(card, i, v, w) for i, (v, w) in enumerate(reads)]
        votes = [Counter() for _ in range(3)]
        for v, w in reads:
            for i, x in enumerate(v[:3]):
                if x is not None:
                    votes[i][x] += w
        if any(votes):
            best = [c.most_common(1)[0][0] if c else "0" for c in votes]
            want[card] = [b if b.isdigit() else "0" for b in best]
    df = spark.createDataFrame(data, "card long, at long, digits array<string>, weight int")
    assert {r.card: r.digits for r in scr.position_votes(df, ["card"], "digits", "weight", ["at"]).collect()} == want


def test_the_longest_word_of_the_bottom_line(spark):
    words = [(1, "Martin", 10, 0), (1, "Necas", 200, 1), (1, "Ab", 300, 2), (1, "Nec", 141, 3), (1, "Necat", 180, 4), (2, "a1", 5, 5)]
    got = rows(scr.bottom_word(spark.createDataFrame(words, "card long, text string, top int, o long"), ["card"], "text", "top", "o"))
    assert got == [(1, "Necas")]


@pytest.mark.parametrize("bins", [1, 3, 4_096])
def test_medians_of_any_numbers(spark, bins):
    draw = random.Random(bins)
    data = [(k, draw.choice([draw.random() * 10**draw.randrange(1, 9), 5.0, 7.5, -3.25])) for k in "abc" for _ in range(draw.randrange(1, 60))] + [("d", 1.5)] + [("e", 2.0)] * 4
    want = [(k, statistics.median(v for x, v in data if x == k)) for k in "abcde"]
    assert rows(pg.medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v", bins)) == want


def test_time_left_by_frames_segments_or_as_always(spark):
    headers = [(r, i, t, s) for r, times in ((1, (0, 100, 160)), (2, (0, 200, 8_000)), (3, (0, 50, 70))) for i, (t, s) in enumerate(zip(times, ("split", "look", "end")))]
    runs = [(1, 20, 1_000, True, 190), (2, 5, 90, True, 8_030), (3, 40, 2_000, False, 100)]
    h = spark.createDataFrame(headers, "run long, i long, at long, step string")
    r = spark.createDataFrame(runs, "run long, n_segments long, n_frames long, completed boolean, last_at long")
    times = pg.learned(pg.step_times(h, r, ["run"], "i", "at", "step", "end"), "step", ["look"], ["split"])
    # split: 100, 200, 50; of runs 1 and 3 10 and 40 frames a second. look: 60, 20 (7,800 is a stall). end: 30, 30 (run 3 wasn't completed).
    assert rows(times) == [("end", 30.0, None, None), ("look", 40.0, (60 / 20 + 20 / 40) / 2, None), ("split", 100.0, None, 25.0)]
    steps = ["split", "look", "end", "more"]
    now = spark.createDataFrame([(9, 12, 500), (8, None, None)], "run long, n_segments long, n_frames long")
    head = spark.createDataFrame([(9, 0, 1_000, "split"), (9, 1, 1_010, "look"), (8, 0, 5, "end")], "run long, i long, at long, step string")
    got = {(x.run, x.step): (x.total, x.elapsed, x.remaining, x.frames_a_second) for x in pg.time_left(head, now, steps, times, ["run"], "i", "at", "step", ["split"]).collect()}
    assert got == {(9, "split"): (20 + 21 + 30, 0, 71, None), (9, "look"): (71, 10, 51, 50.0), (8, "end"): (100 + 40 + 30, 0, 30, None)}


def test_candidates_of_the_fuzzy_join_are_few(spark):
    """Two thousand random surnames: fewer than one pair in a hundred is compared."""
    draw = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgk"
    names = sorted({"".join(draw.choices(letters, [1 / (i + 1) ** 0.5 for i in range(len(letters))], k=draw.randrange(4, 11))) for _ in range(2_000)})
    often = Counter(t for n in names for t in jn._tokens(n))
    left, right = (spark.createDataFrame([(n,) for n in names], "n string").select("n", jn._fuzzy_keys(0.85, dict(often), first)("n").alias("k")).selectExpr("n", "explode(k) as k") for first in (True, False))
    pairs = left.join(right.withColumnRenamed("n", "m"), "k").select("n", "m").distinct().count()
    assert pairs < 0.01 * len(names) ** 2


@pytest.mark.parametrize("bins", [1, 7, 4_096])
def test_quantiles_and_what_is_above(spark, bins):
    draw = random.Random(bins)
    data = [(k, draw.choice([1.0, 2.0, 2.5, draw.random() * 40, None])) for k in "abcd" for _ in range(draw.randrange(3, 70))]
    for share in (0.0, 0.3, 0.85, 1.0):
        got = {r.k: (r.level, r.above) for r in ag.quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", share, bins).collect()}
        for k in "abcd":
            own = sorted(v for x, v in data if x == k and v is not None)
            place = (len(own) - 1) * share
            low, part = int(place), place - int(place)
            level = own[low] if low + 1 >= len(own) else own[low] * (1 - part) + own[low + 1] * part
            assert got[k][0] == pytest.approx(level, abs=1e-12) and got[k][1] == sum(v > got[k][0] for v in own)


def test_yaml_documents(spark):
    cases = {
        "a: 1\nb: 0.5 # half\nc: \"x # y\"\nd: 'q'\ne: ~\nf:\ng: true\n": {"a": 1, "b": 0.5, "c": "x # y", "d": "q", "e": None, "f": None, "g": True},
        "# only\n---\ntop:\n  in:\n    deep: 3\n  more: no\nlast: z:z\n": {"top": {"in": {"deep": 3}, "more": "no"}, "last": "z:z"},
        "l:\n  - a\n  - 2\n  - \"b c\"\nm:\n- x\nn: 1": {"l": ["a", 2, "b c"], "m": ["x"], "n": 1},
        "": {}, "a: [1]": None, "a: |\n  x": None, "just words": None, "a: &x 1": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    got = [r.j and json.loads(r.j) for r in df.select("i", media.yaml_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == [*cases.values(), {}]


def test_pages_that_many_screens_show_give_what_their_own_words_give(spark):
    draw = random.Random(4)
    columns, lines, right, down = {"PLAYER": 20, "G": 61, "A": 110, "MIN": 150}, {i: 30 * i for i in range(1, 6)}, [0, 1, 2, 7], [0, 3, 5]
    words = [(p, draw.randrange(100), draw.randrange(-20, 220), draw.randrange(-10, 200), i * 8 + draw.randrange(8)) for i, p in enumerate([1, 2] * 400)]
    screens = [(i, draw.choice([1, 2, 3]), float(draw.choice(right)), float(draw.choice(down))) for i in range(40)]
    text = lambda key: F.when(key % 8 == 7, F.lit(" ")).otherwise((key % 8).cast("string"))
    w = spark.createDataFrame(words, "page long, conf int, x long, y long, key long")
    s = spark.createDataFrame(screens, "screen long, page long, dx double, dy double")
    got = scr.page_cells(w, ["page"], s, ["screen"], columns, lines, right, down, text)
    own = s.join(w, "page").select("screen", text(F.col("key")).alias("text"), "conf", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("key").alias("ord"))
    across = spark.createDataFrame([(i, n, c + dx) for i, _, dx, _ in screens for n, c in columns.items()], "screen long, column string, cx double")
    along = spark.createDataFrame([(i, n, c + dy) for i, _, _, dy in screens for n, c in lines.items()], "screen long, row_no int, cy double")
    want = rows(scr.cells(own, ["screen"], across, along).select(*got.columns))
    assert len(want) > 200 and rows(got) == want
