import random

import pytest

from pyspark.sql import functions as F

from dossier.llm.entity_names import LIKE, match_names, pigeonhole_join, plain_text


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def limit(form):
    return 4 if len(form) >= 12 else 2 if len(form) >= 5 else 0


def test_join_misses_no_pair(spark):
    rng = random.Random(2)
    forms = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 20))) for _ in range(60)})
    texts = set()
    for form in forms:
        for _ in range(6):
            t = list(form)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.4:
                    t.insert(at, rng.choice("abcde"))
                elif t and at < len(t):
                    t[at : at + 1] = [] if rng.random() < 0.5 else [rng.choice("abcde")]
            texts.add("".join(t))
    texts = sorted(texts)
    got = {(r["text"], r["form"]): r["distance"] for r in pigeonhole_join(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    want = {(t, f): edit(t, f) for t in texts for f in forms if t and edit(t, f) <= limit(f)}
    assert got == want and len(want) > 100


LISTED = [
    ("1", "Kestrel Mining Inc", ["KSM"], ["Kestrel Mining", "Oldname"]),
    ("2", "Kestrel Foods PLC", [], []),
    ("3", "Barrowfield Robotics Holdings", ["BRH", None], None),
    ("4", "PELWORTH & NETWORKS LTD", None, ["Pelworth"]),
    ("5", None, ["ZZQ"], [None]),
]

CASES = {
    "kestrel mining": "1", "KESTREL  MINING INC.": "1", "Mining, Kestrel": "1", "The Kestrel Mining stock": "1", "Késtrel Mining": "1", "Kestrel_Mining": "1",
    "Kestrеl Mining": "1", "$KSM": "1", "NYSE: ksm": "1", "(NASDAQ:BRH)": "3", "ksm": "1", "KSM.N": "1", "oldname": "1", "Barrowfield": "3", "Barrowfield Robo": "3",
    "Barrowfeild Robotics": "3", "Barr0wfield Robotics (the company)": "3", "Pelworth and Networks": "4", "Pelworth Netwks": "4", "zzq": "5",
    "Kestrel": None, "Kestrel Media": None, "TBD": None, "somebody else entirely": None, "$NOPE": None, "?": None,
}


def test_cases(spark):
    listed = spark.createDataFrame(LISTED, "entity string, name string, tickers array<string>, aliases array<string>")
    rows = spark.createDataFrame([(c,) for c in CASES] * 2 + [(None,), (" ",), (" ",), ("x" * 5000,)], "raw string")
    got = {r["raw"]: r["entity"] for r in match_names(rows, listed).collect()}
    assert got.pop("x" * 5000) is None
    assert got == CASES


def test_empty_tables(spark):
    listed = spark.createDataFrame([], "entity string, name string, tickers array<string>, aliases array<string>")
    assert match_names(spark.createDataFrame([], "raw string"), listed).count() == 0
    rows = match_names(spark.createDataFrame([("a company", 1)], "raw string, cost int"), listed).collect()
    assert [(r["entity"], r["method"]) for r in rows] == [(None, "unmatched")]


def test_every_letter_has_its_plain_one(spark):
    letters = [(x, plain) for plain, like in LIKE.items() for x in like]
    assert len({x for x, _ in letters}) == len(letters) and all(plain.isascii() and len(plain) == 1 for plain in LIKE)
    got = spark.createDataFrame(letters, "x string, plain string").select("x", "plain", plain_text(F.upper("x")).alias("upper"), plain_text(F.col("x")).alias("lower")).collect()
    # the capital of dotless i is the plain one, and of the Turkish dotted one Java makes two characters
    assert [r["x"] for r in got if r["lower"] != r["plain"]] == []
    assert [r["x"] for r in got if r["upper"] != r["plain"] and r["x"] not in "ıʟ"] == []


@pytest.mark.parametrize("entry, entity", [("N\u043ekia", "n"), ("\u0410pple", "a"), ("\u0391pple", "a"), ("App\u029fe", "a")])
def test_look_alike_letters(spark, entry, entity):
    listed = spark.createDataFrame([("n", "Nokia", None, None), ("a", "Apple", None, None)], "entity string, name string, tickers array<string>, aliases array<string>")
    rows = match_names(spark.createDataFrame([(entry,)], "raw string"), listed).collect()
    assert [(r["entity"], r["method"], r["cost"]) for r in rows] == [(entity, "name", 0.0)]


def test_ties_are_reported(spark):
    listed = [("1", "Kestrel Inc", None, None), ("2", "Kestrel PLC", None, None), ("3", "Harwood Rail", None, None), ("4", "Harwood Ruil", None, None)]
    table = spark.createDataFrame(listed, "entity string, name string, tickers array<string>, aliases array<string>")
    rows = match_names(spark.createDataFrame([("Kestrel",), ("Harwood Reil",), ("Kestrel PLC",), ("nobody",)], "raw string"), table).collect()
    assert {r["raw"]: (r["entity"], r["method"]) for r in rows} == {"Kestrel": (None, "tie"), "Harwood Reil": (None, "tie"), "Kestrel PLC": ("2", "name"), "nobody": (None, "unmatched")}
