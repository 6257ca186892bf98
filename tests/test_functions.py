import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators.entities import Matcher
from dossier.sources.html import page_text


def pack(text, budget):
    """The packing in plain Python."""
    spans, offset, start, words, end = [], 0, None, 0, 0
    for paragraph in text.split("\n"):
        count = len([w for w in re.split(r"[\s   -     　]+", paragraph) if w])
        if count:
            start = offset if start is None else start
            words, end = words + count, offset + len(paragraph)
            if words >= budget:
                spans.append((start, end))
                start, words = None, 0
        offset += len(paragraph) + 1
    return spans + ([(start, end)] if start is not None else [])


TEXTS = ["", "\n\n", "one two\n\nthree", "a b c d\ne f\n\n  \ng", "ä ß x\n😀 y z\nq" * 3, "w " * 700]


def test_packing(spark):
    texts = list(TEXTS)

    @settings(max_examples=60, derandomize=True, deadline=None)
    @given(st.text(alphabet="ab \n\té", max_size=80))
    def more(t):
        texts.append(t)

    more()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.packed_spans(F.col("t"), 3).alias("s")).collect()
    assert {r["i"]: [tuple(x) for x in r["s"]] for r in rows} == {i: pack(t, 3) for i, t in enumerate(texts)}


def test_feature_hash(spark):
    text = "Größe matters matters 😀 x"
    rows = T.feature_hash(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
    want = {}
    for w in text.lower().split():
        d = sha256(w.encode()).digest()
        dim = int.from_bytes(d[:4], "big") % 384
        want[dim] = want.get(dim, 0) + (1 if d[4] % 2 else -1)
    norm = sum(v * v for v in want.values()) ** 0.5
    assert {r["k"] for r in rows} == {1}
    assert {r["dim"]: round(r["weight"], 9) for r in rows} == {d: round(v / norm, 9) for d, v in want.items() if v}


def test_timeframes_and_aliases(spark):
    labels = ["2024", "2024Q3", "2024-02", "2024-13", "2024-00", "20x4", "", None, " 2023 "]
    start, end = T.timeframe(F.col("l"))
    rows = spark.createDataFrame([(x,) for x in labels], "l string").select(start.cast("string").alias("s"), end.cast("string").alias("e")).collect()
    assert [(r["s"], r["e"]) for r in rows] == [("2024-01-01", "2025-01-01"), ("2024-07-01", "2024-10-01"), ("2024-02-01", "2024-03-01")] + [(None, None)] * 5 + [("2023-01-01", "2024-01-01")]
    names = {"Apple Inc.": "Apple", "NVIDIA CORP": "NVIDIA", "ABC Inc": None, "Alphabet": None, None: None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.alias_of(F.col("n")).alias("a")).collect()
    assert {r["n"]: r["a"] for r in rows} == names


LISTED = [("1", "Agilent", ["A"], []), ("2", "Gartner", ["IT"], None), ("3", "NVIDIA Corp", ["NVDA"], ["NVIDIA"]), ("4", "Apple Inc.", ["AAPL"], ["Apple"])]


def test_matcher():
    find = Matcher(LISTED).find
    assert find("IT spending by A and IT teams") == []
    assert [c for *_, c in find("$NVDA rose; Agilent (NYSE: A) too")] == ["3", "1", "1"]
    assert find("an apple pie") == [] and find("NVIDIAX") == []
    assert find("Apple Inc. said") == [(0, 10, "4")]
    assert find("(NASDAQ: AAPL) $AAPL") == [(0, 14, "4"), (15, 20, "4")]


def test_pages():
    assert page_text("<h1>A</h1>\n\n\n<script>x<y</script><p>b &amp; c<noscript>n</noscript></p>") == "A\n\nb & c"
    assert page_text(None) is None and page_text("") == "" and page_text("no markup < 3") == "no markup < 3"
