"""Free-entered names mapped to a canonical list by a partition-based pigeonhole join.

Distinct entries are brought to a normal form and matched with the forms of the listed
entities: names and aliases with and without their legal ending, tickers, and first words that
only one entity has. Every form is matched within an edit distance k that depends on its length, 0
included: a listed form is cut into k + 1 segments, and a string within k edits must contain one of them unchanged, at a
position that the other segments' edits can shift only so far. So candidates come from an
equality join on (form length, segment number, text), and are verified with the built-in
Levenshtein distance. Entries without a match are found by an anti-join and reported, ties apart.

Everything is a built-in SQL function; there is no UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.session import cut_lineage, read_table

# Letters with marks, and letters of other scripts that look like Latin ones, by the plain letter.
LIKE = {
    "a": "àáâãäåāăąаα", "b": "в", "c": "çćčс", "d": "ďԁ", "e": "èéêëēĕėęěе", "g": "ğ", "h": "һн", "i": "ìíîïīįıіι", "j": "ј", "k": "кκ", "l": "łʟ", "m": "м", "n": "ñńň",
    "o": "òóôõöøōőоο", "p": "рρ", "r": "ř", "s": "śşšѕ", "t": "ťтτ", "u": "ùúûüūůűυ", "v": "ν", "x": "х", "y": "ýÿу", "z": "źżž",
}

# Legal endings of company names, and words around a name that aren't part of it.
LEGAL = "inc incorporated incorp corp corporation corporatn co company ltd limited plc llc group grp holding holdings hldgs global ag sa nv"
BEFORE = "the old former formerly ticker"
AFTER = "stock shares share parent subsidiaries and"
EXCHANGES = "nyse nasdaq amex cboe lse otc tsx"

SPACE = r"[\s\p{Z}]+"


def _alternatives(words: str) -> str:
    return "|".join(words.split())


def plain_text(column: Column) -> Column:
    """Lower case, without marks on letters and look-alike letters, blanks as one."""
    text = F.regexp_replace(F.lower(column), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.translate(text, "".join(LIKE.values()), "".join(plain * len(letters) for plain, letters in LIKE.items())), SPACE, " "))


def name_words(text: Column) -> Column:
    """The words of a name as one string: no bracketed notes, quotes or "'s"; "Foods, Acme" turned round; 0 and 1 in words read as letters."""
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"['’]s(?![\p{L}])", "")
    text = F.regexp_replace(text, rf"^\s*([^,]+), (?!(?:{_alternatives(LEGAL)})\b)([^,]+)$", "$2 $1")
    text = F.regexp_replace(F.regexp_replace(text, r"[.'’]", ""), r"[^a-z0-9]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=[a-z])0|0(?=[a-z])", "o"), r"(?<=[a-z])1|1(?=[a-z])", "l")
    text = F.regexp_replace(F.trim(text), rf"^(?:(?:{_alternatives(BEFORE)}) )+", "")
    text = F.regexp_replace(text, rf"(?: (?:{_alternatives(AFTER)}))+$", "")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"( and)+ ", " "))


def whole_form(words: Column) -> Column:
    return F.regexp_replace(words, " ", "")


def core_form(words: Column) -> Column:
    """The form without legal endings."""
    return whole_form(F.regexp_replace(words, rf"(?: (?:{_alternatives(LEGAL)}))+$", ""))


def ticker_of(text: Column) -> Column:
    """The ticker that a plain entry consists of; NULL if it isn't one."""
    patterns = (
        rf"^\(? ?(?:{_alternatives(EXCHANGES)}) ?: ?([a-z]{{1,6}}) ?\)?$",
        r"^\$([a-z]{1,6})$",
        r"^ticker:? ([a-z]{1,6})$",
        r"^([a-z]{1,6})\.(?:n|o|l|k|oq)$",
        r"^\$?([a-z]{1,6}) (?:us|un|uw|ln|stock|shares|equity)$",
        r"^([a-z]{1,6})$",
    )
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*(F.when(f != "", f) for f in found))


def listed_forms(listed: DataFrame) -> DataFrame:
    """(form, kind, entity, n) of ``listed(entity, name, tickers, aliases)``; ``n`` entities share the form, of which the smallest is given."""
    names = listed.select("entity", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    words = names.select("entity", name_words(plain_text(F.col("name"))).alias("words"))
    forms = words.select("entity", F.explode(F.array_distinct(F.array(whole_form(F.col("words")), core_form(F.col("words"))))).alias("form"), F.lit("name").alias("kind"))
    heads = listed.select("entity", F.substring_index(name_words(plain_text(F.col("name"))), " ", 1).alias("form"), F.lit("head").alias("kind")).where(F.length("form") >= 5)
    tickers = listed.select("entity", F.explode("tickers").alias("t")).select("entity", plain_text(F.col("t")).alias("form"), F.lit("ticker").alias("kind"))
    every = forms.union(heads).union(tickers).where("form <> ''").distinct()
    return every.groupBy("form", "kind").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("n"))


def allowed(length: Column) -> Column:
    """Edits that a form of this length is searched within."""
    return F.when(length >= 12, 4).when(length >= 5, 2).otherwise(0)


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i (from 0) of k + 1 nearly equal ones."""
    start = F.floor(i * length / (k + 1)).cast("int")
    return start, (F.floor((i + 1) * length / (k + 1)) - start).cast("int")


def pigeonhole_join(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """(text, form, distance) for ``entries(text)`` and ``forms(form)`` within the edits allowed for the form's length."""
    size, k = F.length("form"), allowed(F.length("form"))
    cut = forms.select("form", size.alias("size"), k.alias("k"), F.explode(F.sequence(F.lit(0), k)).alias("i"))
    start, width = _segment(F.col("size"), F.col("k"), F.col("i"))
    cut = cut.select("form", "size", "i", F.substring("form", start + 1, width).alias("part"))
    most = 4
    n = F.length("text")
    probes = entries.where(n >= 1).select("text", n.alias("n"), F.explode(F.sequence(F.greatest(n - most, F.lit(1)), n + most)).alias("size"))
    probes = probes.withColumn("k", allowed(F.col("size"))).where(F.abs(F.col("n") - F.col("size")) <= F.col("k"))
    probes = probes.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), (F.col("n") - F.col("size")).alias("delta"))
    # an alignment in which segment i is the first unchanged one has at most i edits before it and k - i after
    low = F.greatest(-F.col("i"), F.col("delta") - (F.col("k") - F.col("i")))
    high = F.least(F.col("i"), F.col("delta") + (F.col("k") - F.col("i")))
    start, width = _segment(F.col("size"), F.col("k"), F.col("i"))
    probes = probes.select("text", "n", "size", "i", start.alias("start"), width.alias("width"), low.alias("low"), high.alias("high")).where("low <= high")
    probes = probes.select("text", "n", "size", "i", "width", F.explode(F.sequence(F.col("start") + F.col("low"), F.col("start") + F.col("high"))).alias("at")).where("at >= 0 and at + width <= n")
    probes = probes.select("text", "size", "i", F.substring("text", F.col("at") + 1, F.col("width")).alias("part"))
    pairs = probes.join(cut, ["size", "i", "part"]).select("text", "form").distinct()
    return pairs.withColumn("distance", F.levenshtein("text", "form")).where(F.col("distance") <= allowed(F.length("form")))


def _best(matches: DataFrame) -> DataFrame:
    """For each raw entry the entity at its smallest cost, where only one entity has it."""
    first = W.partitionBy("raw").orderBy("cost")
    return matches.withColumn("place", F.rank().over(first)).where("place = 1").groupBy("raw").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("n"), F.min("cost").alias("cost"), F.min("method").alias("method"))


def match_names(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(raw, entity, method, cost) for the distinct values of ``entries(raw)``; entity NULL and method ``unmatched`` or ``tie`` without a match.

    ``listed(entity, name, tickers, aliases)`` is the canonical list; NULL names, NULL arrays and
    NULL elements are allowed. NULL and blank entries have no row. A value as near to two
    entities, or equal to a form that they share, is a tie unless another form decides. Repeated rows change nothing; an empty list leaves all unmatched.
    """
    raw = entries.select("raw").where(F.length(F.regexp_replace("raw", SPACE, "")) > 0).distinct()
    text = raw.select("raw", plain_text(F.col("raw")).alias("text"))
    words = cut_lineage(text.select("raw", "text", name_words(F.col("text")).alias("words"), ticker_of(F.col("text")).alias("ticker"), F.regexp_extract("text", r"\(([a-z]{1,6})\)", 1).alias("noted")))
    every_form = cut_lineage(listed_forms(listed))
    forms = every_form.where("n = 1").select("form", "kind", "entity")
    w = F.col("words")

    # whole and core forms of the entries, against the forms of names and first words
    sides = words.select("raw", F.explode(F.array(F.struct(whole_form(w).alias("text"), F.lit("whole").alias("side")), F.struct(core_form(w).alias("text"), F.lit("core").alias("side")))).alias("s"))
    texts = cut_lineage(sides.select("raw", "s.*").where("text <> ''"))
    near = pigeonhole_join(texts.select("text").distinct(), forms.where("kind <> 'ticker'").select("form").distinct())
    letters = lambda c: F.array_sort(F.split(c, ""))
    limit = F.when(F.length("form") >= 12, 3).when(F.length("form") >= 8, 2).when(F.length("form") >= 5, 1).otherwise(0)
    near = near.where((F.col("distance") <= limit) | (letters(F.col("text")) == letters(F.col("form"))))  # one more edit where letters only changed places
    equal = F.when((F.col("kind") == "name") & (F.col("side") == "whole"), 0.0).when(F.col("kind") == "name", 0.1).when(F.col("side") == "core", 0.3)
    cost = F.when(F.col("distance") == 0, equal).otherwise(F.col("distance").cast("double"))
    method = F.when(F.col("distance") > 0, "similar").otherwise(F.col("kind"))
    similar = texts.join(near, "text").join(forms.where("kind <> 'ticker'"), "form").select("raw", "entity", method.alias("method"), cost.alias("cost")).where("cost is not null")

    def by_ticker(column: str, method: str, cost: float) -> DataFrame:
        tickers = forms.where("kind = 'ticker'").select(F.col("form").alias(column), "entity")
        return words.where(F.col(column) != "").select("raw", column).join(tickers, column).select("raw", "entity", F.lit(method).alias("method"), F.lit(cost).alias("cost"))

    # abbreviated words: the first word is equal, the second starts like the listed one and has some of its letters, in order
    pair = r"^([a-z]+) ([a-z]{3,})"
    short = words.select("raw", F.regexp_extract(w, pair, 1).alias("head"), F.regexp_extract(w, pair, 2).alias("short")).where("short <> ''")
    full = listed.select("entity", name_words(plain_text(F.col("name"))).alias("w")).select("entity", F.regexp_extract("w", pair, 1).alias("head"), F.regexp_extract("w", pair, 2).alias("long")).where("long <> ''")
    abbreviated = short.join(full, "head").where((F.length("short") < F.length("long")) & F.rlike("long", F.concat(F.lit("^"), F.regexp_replace("short", "(.)", "$1.*"), F.lit("$"))))
    abbreviated = abbreviated.select("raw", "entity", F.lit("abbreviation").alias("method"), F.lit(0.5).alias("cost"))

    every = reduce(DataFrame.union, [similar, by_ticker("ticker", "ticker", 0.2), by_ticker("noted", "noted ticker", 9.0), abbreviated])
    decided = cut_lineage(_best(every))
    best = decided.where("n = 1").select("raw", "entity", "method", "cost")
    common = every_form.where("n > 1 and kind <> 'ticker'").select(F.col("form").alias("text")).distinct()
    ties = decided.where("n > 1").select("raw").union(texts.join(common, "text", "left_semi").select("raw")).distinct().withColumn("tie", F.lit(True))
    unmatched = words.join(best, "raw", "left_anti").join(ties, "raw", "left")
    method = F.when(F.col("tie"), "tie").otherwise("unmatched")
    return best.union(unmatched.select("raw", F.lit(None).cast("string").alias("entity"), method.alias("method"), F.lit(None).cast("double").alias("cost")))


def plan_entries(plans: DataFrame) -> DataFrame:
    """(plan_id, entry_no, raw): elements of ``companies`` that are neither NULL nor blank; second deliveries count once."""
    rows = plans.select("plan_id", F.posexplode("companies").alias("entry_no", "raw"))
    return rows.where(F.length(F.regexp_replace("raw", SPACE, "")) > 0).distinct()


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    entries = plan_entries(read_table(spark, folder, "research_plans"))
    listed = read_table(spark, folder, "companies").select(F.col("company_id").alias("entity"), "name", "tickers", "aliases")
    return entries.join(match_names(entries, listed), "raw")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The listed company that each free-entered name means, or ``none``."""
    return _matched(spark, folder).select("plan_id", "entry_no", F.coalesce("entity", F.lit("none")).alias("company_id"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that mean no listed company, or that several fit alike (``tie``), with how often they were entered."""
    return _matched(spark, folder).where("entity is null").groupBy("raw", "method").agg(F.count("*").alias("entries"), F.countDistinct("plan_id").alias("plans"))
