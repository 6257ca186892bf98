"""Mixed timestamp formats and time zones: one exact UTC instant per raw value.

A value is split into a date, a time and a zone by a few patterns. A numeric date without the
year in front has two readings, day first and month first. Which one a source uses is decided
by expectation maximisation: each source is a mixture of the two formats and of misprints, a value
gives likelihood to each reading under which it is a date (more if the date is not after the moment
the value was seen), and the posterior of a value chooses its reading, or that it has none. A
source's locale is the prior of its mixture, as strong as the caller says: where it is binding
(``BINDING``), values move the mixture by next to nothing, and one that is a date only in the
order the locale rules out is a misprint. Where no interpretation has a posterior of ``certain``, the value is
marked ``ambiguous``.

Values enter the mixtures through counts per (source, likelihood pattern), a handful of rows for
each source, so that no group of values is ever collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import cut_lineage, read_table

# Names and abbreviations of months in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr febrero",
    3: "march mar märz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}

# Usual offsets of zone abbreviations in minutes.
OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "pkt": 300, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "brst": -120, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

# Abbreviations that mean something else in some countries, by the feed's zone.
LOCAL_OFFSETS = {
    ("ist", "Europe/Dublin"): 60,
    ("ist", "Asia/Jerusalem"): 120,
    ("cst", "Asia/Shanghai"): 480,
    ("cst", "Asia/Taipei"): 480,
    ("bst", "Asia/Dhaka"): 360,
    ("ast", "Asia/Riyadh"): 180,
    ("est", "Australia/Sydney"): 600,
    ("est", "Australia/Melbourne"): 600,
    ("est", "Australia/Brisbane"): 600,
    ("edt", "Australia/Sydney"): 660,
    ("edt", "Australia/Melbourne"): 660,
    ("cst", "Australia/Adelaide"): 570,
    ("cdt", "Australia/Adelaide"): 630,
}

# A prior by which the locale decides, however many values a source has.
BINDING = {"prior": 1 - 1e-9, "prior_weight": 1e15}

MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

# Date patterns, and where they have the year, the month, the day (in this order; in the text's order for
# "numeric") and the rest. "#" stands for a month's name.
DATES = (
    ("compact", r"^(\d{4})(\d{2})(\d{2})()$", "$1|$2|$3|$4"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})((?:[.,]\d{1,9})?)( ?(?:z|[+-]\d{2}:?\d{2})|)$", "$1|$2|$3|$4:$5:$6$7$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})( ?(?:z|[+-]\d{2}:?\d{2})|)$", "$1|$2|$3|$4:$5$6"),
    ("year", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)(.*)$", "$1|$3|$4|$5"),
    ("ideographs", r"^(\d{4})年(\d{1,2})月(\d{1,2})日(.*)$", "$1|$2|$3|$4"),
    ("named", r"^(\d{1,2})(?:\.|st|nd|rd|th|er)?[ -](?:de )?#\.?,?[ -](?:del? )?(\d{4}|\d{2})(?!\d)(.*)$", "$2|#|$1|$3"),
    ("named", r"^#\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?!\d)(.*)$", "$2|#|$1|$3"),
    ("numeric", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(.*)$", "$4|$1|$3|$5"),
)
CLOCK = r"^(?:,| ?t| à| um| at| a las| -)? ?(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?(?![\p{L}]))?(?: uhr)?(?: ?(z|[\p{L}]{2,5}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?(?: ?\[[^\]]*\])?$"


def _day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970; NULL for a date that doesn't exist."""
    return F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def _zone_offset(zone: Column, time_zone: Column) -> Column:
    """Minutes of a zone or offset written in a value; NULL if it has no meaning."""
    signed = F.split(F.regexp_replace(zone, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|0$3"), r"\|")
    minutes = F.get(signed, F.lit(1)).try_cast("int") * 60 + F.get(signed, F.lit(2)).try_cast("int")
    table = F.create_map(*(F.lit(x) for pair in OFFSETS.items() for x in pair))
    local = F.create_map(*(F.lit(x) for (name, area), value in LOCAL_OFFSETS.items() for x in (f"{name} {area}", value)))
    named = F.coalesce(local[F.concat_ws(" ", zone, time_zone)], table[zone])
    return F.when(F.size(signed) == 3, F.when(minutes <= 18 * 60, F.when(F.get(signed, F.lit(0)) == "-", -minutes).otherwise(minutes))).otherwise(named)


def read_timestamps(values: DataFrame) -> DataFrame:
    """Adds the readings of ``raw`` to ``values(raw, time_zone, ...)``: ``ts_fixed_us``, ``ts_day_first_us``, ``ts_month_first_us``.

    ``ts_fixed_us`` is the instant of a value that has one reading only; the other two are those
    of a numeric date without the year in front. All are UTC microseconds, NULL where the value
    isn't a possible date and time under that reading. Names that begin with ``ts_`` are taken.
    """
    text = F.lower(F.trim(F.regexp_replace("raw", r"[\s\p{Z}\u200b]+", " ")))
    text = F.regexp_replace(text, r"^\p{L}+\.?, ?", "")
    names = "|".join(sorted(MONTH_OF, key=lambda n: (-len(n), n)))
    month = rf"(?<![\p{{L}}])({names})(?![\p{{L}}])"
    months = F.create_map(*(F.lit(x) for pair in MONTH_OF.items() for x in pair))
    v = values.withColumn("ts_text", text)
    v = v.withColumn("ts_month", months[F.regexp_extract("ts_text", month, 1)])
    v = v.withColumn("ts_text", F.when(F.col("ts_month").isNotNull(), F.regexp_replace("ts_text", month, "#")).otherwise(F.col("ts_text")))
    s = F.col("ts_text")
    # year, two smaller parts of the date in the order of the text, and the rest
    parts = F.when(s.rlike(r"^(\d{10}|\d{13}|\d{16})$"), F.concat(F.lit("epoch|"), s))
    for kind, pattern, order in DATES:
        parts = parts.when(s.rlike(pattern), F.regexp_replace(s, pattern, f"{kind}|{order}"))
    v = v.withColumn("ts_date", F.split(parts, r"\|"))
    part = lambda i: F.get("ts_date", F.lit(i))
    number = part(1).try_cast("long")
    v = v.withColumn("ts_clock", F.split(F.when(part(4) == "", "0|0|0|0||").when(part(4).rlike(CLOCK), F.regexp_replace(part(4), CLOCK, "$1|$2|0$3|$4|$5|$6")), r"\|"))
    clock = lambda i: F.get("ts_clock", F.lit(i))
    hour = clock(0).try_cast("int")
    v = v.select(
        "*",
        part(0).alias("ts_kind"),
        F.when(part(0) == "epoch", number * F.when(F.length(part(1)) == 10, 1_000_000).when(F.length(part(1)) == 13, 1000).otherwise(1).cast("long")).alias("ts_epoch"),
        (F.when(F.length(part(1)) == 2, 2000).otherwise(0) + part(1).try_cast("int")).alias("ts_year"),
        F.when(part(2) == "#", F.col("ts_month")).otherwise(part(2).try_cast("int")).alias("ts_one"),
        part(3).try_cast("int").alias("ts_two"),
        F.when(clock(4) == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(clock(4) == "p", 12).otherwise(0)).alias("ts_hour"),
        F.when(clock(1).try_cast("int") <= 59, clock(1).try_cast("int")).alias("ts_minute"),
        F.when(clock(2).try_cast("int") <= 59, clock(2).try_cast("int")).alias("ts_second"),
        F.rpad(F.substring(clock(3), 1, 6), 6, "0").try_cast("long").alias("ts_us"),
        F.trim(clock(5)).alias("ts_zone"),
    )
    of_day = ((F.col("ts_hour") * 60 + F.col("ts_minute")) * 60 + F.col("ts_second")).cast("long") * 1_000_000 + F.col("ts_us")
    v = v.withColumn("ts_offset", F.when(F.col("ts_zone") != "", _zone_offset(F.col("ts_zone"), F.col("time_zone"))))
    v = v.withColumn("ts_of_day", F.when((F.col("ts_zone") == "") | F.col("ts_offset").isNotNull(), of_day))
    one_two, two_one = _day_number(F.col("ts_year"), F.col("ts_one"), F.col("ts_two")), _day_number(F.col("ts_year"), F.col("ts_two"), F.col("ts_one"))
    v = v.withColumns({"ts_a": one_two.cast("long") * 86_400_000_000 + F.col("ts_of_day"), "ts_b": F.when(F.col("ts_kind") == "numeric", two_one.cast("long") * 86_400_000_000 + F.col("ts_of_day"))})
    zone = F.coalesce("time_zone", F.lit("UTC"))
    v = v.withColumns({f"ts_{x}_there": F.to_utc_timestamp(F.timestamp_micros(f"ts_{x}"), zone) for x in "ab"})
    # of a time that occurred twice Spark gives the earlier instant; a skipped time doesn't come back
    v = v.withColumns({f"ts_{x}_back": F.unix_micros(F.from_utc_timestamp(f"ts_{x}_there", zone)) for x in "ab"})

    def instant(x: str) -> Column:
        local = F.when(F.col("time_zone").isNotNull() & (F.col(f"ts_{x}_back") == F.col(f"ts_{x}")), F.unix_micros(f"ts_{x}_there"))
        return F.when(F.col("ts_offset").isNotNull(), F.col(f"ts_{x}") - F.col("ts_offset").cast("long") * 60_000_000).otherwise(local)

    numeric = F.col("ts_kind") == "numeric"
    return v.select(
        *values.columns,
        F.coalesce("ts_epoch", F.when(~numeric, instant("a"))).alias("ts_fixed_us"),
        F.when(numeric, instant("b")).alias("ts_day_first_us"),
        F.when(numeric, instant("a")).alias("ts_month_first_us"),
    )


def _shares(rows: pd.DataFrame, prior_weight: float, misprints: float, rounds: int) -> float:
    """Share of the day-first format in one source, from rows (ts_like_day, ts_like_month, n, prior)."""
    prior = float(rows["prior"].iloc[0])
    number, share = rows["n"].to_numpy(), prior
    day, month = rows["ts_like_day"].to_numpy(), rows["ts_like_month"].to_numpy()
    for _ in range(rounds):
        of_day, of_month = share * day, (1 - share) * month
        both = of_day + of_month + misprints
        sure, other = (of_day / both * number).sum(), (of_month / both * number).sum()
        new = (sure + prior * prior_weight) / (sure + other + prior_weight)
        if abs(new - share) < 1e-12:
            break
        share = new
    return share


def interpretations(
    values: DataFrame, prior: float = 0.95, prior_weight: float = 4.0, certain: float = 0.95, late: float = 0.02, misprints: float = 0.001, rounds: int = 50
) -> DataFrame:
    """``normalise_timestamps`` with both instants of values that have two readings: ``day_first_us``, ``month_first_us``, and ``p_day_first``, ``p_month_first``."""
    read = read_timestamps(values)

    def likelihood(us: Column) -> Column:
        return F.when(us.isNull(), 0.0).when(us > F.col("seen_us"), late).otherwise(1.0)

    day, month = F.col("ts_day_first_us"), F.col("ts_month_first_us")
    read = cut_lineage(read.withColumn("ts_like_day", likelihood(day)).withColumn("ts_like_month", likelihood(month)))  # parsed once, used twice
    day_prior = F.when(F.col("locale").isNull(), 0.5).when(F.col("locale") == "en-US", 1 - prior).otherwise(prior)
    key = F.coalesce(F.col("source_key").cast("string"), F.lit(""))
    counts = read.where("ts_like_day > 0 or ts_like_month > 0").groupBy(key.alias("ts_mix_key"), "ts_like_day", "ts_like_month").agg(F.count("*").cast("double").alias("n"), F.min(day_prior).alias("prior"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ts_mix_key": [rows["ts_mix_key"].iloc[0]], "day_share": [_shares(rows, prior_weight, misprints, rounds)]})

    shares = counts.groupBy("ts_mix_key").applyInPandas(fit, "ts_mix_key string, day_share double")
    joined = read.withColumn("ts_mix_key", key).join(shares, "ts_mix_key", "left")
    weight_day, weight_month = F.col("day_share") * F.col("ts_like_day"), (1 - F.col("day_share")) * F.col("ts_like_month")
    total = weight_day + weight_month + misprints
    readable = F.col("day_share").isNotNull() & (day.isNotNull() | month.isNotNull())
    joined = joined.withColumn("ts_p_day", F.when(readable, weight_day / total)).withColumn("ts_p_month", F.when(readable, weight_month / total))
    fixed = F.col("ts_fixed_us")
    p_day, p_month = F.col("ts_p_day"), F.col("ts_p_month")
    p_none = 1 - p_day - p_month
    agreed = F.when(day == month, day)
    chosen = F.when(p_day >= certain, day).when(p_month >= certain, month)
    only = F.when(day.isNull() | month.isNull(), chosen)
    sure = F.coalesce(fixed, F.when(p_none < certain, agreed), only)
    open_ = readable & (F.greatest(p_day, p_month, p_none) < certain)
    return joined.select(
        *(c for c in values.columns if c not in ("published_us", "posterior", "state", "day_first_us", "month_first_us", "p_day_first", "p_month_first")),
        F.coalesce(sure, chosen).alias("published_us"),
        F.when(sure.isNotNull(), 1.0).otherwise(F.greatest(p_day, p_month, p_none)).alias("posterior"),
        F.when(sure.isNotNull(), "exact").when(chosen.isNotNull(), "chosen").when(open_, "ambiguous").otherwise("unusable").alias("state"),
        day.alias("day_first_us"),
        month.alias("month_first_us"),
        p_day.alias("p_day_first"),
        p_month.alias("p_month_first"),
    )


def normalise_timestamps(values: DataFrame, prior: float = 0.95, prior_weight: float = 4.0, certain: float = 0.95, late: float = 0.02, misprints: float = 0.001, rounds: int = 50) -> DataFrame:
    """Adds ``published_us``, ``posterior`` and ``state`` to ``values(source_key, raw, time_zone, locale, seen_us, ...)``.

    ``state`` is ``exact`` (one reading, or two that agree), ``chosen`` (the posterior of a reading
    is at least ``certain``), ``ambiguous`` (that of none is; no instant) or ``unusable``: NULL, blank, no full
    date, impossible, skipped by the clocks, or a misprint by its posterior. ``prior`` is the share that the format of
    the source's locale has before any value is seen (NULL locale: both alike), ``prior_weight``
    how many values that counts as; ``**BINDING`` makes the locale rule. ``late`` is the
    likelihood of a reading after ``seen_us`` (NULL: any time is as likely), against 1 otherwise, and ``misprints`` the weight
    of there being no reading.
    Rows are kept one for one, repeated ones too, with
    their other columns (one named like a result is replaced); an empty table gives an empty result.
    """
    read = interpretations(values, prior, prior_weight, certain, late, misprints, rounds)
    kept = [c for c in values.columns if c not in ("published_us", "posterior", "state")]
    return read.select(*kept, "published_us", "posterior", "state")


def published_values(spark: SparkSession, folder: str) -> DataFrame:
    """The raw publication times of documents and document_refs, with their feed's zone and locale."""
    feeds = read_table(spark, folder, "feeds").select("feed_id", "time_zone", "locale")
    documents = read_table(spark, folder, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "feed_id", F.col("published_at").alias("raw"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("seen_us"))
    refs = read_table(spark, folder, "document_refs").select(F.lit("document_refs").alias("src_table"), F.col("ref_id").alias("row_id"), "feed_id", F.col("published_at").alias("raw"), F.unix_micros(F.col("discovered_at").cast("timestamp")).alias("seen_us"))
    return documents.union(refs).join(feeds, "feed_id", "left").withColumn("source_key", F.col("feed_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One exact instant for every usable value; the locale, as a binding prior, decides the order of day and month."""
    normal = normalise_timestamps(published_values(spark, folder), **BINDING)
    return normal.where("published_us is not null").select("src_table", "row_id", "published_us")


def p3_states(spark: SparkSession, folder: str) -> DataFrame:
    """Values per table and state when the formats are learned from the values, the locale being a mere prior."""
    return normalise_timestamps(published_values(spark, folder)).groupBy("src_table", "state").agg(F.count("*").alias("n"), F.count("published_us").alias("instants"))


def p3_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Values whose reading the formats of their feed leave open, with both instants and their posteriors."""
    read = interpretations(published_values(spark, folder)).where("state = 'ambiguous'")
    return read.select("src_table", "row_id", "feed_id", "raw", "day_first_us", "month_first_us", F.round("p_day_first", 6).alias("p_day_first"), F.round("p_month_first", 6).alias("p_month_first"))
