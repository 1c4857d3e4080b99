"""Problem 7: texts of many date forms to one UTC instant.

Each text is rewritten by the first date form that fits it to its parts; parts with an offset or zone letters give
the instant at once.  Wall times are joined to the zone-offset intervals of their zone, exploded by local year
(an as-of join turned into an equi-join with a small table): two matching intervals mean that the time occurs
twice, none that it was skipped, one gives the offset directly.

All of it is JVM-side: two scans, no shuffle but that of ``sources``, and one broadcast join with the interval table,
whose size is bounded by the tz database.  Texts, comments and fractions may have any length, years are 1 to 9999.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.zones import ZONE_LETTERS, ZONE_LETTERS_BY_COUNTRY, like_years, zone_names, zone_table
from ..session import table

#: Names of months (fixed values), by language; abbreviations are found by their first letters.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "hu": "január február március április május június július augusztus szeptember október november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pl2": "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień",
    "et": "jaanuar veebruar märts aprill mai juuni juuli august september oktoober november detsember",
    "bg": "януари февруари март април май юни юли август септември октомври ноември декември",
    "el": "ιανουαρίου φεβρουαρίου μαρτίου απριλίου μαΐου ιουνίου ιουλίου αυγούστου σεπτεμβρίου οκτωβρίου νοεμβρίου δεκεμβρίου",
    "el2": "ιανουάριος φεβρουάριος μάρτιος απρίλιος μάιος ιούνιος ιούλιος αύγουστος σεπτέμβριος οκτώβριος νοέμβριος δεκέμβριος",
}
#: Abbreviations that aren't the first three letters of a name, or that two months of a language share (fixed values).
MONTH_SHORT = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12, "janv": 1, "févr": 2, "fév": 2, "avr": 4, "juin": 6, "juil": 7, "août": 8, "déc": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12, "fev": 2, "set": 9, "out": 10, "febr": 2, "márc": 3, "ápr": 4, "máj": 5, "jún": 6, "júl": 7,
    "szept": 9, "sty": 1, "lut": 2, "kwi": 4, "maj": 5, "cze": 6, "lip": 7, "sie": 8, "wrz": 9, "paź": 10, "lis": 11, "gru": 12,
    "jaan": 1, "veebr": 2, "juuni": 6, "juuli": 7, "dets": 12,
}

_TIME = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?([A-Za-z]{1,5}|(?:GMT|UTC|UT|Z)? ?[+-]\d{1,2}(?::?\d{2})?))?(?:\[([A-Za-z_]+(?:/[A-Za-z_+-]+)*)\]| \([^()]*\))?"
_DAY = r"(?:\p{L}{2,14}\.?,? )?"
_NAME = r"(\p{L}{3,14})\.?"
_CLOCK = rf"(?:(?:,| |T| à | at | um | às | a las )*{_TIME}(?: ?Uhr| ?h)?{_AMPM}{_ZONE})?"
#: Date forms, the first that fits counts: (which numbers they begin with, pattern, parts).  The parts are
#: year|month|day|order|hour|minute|second|fraction|half|zone|region, month a number, a name or a day of the year (@).
_FORMS = [
    (r"\d{4}[-/.]", rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})\.?{_CLOCK}", "$1|$3|$4||$5|$6|$7|$8|$9|$10|$11"),
    (r"\d{4}-\d{3}(?!\d)", rf"(\d{{4}})-(\d{{3}}){_CLOCK}", "$1|@|$2||$3|$4|$5|$6|$7|$8|$9"),
    (r"\d{8}", rf"(\d{{4}})(\d\d)(\d\d)(?:T?(\d\d)(\d\d)(?:(\d\d)(?:[.,](\d+))?)?)?{_ZONE}", "$1|$2|$3||$4|$5|$6|$7||$8|$9"),
    (r"\d{4}\D", rf"(\d{{4}})(?:\.|年)? ?(?:{_NAME}|(\d{{1,2}})月) ?(\d{{1,2}})[.日]?{_CLOCK}", "$1|$2$3|$4||$5|$6|$7|$8|$9|$10|$11"),
    (r"\d{4}年", r"(\d{4})年(\d{1,2})月(\d{1,2})日(?: ?(\d{1,2})時(?:(\d{1,2})分)?)?", "$1|$2|$3||$4|$5|||||"),
    (r"\d{1,2}[-/.]\d{1,2}[-/.]", rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_CLOCK}", "$4|$3|$1|n|$5|$6|$7|$8|$9|$10|$11"),
    (r"\p{L}+,? (?:\p{L}+ )?\d|\d{1,2}\.? ?\p{L}", rf"{_DAY}(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -](?:de )?{_NAME}[ -](?:de )?(\d{{4}}|\d{{2}}){_CLOCK}", "$3|$2|$1||$4|$5|$6|$7|$8|$9|$10"),
    (r"\p{L}", rf"{_DAY}{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_CLOCK}", "$3|$1|$2||$4|$5|$6|$7|$8|$9|$10"),
]


def month_numbers() -> dict[str, int]:
    out = dict(MONTH_SHORT)
    for names in MONTH_NAMES.values():
        out |= {n: i for i, n in enumerate(names.split(), 1)}
    return out


def tidy(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+", " "))


def date_parts(text: Column) -> Column:
    """The parts of a date text, in the form of _FORMS, or null."""
    out = F.lit(None).cast("string")
    for first, pattern, parts in reversed(_FORMS):
        full = f"^(?:{pattern})$"
        out = F.when(text.rlike(f"^(?:{first})") & text.rlike(full), F.regexp_replace(text, full, parts)).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _letters_table(spark: SparkSession) -> DataFrame:
    """Zone letters with their usual minutes and those of the countries that mean others by them; about 50 rows."""
    by: dict[str, dict[str, int]] = {z: {} for z in ZONE_LETTERS}
    for (z, land), minutes in ZONE_LETTERS_BY_COUNTRY.items():
        by.setdefault(z, {})[land] = minutes
    return spark.createDataFrame([(z, ZONE_LETTERS.get(z), lands) for z, lands in by.items()], "__tl string, __tlm int, __tlc map<string,int>")


def to_instants(df: DataFrame, value: str, zone: str, country: str, order: str) -> DataFrame:
    """``df`` with ``utc_ms``: the instant that ``value`` denotes, or null.

    ``value`` text; ``zone`` tz name, ``country`` and ``order`` (DMY, MDY, YMD) of the row's source.  Null, blank,
    relative and impossible values give null; so does a wall time without a known zone.  Other columns stay as
    they are, whatever their names: the working columns begin with ``__t``.
    """
    spark, given = df.sparkSession, df.columns
    # The tz names that occur, in the source table or behind a value in brackets; of these only the real ones (the
    # database has about 600) go to the driver.
    named = df.select(F.explode(F.array(F.col(zone), F.regexp_extract(value, r"\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\]", 1))).alias("zone")).where("zone <> ''")
    named = named.join(F.broadcast(zone_names(spark)), "zone", "left_semi").distinct()
    zones = zone_table(spark, [r[0] for r in named.collect()]).withColumnsRenamed({"zone": "__tz", "local_year": "__tl_y", "spans": "__tx"})
    months = spark.createDataFrame([(k, v) for k, v in month_numbers().items()], "__tn string, __tm int")

    df = df.withColumn("__ts", tidy(F.col(value)))
    s = F.col("__ts")
    epoch = (
        F.when(s.rlike(r"^-?\d{9,10}$"), s.try_cast("bigint") * 1000)
        .when(s.rlike(r"^-?\d{9,10}\.\d+$"), F.floor(s.try_cast("decimal(30,9)") * 1000).cast("bigint"))
        .when(s.rlike(r"^\d{12,13}$"), s.try_cast("bigint"))
        .when(s.rlike(r"^\d{16}$"), F.floor(s.try_cast("bigint") / 1000).cast("bigint"))
    )
    df = df.withColumn("__te", epoch).withColumn("__tp", F.when(F.col("__te").isNull(), F.split(date_parts(s), r"\|")))
    names = ["__p_y", "__p_m", "__p_d", "__p_o", "__p_h", "__p_mi", "__p_s", "__p_f", "__p_half", "__p_z", "__p_region"]
    df = df.withColumns({n: F.nullif(F.get(F.col("__tp"), F.lit(i)), F.lit("")) for i, n in enumerate(names)})
    df = df.withColumns({
        "__tn": F.lower(F.regexp_replace("__p_m", r"\.$", "")),
        "__p_z": F.regexp_replace(F.upper("__p_z"), " ", ""),
        "__p_dig": F.regexp_extract(F.regexp_replace(F.upper("__p_z"), "[ :]", ""), r"([+-]\d{1,4})$", 1),
        "__p_h": _int(F.col("__p_h")), "__p_mi": F.coalesce(_int(F.col("__p_mi")), F.lit(0)), "__p_s": F.coalesce(_int(F.col("__p_s")), F.lit(0)),
        "__p_f": F.coalesce(_int(F.substring(F.rpad("__p_f", 3, "0"), 1, 3)), F.lit(0)),
        "__p_a": _int(F.col("__p_d")), "__p_b": _int(F.col("__p_m")), "__p_c": _int(F.col("__p_y")),
        "__p_short": F.length("__p_y") <= 2,
    })
    df = df.join(F.broadcast(months), "__tn", "left").withColumn("__tl", F.col("__p_z")).join(F.broadcast(_letters_table(spark)), "__tl", "left")
    c = F.col
    numeric, mdy, ymd = c("__p_o") == "n", c(order) == "MDY", (c("__p_o") == "n") & (c(order) == "YMD") & c("__p_short")
    y2 = F.when(c("__p_short"), c("__p_c") + 2000).otherwise(c("__p_c"))
    offset = F.when(c("__p_dig") != "", F.when(F.length("__p_dig") <= 3, _int(c("__p_dig")) * 60).otherwise(
        (_int(F.expr("substring(__p_dig, 2, length(__p_dig) - 3)")) * 60 + _int(F.expr("right(__p_dig, 2)"))) * F.when(c("__p_dig").startswith("-"), -1).otherwise(1)))
    offset = F.coalesce(offset, F.try_element_at(c("__tlc"), F.coalesce(c(country), F.lit(""))), c("__tlm"))
    hour = F.when(c("__p_half").isNull(), F.when(F.coalesce(c("__p_h"), F.lit(0)) <= 23, F.coalesce(c("__p_h"), F.lit(0)))).when(
        c("__p_h").between(1, 12), c("__p_h") % 12 + F.when(F.lower("__p_half") == "p", 12).otherwise(0)
    )
    df = df.withColumns({
        "__ty": F.when(ymd, c("__p_a") + 2000).otherwise(y2),
        "__tmo": F.when(c("__p_m") == "@", 1).when(numeric & mdy, c("__p_a")).otherwise(F.coalesce(c("__p_b"), c("__tm"))),
        "__td": F.when(ymd, c("__p_c")).when(numeric & mdy, c("__p_b")).otherwise(c("__p_a")),
        "__th": hour,
        "__to": F.when(offset.between(-960, 960), offset),
        "__tz": F.when(c("__p_z").isNull(), F.coalesce("__p_region", zone)),
    })
    df = df.withColumn("__tf", F.when(c("__tmo").between(1, 12) & c("__ty").between(1, 9999), F.make_date("__ty", "__tmo", F.lit(1))))
    last = F.when(c("__p_m") == "@", F.datediff(F.add_months("__tf", 12), "__tf")).otherwise(F.dayofmonth(F.last_day("__tf")))
    good = (c("__td") >= 1) & (c("__td") <= last) & c("__th").isNotNull() & (c("__p_mi") <= 59) & (c("__p_s") <= 59)
    wall = (F.unix_date("__tf") + c("__td") - 1).cast("bigint") * 86_400 + c("__th") * 3600 + c("__p_mi") * 60 + c("__p_s")
    # Years outside those of the intervals follow the year that stands for them.
    same_year, moved = like_years(c("__ty"))
    df = df.withColumn("__tw", F.when(good, wall)).withColumns({"__tl_y": same_year, "__tlw": c("__tw") - moved}).join(F.broadcast(zones), ["__tz", "__tl_y"], "left")
    hit = F.filter("__tx", lambda x: (x.local_from <= c("__tlw")) & (c("__tlw") < x.local_to))
    before = F.filter("__tx", lambda x: x.local_to <= c("__tlw"))
    local = F.coalesce(F.get(hit, F.lit(0)).offset, F.when(F.size(before) >= 1, F.get(before, F.size(before) - 1).offset))
    known = F.when(c("__p_z").isNotNull(), c("__to") * 60).otherwise(local)
    return df.withColumn("utc_ms", F.coalesce("__te", (c("__tw") - known) * 1000 + c("__p_f"))).select(*[F.col(f"`{g}`") for g in given], "utc_ms")


def instants(items: DataFrame, extractions: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_type, record_id, utc_ms) of every pub_date and published_at that denotes an instant.

    Null, blank and wrong values and empty tables give no row; repeated rows are kept; columns beside those used are
    ignored.  A row whose source is unknown has no zone: only values with an offset or zone letters count.
    """
    both = items.select(F.lit("feed_item").alias("record_type"), F.col("item_id").alias("record_id"), "source_id", F.col("pub_date").alias("value")).unionByName(
        extractions.select(F.lit("extraction").alias("record_type"), F.col("extraction_id").alias("record_id"), "source_id", F.col("published_at").alias("value"))
    )
    # One row a source, of four short columns; the table holds tens of rows at every scale.
    about = sources.groupBy("source_id").agg(*(F.min(c).alias(c) for c in ("time_zone", "country_code", "date_order")))
    df = both.where(F.col("value").isNotNull()).join(about, "source_id", "left")
    return to_instants(df, "value", "time_zone", "country_code", "date_order").where("utc_ms is not null").select("record_type", "record_id", "utc_ms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(table(spark, sf_dir, "feed_items"), table(spark, sf_dir, "article_extractions"), table(spark, sf_dir, "sources"))
