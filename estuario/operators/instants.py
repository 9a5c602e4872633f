"""Timestamps in many notations, precisions and zones, brought to one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import salted_join

# Month names as written in the notations below (first three letters, Portuguese and English).
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "BRT": -180, "BRST": -120, "ART": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

#: The zone intervals cover these years; a wall time outside them is converted by the session's own zone rules.
YEARS = (1970, 2100)

# Each notation is rewritten to "year,month,day,hour,minute,second,fraction,half day,zone"; what is missing stays empty.
_ZONE = r"(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\[[^\]]*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp][Mm]))?"
NOTATIONS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}\s*{_ZONE}$", "$1,$2,$3,$4,$5,$6,$7,$8,$9"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?$", "$1,$2,$3,$4,$5,$6,,,$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+(?:às\s+)?{_CLOCK}\s*{_ZONE}$", "$3,$2,$1,$4,$5,$6,$7,$8,$9"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}})\s+(?:às\s+)?{_CLOCK}\s*{_ZONE}$", "20$3,$2,$1,$4,$5,$6,$7,$8,$9"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(?:às\s+)?(\d{1,2})h(\d{2})$", "$3,$2,$1,$4,$5,,,,"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})\s+(?:às\s+)?(\d{1,2})h(\d{2})$", "20$3,$2,$1,$4,$5,,,,"),
    (rf"^\p{{L}}{{3,9}}\s+(\p{{L}}{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s*{_ZONE}\s+(\d{{4}})$", "$9,$1,$2,$3,$4,$5,$6,$7,$8"),
    (rf"^(?:\p{{L}}{{3,9}},\s*)?(\d{{1,2}})\s+(\p{{L}}{{3}})\p{{L}}*\s+(\d{{4}})\s+{_CLOCK}\s*{_ZONE}$", "$3,$2,$1,$4,$5,$6,$7,$8,$9"),
    (rf"^(\p{{L}}{{3}})\p{{L}}*\s+(\d{{1,2}}),\s*(\d{{4}}),?\s+{_CLOCK}\s*{_ZONE}$", "$3,$1,$2,$4,$5,$6,$7,$8,$9"),
    (rf"^(\d{{1,2}})\s+de\s+(\p{{L}}{{3}})\p{{L}}*\s+de\s+(\d{{4}}),?\s+(?:às\s+)?{_CLOCK}\s*{_ZONE}$", "$3,$2,$1,$4,$5,$6,$7,$8,$9"),
]
_DONE = r"^\d{4},[\p{L}\d]{1,3},\d{1,2},\d{1,2},\d{2},(\d{2})?,\d{0,9},([AaPp][Mm])?,[^,]*$"


def parsed(df: DataFrame, text: str) -> DataFrame:
    """Adds _parede_us and _deslocamento_us: the wall clock in microseconds since 1970 and the offset the text itself gives.

    The offset is null where the text has none; both are null where the text is no calendar date and time (null, blank, relative,
    a day or hour that does not exist, a zone that is unknown). Epoch seconds, milliseconds and microseconds have offset 0.
    Each step is a column of its own, so that no expression is evaluated twice.
    """
    df = df.withColumn("_s", F.regexp_replace(F.col(text), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    out = F.col("_s")
    for pattern, to in NOTATIONS:
        out = F.regexp_replace(out, pattern, to)
    df = df.withColumn("_o", out).withColumn("_p", F.split(F.when(F.col("_o").rlike(_DONE), F.col("_o")), ","))
    p = lambda i: F.nullif(F.col("_p")[i], F.lit(""))
    table = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    df = df.withColumns({"_mes": F.coalesce(p(1).try_cast("int"), F.try_element_at(table(MONTHS), F.lower(p(1)))), "_h": p(3).try_cast("int"), "_meio": F.lower(p(7)), "_seg": F.coalesce(p(5).try_cast("int"), F.lit(0)), "_z": F.upper(p(8))})
    hour = F.when(F.col("_meio").isNull(), F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_meio") == "pm", 12).otherwise(0))
    whole = F.when(F.col("_seg") < 60, F.try_make_timestamp(p(0).try_cast("int"), F.col("_mes"), p(2).try_cast("int"), hour, p(4).try_cast("int"), F.col("_seg"), F.lit("UTC")))
    shift = lambda g: F.regexp_extract("_z", r"([+-])(\d{1,2}):?(\d{2})?$", g)
    df = df.withColumns({"_w": F.unix_micros(whole) + F.coalesce(F.rpad(F.substring(p(6), 1, 6), 6, "0").try_cast("bigint"), F.lit(0)), "_sinal": shift(1), "_hh": shift(2).try_cast("int"), "_mm": F.coalesce(shift(3).try_cast("int"), F.lit(0))})
    minutes = F.when(F.col("_sinal") != "", F.when(F.col("_sinal") == "-", -1).otherwise(1) * (F.col("_hh") * 60 + F.col("_mm"))).otherwise(F.try_element_at(table(ABBREVIATIONS), F.col("_z")))
    epoch = F.when(F.col("_s").rlike(r"^\d{9,10}$"), F.col("_s").try_cast("bigint") * 1_000_000).when(F.col("_s").rlike(r"^\d{12,13}$"), F.col("_s").try_cast("bigint") * 1000).when(F.col("_s").rlike(r"^\d{15,16}$"), F.col("_s").try_cast("bigint"))
    df = df.withColumns({"_epoca": epoch, "_min": minutes.cast("bigint")})
    known = F.col("_z").isNull() | F.col("_min").isNotNull()
    df = df.withColumns({"_parede_us": F.coalesce(F.col("_epoca"), F.when(known, F.col("_w"))), "_deslocamento_us": F.when(F.col("_epoca").isNotNull(), F.lit(0)).otherwise(F.col("_min") * 60_000_000)})
    return df.drop("_s", "_o", "_p", "_mes", "_h", "_meio", "_seg", "_z", "_w", "_sinal", "_hh", "_mm", "_epoca", "_min")


def zone_intervals(zones: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """The intervals of constant offset of each zone, exploded to the years of the local clock that they touch.

    ``zones`` has the column fuso. Result: fuso, ano, intervalos: array of (de, ate, deslocamento) in microseconds, in order of time;
    de and ate are wall times. The change points are found by halving the step from days to seconds where both ends differ,
    so the result follows the session's own zone rules. Unknown zone names give no rows. There are some 600 zones, so with
    ``years`` the result is bounded by 600 x 130 rows whatever the data hold.
    """
    offset = lambda sec: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(sec), F.col("fuso"))) - sec
    lo, hi = F.unix_seconds(F.lit(f"{years[0]}-01-01 00:00:00+00:00").cast("timestamp")), F.unix_seconds(F.lit(f"{years[1]}-01-01 00:00:00+00:00").cast("timestamp"))
    # region names only, as from_utc_timestamp fails on others; one literal, as hundreds make a plan slow to build
    known = zones.select(F.trim("fuso").alias("fuso")).distinct().where(F.array_contains(F.split(F.lit(" ".join(_zone_names(zones.sparkSession))), " "), F.col("fuso")))
    cells = known.select("fuso", F.explode(F.sequence(lo, hi, F.lit(86400))).alias("t"))
    step = 86400
    for finer in (3600, 60, 1):
        cells = cells.where(offset(F.col("t")) != offset(F.col("t") + step)).select("fuso", F.explode(F.sequence(F.col("t"), F.col("t") + step - finer, F.lit(finer))).alias("t"))
        step = finer
    change = cells.where(offset(F.col("t")) != offset(F.col("t") + 1)).select("fuso", (F.col("t") + 1).alias("t"))
    far = F.lit(10**11)
    points = change.unionByName(known.select("fuso", (-far).alias("t"))).groupBy("fuso").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    at = lambda sec: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.greatest(sec, lo)), F.col("fuso"))) - F.greatest(sec, lo)
    spans = points.select("fuso", F.posexplode("ts").alias("i", "t"), "ts").select(
        "fuso", "t", F.coalesce(F.try_element_at("ts", F.col("i") + 2), far).alias("u"), at(F.col("t")).alias("o")
    )
    local = spans.select("fuso", ((F.col("t") + F.col("o")) * 1_000_000).alias("de"), ((F.col("u") + F.col("o")) * 1_000_000).alias("ate"), (F.col("o") * 1_000_000).alias("deslocamento"))
    # two days of margin, so that the interval before a gap is at hand on New Year's Day too
    year = lambda us, d: F.year(F.timestamp_micros(F.least(F.greatest(us, lo * 1_000_000), hi * 1_000_000) + d * 86_400_000_000))
    return local.select("*", F.explode(F.sequence(year(F.col("de"), -2), year(F.col("ate"), 2))).alias("ano")).groupBy("fuso", "ano").agg(F.sort_array(F.collect_list(F.struct("de", "ate", "deslocamento"))).alias("intervalos"))


def _zone_names(spark: SparkSession) -> list[str]:
    """The region names known to the session's own zone rules (some 600, a fixed list)."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def to_instants(records: DataFrame, zones: DataFrame, *, text: str = "created_at", key: str = "arquivo_id", years: tuple[int, int] = YEARS) -> DataFrame:
    """Adds instante_us and situacao to each record, in UTC.

    ``zones`` gives one fuso per ``key``. A text with its own offset needs no zone. A wall time without offset is looked up among the
    intervals of its zone (as-of join by zone and year): one interval gives the offset; two are ``ambigua`` and the
    earlier instant is taken; none is ``inexistente`` and the wall time moves forward by the length of the gap, that is the offset
    before the gap applies. A wall time outside ``years`` is fora_da_tabela: there the session's zone rules convert it one by one, which gives the same
    instants without a table of intervals. ``situacao``: explicita, unica, ambigua, inexistente, fora_da_tabela, sem_fuso (no zone known: UTC is not guessed, the instant
    stays null) or ilegivel (null, blank, relative or impossible text; null instant). All records are kept, repeated ones too, with
    their other columns; fuso, instante_us and situacao are replaced.
    """
    zone_of = zones.select(F.col(key), F.trim("fuso").alias("fuso"))
    spread = F.xxhash64(F.col(text), *([F.col("linha")] if "linha" in records.columns else []))
    r = parsed(records.drop("fuso"), text)
    # hot keys are counted on the stored key alone
    j = salted_join(r, zone_of, key, spread=spread, hot_from=records.select(key), right_aggs=[F.min("fuso").alias("fuso")])
    j = j.withColumn("_ano", F.year(F.timestamp_micros(F.greatest(F.least("_parede_us", F.lit((years[1] - 1970) * 31_556_952_000_000 - 86_400_000_000)), F.lit((years[0] - 1970) * 31_556_952_000_000)))))
    j = j.join(F.broadcast(zone_intervals(zones, years).withColumnsRenamed({"ano": "_ano", "intervalos": "_intervalos"})), ["fuso", "_ano"], "left")
    wall = F.col("_parede_us")
    holds = F.filter("_intervalos", lambda i: (i["de"] <= wall) & (wall < i["ate"]))
    before = F.filter("_intervalos", lambda i: i["ate"] <= wall)
    pick = F.when(F.size(holds) > 0, holds[0]["deslocamento"]).when(F.size(before) > 0, F.try_element_at(before, F.lit(-1))["deslocamento"])
    own = F.col("_deslocamento_us")
    outside = (wall < F.lit((years[0] - 1970) * 31_556_952_000_000 + 86_400_000_000 * 2)) | (wall >= F.lit((years[1] - 1970) * 31_556_952_000_000 - 86_400_000_000 * 2))
    far = F.when(F.col("_intervalos").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.col("fuso"))))
    return j.withColumns(
        {
            # a conditional, so that a filter on the result isn't pushed below the join, where it would parse each text twice
            "instante_us": F.when(wall.isNotNull(), F.when(own.isNull() & outside, far).otherwise(wall - F.coalesce(own, pick))),
            "situacao": F.when(wall.isNull(), "ilegivel").when(own.isNotNull(), "explicita").when(F.col("_intervalos").isNull(), "sem_fuso").when(outside, "fora_da_tabela").when(F.size(holds) == 0, "inexistente").when(F.size(holds) > 1, "ambigua").otherwise("unica"),
        }
    ).drop("_parede_us", "_deslocamento_us", "_ano", "_intervalos")
