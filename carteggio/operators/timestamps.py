"""Mixed timestamp texts -> one UTC instant.

Parsing, calendar checks and zone arithmetic are built-in expressions only, so
the whole operator stays in generated code: one anchored regular expression per
family of forms rewrites a text to ``tag~y~m~d~h~mi~s~fraction~am/pm~rest``.

Texts without any zone get the zone of their source. Where a source declares none, its offset history is estimated
from its own rows alone: local times are counted by how far they lie from their ingestion, per half month; the rows of
such sources that state an offset tell how long ingestion usually takes. A zone costs little where it puts the local
times at usual distances and much for every instant after its ingestion; the cheapest history over all zones the JVM
knows, with a price on each change of zone, is found by dynamic programming over the half months of a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations by language, zone abbreviations.
MONTHS = {
    1: "january jan gennaio gen januar jän jänner janvier janv enero ene",
    2: "february feb febbraio februar février févr fevrier fév febrero",
    3: "march mar marzo märz mrz maerz mars",
    4: "april apr aprile avril avr abril abr",
    5: "may maggio mag mai mayo",
    6: "june jun giugno giu juni juin junio",
    7: "july jul luglio lug juli juillet juil julio",
    8: "august aug agosto ago août aout",
    9: "september sep sept settembre set septembre septiembre",
    10: "october oct ottobre ott oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dicembre dic dezember dez décembre déc decembre diciembre",
}
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "art": -180,
}
_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_AT = r"(?:(?:ore|alle|um|at|à|a las|las)\s+)?"
_DAY = r"(?:\p{L}+\.?,?\s+)?"
_FORMS = (
    # ISO, extended; ISO, basic; day month-name year; month-name day year; month-name day clock year; numeric
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}{_HALF}(.*)$", "i~$1~$2~$3~$4~$5~$6~$7~$8~$9"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(.*)$", "i~$1~$2~$3~$4~$5~$6~$7~~$8"),
    (rf"^{_DAY}(\d{{1,2}})[.º]?\s+(?:de\s+)?(\p{{L}}+)\.?,?\s+(?:de\s+)?(\d{{4}}),?\s+{_AT}{_CLOCK}{_HALF}(.*)$", "i~$3~$2~$1~$4~$5~$6~$7~$8~$9"),
    (rf"^{_DAY}(\p{{L}}+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_AT}{_CLOCK}{_HALF}(.*)$", "i~$3~$1~$2~$4~$5~$6~$7~$8~$9"),
    (rf"^{_DAY}(\p{{L}}+)\.?\s+(\d{{1,2}})\s+{_CLOCK}(?:\s+([A-Za-z]{{1,5}}))?\s+(\d{{4}})$", "i~$8~$1~$2~$3~$4~$5~$6~~$7"),
    (rf"^{_DAY}(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}|\d{{2}}),?\s+{_AT}{_CLOCK}{_HALF}(.*)$", "n~$3~$2~$1~$4~$5~$6~$7~$8~$9"),
)
_ZONE = (
    r"^\s*(?:(?:GMT|UTC|gmt|utc)?\s*([+\-−])(\d{2}):?(\d{2})?|(?:GMT|UTC)([+\-])(\d)|([A-Za-z]{1,5})|\[?([A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)\]?|\(([A-Za-z]{1,5})\))"
    r"\s*(?:\[[^\]]*\])?\s*(?:\([^)]*\))?\s*$"
)
_DAY_US = 86_400_000_000
_STEP_US = 900_000_000
#: Distances of local time from ingestion that are told apart, in quarters of an hour; ends of the classes of delay, in
#: quarters of an hour; price of an instant after its ingestion and of a change of zone.
_NEAR, _FAR, _DELAYS, _LATE, _CHANGE = -60, 400, (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 96, 192), 14.0, 12.0


def _staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` plus ``columns``, computed once: the optimiser would otherwise inline each into all of its later uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _month(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for m, ns in MONTHS.items() for n in ns.split() for x in (n, m)])
    return F.when(c.rlike(r"^\d+$"), F.try_to_number(c, F.lit("99")).cast("int")).otherwise(names[F.lower(c)])


def known_zones(df: DataFrame) -> list[str]:
    """Zone names the JVM knows: a fixed list of about 600, not data."""
    return sorted(df.sparkSession._jvm.java.util.ArrayList(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()))


def with_wall_clock(df: DataFrame, text: str) -> DataFrame:
    """Add ``_wall`` (local microseconds), ``_offset`` (minutes) and ``_zone`` (name) read from ``text``.

    All three are null where the text states no full, valid date and time.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), "~", " "), r"[\s\p{Z}]+", " "))
    df = _staged(df, {"_s": s})
    c = F.col("_s")
    for pattern, to in _FORMS:
        c = F.regexp_replace(c, pattern, to)
    df = _staged(df, {"_c": F.split(c, "~")})
    part = lambda i: F.nullif(F.get("_c", F.lit(i)), F.lit(""))
    num = lambda x: F.expr("null").cast("int") if x is None else x.try_cast("int")
    formed = (F.size("_c") == 10) & F.get("_c", F.lit(0)).isin("i", "n")
    swap = (F.get("_c", F.lit(0)) == "n") & part(8).isNotNull()
    df = _staged(
        df,
        {n: F.when(formed, e) for n, e in {
            "_y": num(part(1)), "_mo": F.when(swap, _month(part(3))).otherwise(_month(part(2))), "_d": num(F.when(swap, part(2)).otherwise(part(3))),
            "_h": num(part(4)), "_mi": num(part(5)), "_se": F.coalesce(num(part(6)), F.lit(0)),
            "_us": F.coalesce(num(F.rpad(F.substring(part(7), 1, 6), 6, "0")), F.lit(0)), "_half": F.lower(part(8)), "_rest": F.coalesce(part(9), F.lit("")),
        }.items()},
    )
    year = F.when(F.col("_year") >= 100, F.col("_year")).when(F.col("_year") < 70, F.col("_year") + 2000).otherwise(F.col("_year") + 1900)
    hour = F.when(F.col("_half").isNull(), F.col("_hour")).when(F.col("_hour").between(1, 12), F.col("_hour") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    df = _staged(df.withColumnsRenamed({"_y": "_year", "_h": "_hour"}), {"_y": year, "_h": hour})
    leap = ((F.col("_y") % 4 == 0) & (F.col("_y") % 100 != 0)) | (F.col("_y") % 400 == 0)
    last = F.when(F.col("_mo").isin(4, 6, 9, 11), 30).when(F.col("_mo") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = F.col("_mo").between(1, 12) & F.col("_d").between(1, last) & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_se").between(0, 59) & F.col("_y").between(1, 9999)
    days = F.datediff(F.when(valid, F.make_date("_y", "_mo", F.lit(1))), F.lit("1970-01-01").cast("date")) + F.col("_d") - 1
    wall = days.cast("long") * _DAY_US + ((F.col("_h") * 60 + F.col("_mi")) * 60 + F.col("_se")).cast("long") * 1_000_000 + F.col("_us")
    zone = F.split(F.regexp_replace("_rest", _ZONE, "z~$1$4~$2$5~$3~$6$8~$7"), "~")
    df = _staged(df, {"_local": F.when(valid, wall), "_z": zone})
    zpart = lambda i: F.when(F.size("_z") == 6, F.nullif(F.get("_z", F.lit(i)), F.lit("")))
    abbreviation = F.create_map(*[F.lit(x) for k, m in ABBREVIATIONS.items() for x in (k, m)])[F.lower(zpart(4))]
    minutes = (num(zpart(2)) * 60 + F.coalesce(num(zpart(3)), F.lit(0))) * F.when(zpart(1) == "+", 1).otherwise(-1)
    number = F.regexp_extract("_s", r"^(\d{9,10}|\d{12,13}|\d{15,16})(?:\.(\d+))?$", 1)
    fraction = F.rpad(F.substring(F.regexp_extract("_s", r"^\d+\.(\d+)$", 1), 1, 6), 6, "0").try_cast("long")
    unit = F.when(F.length(number) <= 10, 1_000_000).when(F.length(number) <= 13, 1000).otherwise(1).cast("long")
    bare = F.when(number != "", number.try_cast("long") * unit + F.floor(F.coalesce(fraction, F.lit(0)) * unit / 1_000_000))
    known = F.col("_rest").rlike(r"^\s*$") | (F.size("_z") == 6)
    df = _staged(df, {
        "_zone": F.when(zpart(5).isin(known_zones(df)), zpart(5)),
        "_offset": F.when(bare.isNotNull(), F.lit(0)).otherwise(F.coalesce(minutes, abbreviation)),
        "_wall": F.coalesce(bare, F.when(known & (F.coalesce(minutes, F.lit(0)).between(-1080, 1080)), F.col("_local"))),
    })
    return df.drop("_c", "_s", "_year", "_hour", "_local", "_y", "_mo", "_d", "_h", "_mi", "_se", "_us", "_half", "_rest", "_z")


def to_instant(wall: Column, offset: Column, zone: Column) -> Column:
    """UTC microseconds. Overlaps take the earlier instant, gaps the offset before the change."""
    return F.when(offset.isNotNull(), wall - offset.cast("long") * 60_000_000).when(zone.isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone)))


def declared_zones(sources: DataFrame) -> DataFrame:
    """(source, zone) of the sources that declare a zone the JVM knows."""
    valid = sources.where(F.col("zone_name").isin(known_zones(sources)) & F.col("source").isNotNull())
    return valid.groupBy("source").agg(F.min("zone_name").alias("zone"))


def half_month(wall: Column) -> Column:
    """Number of the half month of a local time."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(wall / _DAY_US).cast("int"))
    return (F.year(day) * 24 + (F.month(day) - 1) * 2 + (F.day(day) > 15).cast("int")).cast("int")


@lru_cache(maxsize=4)
def offset_histories(zones: tuple[str, ...], first: int, last: int) -> tuple[list[str], np.ndarray]:
    """Zones that differ somewhere in these half months, and their offsets in quarters of an hour (zones x half months)."""
    from zoneinfo import ZoneInfo

    at = [datetime(n // 24, n % 24 // 2 + 1, 23 if n % 2 else 8, 12, tzinfo=UTC) for n in range(first, last + 1)]
    names, rows, seen = [], [], set()
    for z in zones:
        try:
            zone = ZoneInfo(z)
        except (KeyError, ValueError, OSError):
            continue
        row = tuple(round(t.astimezone(zone).utcoffset().total_seconds() / 900) for t in at)
        if row not in seen:
            seen.add(row), names.append(z), rows.append(row)
    return names, np.array(rows, dtype=np.int64).reshape(len(rows), len(at))


def cheapest_history(costs: np.ndarray, change: float = _CHANGE) -> np.ndarray:
    """For each row (half month) of ``costs`` the column (zone) of the cheapest path, where a change has its price."""
    best, back = costs[0].copy(), []
    for c in costs[1:]:
        j = int(best.argmin())
        stay = best <= best[j] + change
        back.append(np.where(stay, np.arange(len(best)), j))
        best = np.where(stay, best, best[j] + change) + c
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def zone_histories(parsed: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """(source, period, zone) for the half months in which rows without any zone occur.

    ``parsed`` has ``source``, ``_wall``, ``_offset``, ``_zone`` and ``seen_us`` (ingestion; rows without it tell
    nothing, and a source without any gets no zone). Zones alike over the whole span of the data count as one, the first.
    """
    zones = tuple(candidates or known_zones(parsed))
    clip = lambda us: F.greatest(F.least(F.floor(us / _STEP_US), F.lit(_FAR)), F.lit(_NEAR)).cast("int")
    timed = parsed.where("_wall is not null and seen_us is not null and source is not null")
    stated = timed.where("_offset is not null or _zone is not null").select(clip(F.col("seen_us") - to_instant(F.col("_wall"), F.col("_offset"), F.col("_zone"))).alias("d"))
    usual = {r["d"]: r["n"] for r in stated.groupBy("d").agg(F.count("*").alias("n")).collect()}  # _FAR - _NEAR + 1 rows at most
    edges = np.array([*_DELAYS, _FAR])
    n = np.bincount(np.searchsorted(edges, [d for d in usual if d >= 0], "right") - 1, [usual[d] for d in usual if d >= 0], len(edges)) if usual else np.zeros(len(edges))
    prior = 1 / np.arange(1, len(edges) + 1)
    share = (n + 20 * prior / prior.sum()) / (n.sum() + 20)
    nll = -np.log(share / np.append(np.diff(edges), 400))  # per quarter of an hour; what is far counts as very far

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, last = int(rows["period"].min()), int(rows["period"].max())
        names, offsets = offset_histories(zones, first, last)
        at = rows["period"].to_numpy() - first
        delay = rows["d"].to_numpy()[:, None] + offsets[:, at].T  # rows x zones
        far = (rows["d"].to_numpy() >= _FAR)[:, None]
        cost = np.where(delay < 0, _LATE, nll[np.clip(np.searchsorted(edges, np.maximum(delay, 0), "right") - 1, 0, len(nll) - 1)])
        cost = np.where(far, 0.0, cost) * rows["n"].to_numpy()[:, None]
        there = np.unique(at)
        costs = np.zeros((len(there), len(names)))
        np.add.at(costs, np.searchsorted(there, at), cost)
        path = cheapest_history(costs)
        return pd.DataFrame({"source": key[0], "period": there + first, "zone": [names[i] for i in path]})

    # as many rows as a source has half months and distances, however many messages it has
    loose = timed.where("_offset is null and _zone is null").select("source", half_month(F.col("_wall")).alias("period"), clip(F.col("seen_us") - F.col("_wall")).alias("d"))
    counts = loose.groupBy("source", "period", "d").agg(F.count("*").alias("n"))
    kind = parsed.schema["source"].dataType.simpleString()
    return counts.groupBy("source").applyInPandas(choose, f"source {kind}, period int, zone string")


def normalise(df: DataFrame, sources: DataFrame, text: str = "sent_at", source: str = "source_file_id", seen: str = "imported_at",
              source_key: str = "id", candidates: Sequence[str] | None = None) -> DataFrame:
    """``df`` plus ``sent_us``: null where ``text`` states no full, valid date and time.

    Null, empty and junk texts give null; a text without a zone whose source is null gives null too; rows repeat as
    given. Only sources without a declared zone are read for an estimate (``candidates``: zones to choose from). Columns of
    ``df`` beginning with ``_`` are reserved.
    """
    declared = declared_zones(sources.select(F.col(source_key).alias("source"), "zone_name"))
    parsed = with_wall_clock(df.withColumns({"_source": F.col(source)}), text)
    out = parsed.join(declared.select(F.col("source").alias("_source"), F.col("zone").alias("_file_zone")), "_source", "left")
    open_ = df.join(declared.select(F.col("source").alias(source)), source, "left_anti").where(F.col(source).isNotNull()) if seen in df.columns else df.limit(0)
    if open_.limit(1).count():
        rows = open_.select(F.col(source).alias("source"), F.col(text).alias("_text"), F.unix_micros(F.col(seen).cast("timestamp")).alias("seen_us"))
        history = zone_histories(with_wall_clock(rows, "_text"), candidates).select(F.col("source").alias("_source"), F.col("period").alias("_period"), F.col("zone").alias("_guess"))
        out = out.withColumn("_period", half_month(F.col("_wall"))).join(history, ["_source", "_period"], "left").withColumn("_file_zone", F.coalesce("_file_zone", "_guess")).drop("_period", "_guess")
    return out.withColumn("sent_us", to_instant(F.col("_wall"), F.col("_offset"), F.coalesce("_zone", "_file_zone"))).drop("_source", "_wall", "_offset", "_zone", "_file_zone")
