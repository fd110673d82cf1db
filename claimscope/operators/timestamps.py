"""Mixed timestamp formats and zones (problem 2): an ordered cascade of anchored, strict patterns.

All of it is column expressions. The text's own zone or offset wins, else the zone looked up for its source, else UTC.

Policies: of a local time that occurs twice the first is meant; one that clocks skip is read with the offset before the
skip (an hour later on the clock); digits finer than microseconds are cut off; impossible dates, hours, offsets and
unknown zones in the text mean no instant; an unknown source zone counts as none. A date alone is its midnight.
Two-digit years, words and anything not matched from end to end mean no instant. Null and blank stay null.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30",
    "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00", "NST": "-03:30", "NDT": "-02:30",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00",
    "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "COT": "-05:00",
}
# English month names.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
_BLANK = " \t\r\n"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"[ ]?(Z|z|[+-]\d{2}(?::?\d{2})?|\[[A-Za-z0-9_+\-/]+\]|[A-Z]{2,5})?"
#: (pattern, the order of year|month|day|hour|minute|second|fraction|half|zone in it); the first that matches is taken.
CASCADE = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{2}})\.(\d{{2}})\.(\d{{4}})(?: {_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK}(?: ?([AaPp])[Mm])?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ?)?(\d{{1,2}}) (" + "|".join(MONTHS) + rf") (\d{{4}}) {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
)
_NUMBER = r"^(\d{1,20})(?:\.(\d{1,9}))?$"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def _micros_of_number(s: Column) -> Column:
    """Bare numbers count from 1970: up to 11 digits seconds, 14 milliseconds, 17 microseconds, else nanoseconds."""
    whole, frac = F.split(s, r"\.")[0], F.rpad(F.coalesce(F.get(F.split(s, r"\."), F.lit(1)), F.lit("")), 9, "0")
    n, digits = whole.try_cast("long"), F.length(whole)
    return (
        F.when(digits <= 11, n * 1_000_000 + F.substring(frac, 1, 6).try_cast("long"))
        .when(digits <= 14, n * 1_000 + F.substring(frac, 1, 3).try_cast("long"))
        .when(digits <= 17, n)
        .otherwise(F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("long"))
    )


def instant_micros(text: Column, source_zone: Column | None = None) -> Column:
    """Microseconds since 1970 UTC of the instant that the text means, or null."""
    s = trimmed(text)
    parts = None
    for pattern, order in CASCADE:
        hit = F.split(F.regexp_replace(s, pattern, order), r"\|", -1)
        parts = F.when(s.rlike(pattern), hit) if parts is None else parts.when(s.rlike(pattern), hit)
    # one pass over the array: the parts are named in a lambda, so they are taken apart once
    zones = F.array(*(F.lit(z) for z in sorted(available_timezones())))
    months = F.array(*(F.lit(m) for m in MONTHS))
    offsets = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    default = source_zone if source_zone is not None else F.lit(None).cast("string")
    default = F.when(F.array_contains(zones, default), default).otherwise(F.lit("UTC"))

    def number(c: Column) -> Column:
        return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))

    def micros(p: Column) -> Column:
        month = F.when(p[1].rlike("^[A-Z]"), F.array_position(months, p[1]).cast("int")).otherwise(number(p[1]))
        year, day, hour, minute, second = (number(p[i]) for i in (0, 2, 3, 4, 5))
        half = F.lower(p[7])
        hour = (
            F.when(half == "", F.when(hour < 24, hour))
            .when(hour.between(1, 12), hour % 12 + F.when(half == "p", F.lit(12)).otherwise(F.lit(0)))
        )
        date = F.to_date(F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)))
        wall = (
            F.unix_date(date).cast("long") * 86_400_000_000
            + (hour * 3600 + F.when(minute < 60, minute) * 60 + F.when(second < 60, second)).cast("long") * 1_000_000
            + F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("long")
        )
        zone = p[8]
        offset = F.when(zone.rlike(r"^[+-]\d"), F.rpad(F.replace(zone, F.lit(":"), F.lit("")), 5, "0")).otherwise(
            F.replace(F.get(F.array(offsets[F.upper(zone)]), F.lit(0)), F.lit(":"), F.lit(""))
        )
        oh, om = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 4, 2).try_cast("int")
        shift = F.when((oh <= 18) & (om < 60), (oh * 3600 + om * 60) * F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1)))
        named = F.regexp_replace(zone, r"^\[|\]$", "")
        local = F.when(zone == "", default).when(zone.startswith("[") & F.array_contains(zones, named), named)
        return F.when((zone == "") | zone.startswith("["), _micros_in(wall, local)).otherwise(wall - shift.cast("long") * 1_000_000)

    matched = F.get(F.transform(F.array(parts), micros), F.lit(0))
    return F.when(s.rlike(_NUMBER), _micros_of_number(s)).when(parts.isNotNull(), matched)


def _micros_in(wall: Column, zone: Column) -> Column:
    """The instant of a wall-clock time in a zone; to_utc_timestamp takes the first of two and skips forward over a gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def normalised(rows: DataFrame, text: str, zone: str | None = None, to: str = "time_us") -> DataFrame:
    """The rows with the instant of a text column, in microseconds since 1970 UTC or null."""
    return rows.withColumn(to, instant_micros(F.col(text), F.col(zone) if zone else None))


def rewritten(posts: DataFrame, claims: DataFrame, actors: DataFrame) -> DataFrame:
    """(record_table, record_key, time_us): fields that mean an instant but aren't written in the one exact form."""

    def of(df: DataFrame, name: str, key: str, text: str, zone: str | None = None) -> DataFrame:
        found = normalised(df.where(F.col(text).isNotNull()), text, zone)
        return found.where(F.col("time_us").isNotNull() & ~F.col(text).rlike(EXACT)).select(
            F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_key"), "time_us"
        )

    return (
        of(posts, "posts", "seq", "created_at", "client_zone")
        .unionByName(of(claims, "claim_history", "seq", "created_at"))
        .unionByName(of(actors, "actor_identity", "did", "resolver_last_success_at"))
    )
