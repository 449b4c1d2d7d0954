"""Mixed timestamp formats and time zones to one instant in UTC.

An ordered cascade of anchored patterns rewrites every value into one canonical
text (``kind|year|month|day|hour|minute|second|fraction|am/pm|zone``); the first
pattern that matches decides. Fields are then checked strictly, and a value
without a zone is read on the clock of its source. Everything is a built-in
expression: no Python runs per row, and the only join is with the lookup of
sources, which the planner broadcasts when its size allows.

Defined results: null, blank, unreadable or impossible values, months or years
alone, values without zone whose source is null or unknown, numeric dates whose
order the source does not fix, and local times that the clock shows twice or
never (unless the policy says otherwise) give null and a ``status``. Zone abbreviations with
several readings have one here: ``bst`` is British summer time, ``ist`` India's,
``cst`` and ``mst`` those of North America. The status
is one of ok, empty, unreadable, impossible, no_zone, ambiguous, nonexistent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Month names and their abbreviations in en, de, fr, es (lower case).
MONTHS = [
    ["january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene"],
    ["february", "feb", "februar", "février", "fevrier", "févr", "febrero"],
    ["march", "mar", "märz", "maerz", "mär", "mars", "marzo"],
    ["april", "apr", "avril", "avr", "abril", "abr"],
    ["may", "mai", "mayo"],
    ["june", "jun", "juni", "juin", "junio"],
    ["july", "jul", "juli", "juillet", "juil", "julio"],
    ["august", "aug", "août", "aout", "agosto", "ago"],
    ["september", "sep", "sept", "septembre", "septiembre", "setiembre"],
    ["october", "oct", "oktober", "okt", "octobre", "octubre"],
    ["november", "nov", "novembre", "noviembre"],
    ["december", "dec", "dezember", "dez", "décembre", "decembre", "déc", "diciembre", "dic"],
]

# Zone abbreviations and their offset from UTC in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0,
    "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "awst": 480, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_OFFSET = r"[+-]\d{2}:?\d{2}"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"

#: (name, anchored pattern, canonical text). Order matters: the first match decides.
CASCADE: list[tuple[str, str, str]] = [
    ("epoch_s", r"^(\d{10})(?:\.(\d{1,6})\d*)?$", "E|$1|||||||$2|||"),
    ("epoch_ms", r"^(\d{13})$", "M|$1||||||||||"),
    ("epoch_us", r"^(\d{16})$", "U|$1||||||||||"),
    (
        "iso",
        rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}})\d*)?)? ?({_OFFSET}|[+-]\d{{2}}|[A-Za-z]{{1,4}})?(?:\[[A-Za-z0-9_/+-]+\])?$",
        "D|$1|$2|$3|$4|$5|$6|$7||$8|",
    ),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?({_OFFSET}|[Zz])?$", "D|$1|$2|$3|$4|$5|$6|||$7|"),
    ("day_named", r"^(\d{4})/(\d{2})/(\d{2}) \(([A-Za-z]{3})\) (\d{2}):(\d{2})$", "D|$1|$2|$3|$5|$6|||||$4"),
    ("ymd", rf"^(\d{{4}})([-./])(\d{{1,2}})\2(\d{{1,2}})(?:[ T]{_TIME})?$", "D|$1|$3|$4|$5|$6|$7||||"),
    ("numeric", rf"^(\d{{1,2}})([-./])(\d{{1,2}})\2(\d{{4}})(?:,? {_TIME})?(?: ?([AaPp])\.?[Mm]\.?)?$", "N|$4|$1|$3|$5|$6|$7||$8||"),
    (
        "mail",
        rf"^(?:([A-Za-z]{{3}}), )?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) {_TIME} ({_OFFSET}|[A-Za-z]{{1,4}})$",
        "D|$4|$3|$2|$5|$6|$7|||$8|$1",
    ),
    (
        "month_first",
        rf"^(\p{{L}}{{3,}})\.? (\d{{1,2}}),? (\d{{4}})(?:(?: at|,)? {_TIME} ?(?:([AaPp])\.?[Mm]\.?)?(?: ({_OFFSET}|[A-Za-z]{{1,4}}))?)?$",
        "D|$3|$1|$2|$4|$5|$6||$7|$8|",
    ),
    (
        "day_first",
        r"^(\d{1,2})(?:\.|er)? (?:de )?(\p{L}{3,})\.?(?: de)? (\d{4})(?:(?:,| à| at| um| a las)? (\d{1,2})[:h](\d{2})(?: Uhr)?)?$",
        "D|$3|$2|$1|$4|$5||||||",
    ),
]


def canonical_text(value: Column) -> Column:
    """The canonical text of a value, null where no pattern of the cascade fits."""
    text = strip(value)
    out: Column | None = None
    for _, pattern, form in CASCADE:
        hit = text.rlike(pattern)
        out = F.when(hit, F.regexp_replace(text, pattern, form)) if out is None else out.when(hit, F.regexp_replace(text, pattern, form))
    return out


def _wall_us(utc_us: Column, zone: Column) -> Column:
    """What the clock of ``zone`` shows at an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone))


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, each computed once.

    The columns pass through a one-element array, over which the optimizer neither merges projections nor moves
    filters; plain columns would be copied into every later use and grow beyond what can be compiled.
    """
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("__row")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__row.{n}").alias(n) for n in columns])


def normalise_timestamps(
    df: DataFrame,
    sources: DataFrame,
    value: str = "published_at",
    source: str = "source",
    ambiguous: str = "drop",
    nonexistent: str = "drop",
) -> DataFrame:
    """``df`` with ``instant_us`` (microseconds since 1970 in UTC) and ``instant_status``.

    ``sources`` has source_name, tz_name and date_order (dmy, mdy, ymd), one row
    per source; names are compared without case and outer blanks. ``ambiguous``
    is drop, earlier or later; ``nonexistent`` is drop or shift (by the length of
    the gap). Rows are never lost or multiplied, columns of ``df`` keep their
    names (``instant_*`` must be free).
    """
    lookup = (
        sources.where(F.col("source_name").isNotNull())
        .groupBy(F.lower(strip(F.col("source_name"))).alias("__key"))
        .agg(F.min("tz_name").alias("__tz"), F.min("date_order").alias("__order"))
    )
    minute, day = 60_000_000, 86_400_000_000
    months = F.create_map(*[F.lit(x) for n, names in enumerate(MONTHS, 1) for name in names for x in (name, n)])
    zones = F.create_map(*[F.lit(x) for name, offset in ZONES.items() for x in (name, offset)])
    part = lambda i: F.get(F.col("__p"), F.lit(i))
    number = lambda c: c.try_cast("int")
    blank = F.col(value).isNull() | ~F.col(value).rlike(r"[^\s\p{Z}]")

    out = df.withColumn("__key", F.lower(strip(F.col(source)))).join(lookup, "__key", "left")
    out = _step(out, {"__p": F.split(canonical_text(F.col(value)), r"\|")})
    numeric, first, second = part(0) == "N", number(part(2)), number(part(3))
    mdy = F.col("__order") == "mdy"
    known_order = F.col("__order").isin("mdy", "dmy")
    month_number = F.coalesce(number(part(2)), months[F.lower(part(2))])
    out = _step(
        out,
        {
            "__y": number(part(1)),
            "__mo": F.when(numeric, F.when(known_order, F.when(mdy, first).otherwise(second))).otherwise(month_number),
            "__d": F.when(numeric, F.when(known_order, F.when(mdy, second).otherwise(first))).otherwise(second),
            "__h": F.when(F.coalesce(part(4), F.lit("")) == "", 0).otherwise(number(part(4))),
            "__mi": F.when(F.coalesce(part(5), F.lit("")) == "", 0).otherwise(number(part(5))),
            "__s": F.when(F.coalesce(part(6), F.lit("")) == "", 0).otherwise(number(part(6))),
            "__us": number(F.rpad(F.coalesce(part(7), F.lit("")), 6, "0")),
            "__ap": F.lower(part(8)),
            "__zone": part(9),
            "__dow": F.lower(part(10)),
        },
    )
    half = F.col("__ap").isin("a", "p")
    hour = F.when(half, F.col("__h") % 12 + F.when(F.col("__ap") == "p", 12).otherwise(0)).otherwise(F.col("__h"))
    date = F.expr("try_to_date(concat_ws('-', lpad(cast(__y as string), 4, '0'), lpad(cast(__mo as string), 2, '0'), lpad(cast(__d as string), 2, '0')), 'yyyy-MM-dd')")
    fields_ok = (
        F.col("__y").between(1, 9999)
        & F.col("__mo").between(1, 12)
        & F.col("__d").between(1, 31)
        & F.when(half, F.col("__h").between(1, 12)).otherwise(F.col("__h").between(0, 23))
        & F.col("__mi").between(0, 59)
        & F.col("__s").between(0, 59)
    )
    day_ok = F.coalesce(F.col("__dow"), F.lit("")).isin("") | (F.lower(F.date_format("__date", "EEE")) == F.col("__dow"))
    digits = F.regexp_replace("__zone", "[^0-9]", "")
    offset = (
        F.when(F.col("__zone").rlike("^[+-]"), F.when(F.col("__zone").startswith("-"), -1).otherwise(1) * (number(F.substring(digits, 1, 2)) * 60 + F.coalesce(number(F.when(F.length(digits) > 2, F.substring(digits, 3, 2))), F.lit(0))))
        .otherwise(zones[F.lower("__zone")])
    )
    has_zone = F.coalesce(F.col("__zone"), F.lit("")) != ""
    kind = part(0)
    epoch = (
        F.when(kind == "E", part(1).try_cast("long") * 1_000_000 + F.rpad(F.coalesce(part(8), F.lit("")), 6, "0").try_cast("long"))
        .when(kind == "M", part(1).try_cast("long") * 1_000)
        .when(kind == "U", part(1).try_cast("long"))
    )
    out = _step(out, {"__date": F.when(fields_ok, date), "__hour": hour, "__offset": offset, "__epoch": epoch})
    out = _step(out, {"__ok": F.coalesce(F.col("__date").isNotNull() & day_ok, F.lit(False))})
    wall = F.unix_date("__date").cast("long") * day + (F.col("__hour") * 60 + F.col("__mi")).cast("long") * minute + F.col("__s").cast("long") * 1_000_000 + F.col("__us")
    out = _step(out, {"__wall": F.when(F.col("__ok"), wall)})

    # Candidate instants: the offsets in force a day before and a day after; one that maps back to the wall time is real.
    w, tz = F.col("__wall"), F.col("__tz")
    local = F.col("__ok") & ~has_zone & tz.isNotNull()
    out = _step(
        out,
        {
            "__before": F.when(local, _wall_us(w - day, tz) - (w - day)),
            "__after": F.when(local, _wall_us(w + day, tz) - (w + day)),
        },
    )
    u1, u2 = w - F.col("__before"), w - F.col("__after")
    out = _step(out, {"__r1": _wall_us(u1, tz) == w, "__r2": _wall_us(u2, tz) == w})
    twice = F.col("__r1") & F.col("__r2") & (u1 != u2)
    never = ~F.col("__r1") & ~F.col("__r2")
    on_clock = F.when(twice, {"earlier": F.least(u1, u2), "later": F.greatest(u1, u2)}.get(ambiguous, F.lit(None))).when(never, u1 if nonexistent == "shift" else F.lit(None)).when(F.col("__r1"), u1).otherwise(u2)
    status = (
        F.when(blank, "empty")
        .when(F.col("__epoch").isNotNull(), "ok")
        .when(F.col("__p").isNull(), "unreadable")
        .when(numeric & ~F.coalesce(known_order, F.lit(False)), "unreadable")
        .when(~F.coalesce(F.col("__ok"), F.lit(False)), "impossible")
        .when(has_zone & F.col("__offset").isNull(), "unreadable")
        .when(has_zone, "ok")
        .when(tz.isNull(), "no_zone")
        .when(twice, "ok" if ambiguous in ("earlier", "later") else "ambiguous")
        .when(never, "ok" if nonexistent == "shift" else "nonexistent")
        .otherwise("ok")
    )
    instant = F.when(F.col("__epoch").isNotNull(), F.col("__epoch")).when(F.col("__ok") & has_zone, w - F.col("__offset").cast("long") * minute).when(local, on_clock)
    out = _step(out, {"instant_status": status, "__instant": instant.cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "instant_status", F.when(F.col("instant_status") == "ok", F.col("__instant")).alias("instant_us"))
