"""texts that a JavaScript ``Date`` accepts, as timestamps.

ISO texts go to Spark's own cast.  All others are normalised (case, commas, notes in
brackets, weekday, zone) and matched with an ordered table of shapes, each of which puts
year, month, day and the time into one order; ``make_timestamp`` puts them together.  A text of
no shape, or with a part out of range, is null.  Texts without a zone are in UTC, the
zone that the jobs run in.

Like the reference's runtime, a day up to 31 that its month does not have runs on into
the next month (30 February), a year of one or two digits is 2000 to 2049 or 1950 to
1999, and a month is told by its first three letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO dates, alone or with a time of day; text that is only a time has no date of its own
ISO_SHAPE = (r"^[+-]?\d{4,6}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?"
             r"\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?\z")

# --- fixed values: what the reference's runtime knows ---------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONE_HOURS = {"gmt": 0, "utc": 0, "ut": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6,
              "pst": -8, "pdt": -7}
# --- end of fixed values ----------------------------------------------------------

_MONTH = r"(" + "|".join(MONTHS) + r")[a-z]*\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.? )?"
_TIME = (r"(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?(?: ?(am|pm))?)?"
         r"(?: ?(" + "|".join(sorted(ZONE_HOURS, key=len, reverse=True)) + r"))?(?: ?([+-])(\d{1,2}):?(\d{2})?)?$")

# (pattern of the day, places of year, month and day in it), the first match counts
SHAPES = [
    (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}) (\d{{1,6}})", 3, 1, 2),        # March 7, 2024; Thu Mar 07 2024
    (rf"^{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH}[ -](\d{{1,6}})", 3, 2, 1),  # 7 March 2024; Thu, 07 Mar 2024; 7-Mar-2024
    (rf"^{_WEEKDAY}(\d{{3,6}})[ -]{_MONTH}[ -](\d{{1,2}})", 1, 2, 3),  # 2024 March 7
    (r"^(\d{3,6})/(\d{1,2})/(\d{1,2})", 1, 2, 3),                      # 2024/03/07
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{1,6})", 3, 1, 2),                # 3/7/2024
]
# the groups of the time, after the three of the day
CLOCK = "|".join(f"${n}" for n in range(4, 13))


def _normal(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, r"\([^()]*\)", " "))
    return F.trim(F.regexp_replace(plain, r"[\s,]+", " "))


def _value(p: Column) -> Column:
    """Timestamp of the split parts: #year, month, day, hour, minute, second, fraction, am/pm, zone, sign, hours, minutes."""
    number = lambda n: F.coalesce(p[n].try_cast("int"), F.lit(0))
    digits = F.substring(p[0], 2, 6)
    year = digits.try_cast("int")
    year = F.when((F.length(digits) <= 2) & (year < 50), year + 2000).when(F.length(digits) <= 2, year + 1900).otherwise(year)
    month = F.coalesce(p[1].try_cast("int"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), p[1]).cast("int"))
    days, hour, minute, second = number(2), number(3), number(4), number(5)
    millis = F.rpad(F.substring(p[6], 1, 3), 3, "0").try_cast("int")
    hour_ok = F.when(p[7] == "", hour <= 24).otherwise(hour.between(0, 12))
    hour = F.when(p[7] == "pm", hour % 12 + 12).when(p[7] == "am", hour % 12).otherwise(hour)
    zone = F.coalesce(F.create_map(*[F.lit(x) for z, h in ZONE_HOURS.items() for x in (z, h * 60)])[p[8]], F.lit(0))
    offset = F.when(p[9] == "-", -1).otherwise(1) * (number(10) * 60 + number(11))
    ok = (month.between(1, 12) & days.between(1, 31) & hour_ok & (minute < 60) & (second < 60) & year.between(1, 9999)
          & ((hour < 24) | (minute + second + millis == 0)))           # 24 o'clock is midnight, not later
    first = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    seconds = (days - 1) * 86400 + hour * 3600 + (minute - zone - offset) * 60 + second
    return F.when(ok, F.timestamp_add("MILLISECOND", seconds.cast("long") * 1000 + millis, first))


def parse_js_date(text: Column) -> Column:
    """A text that names a date -> timestamp, else null."""
    parts = _normal(text)
    for day, year_at, month_at, day_at in SHAPES:        # a text that has been put in order starts with # and fits no other
        parts = F.regexp_replace(parts, day + _TIME, f"#${year_at}|${month_at}|${day_at}|{CLOCK}")
    # one element, so that the parts are made once; the shapes are tried for texts that are not ISO only
    found = F.transform(F.array(F.split(parts, r"\|")), lambda p: F.when((F.size(p) == 12) & p[0].startswith("#"), _value(p)))[0]
    return F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp")).otherwise(found)
