"""Patterns of to_char, to_date and to_timestamp, translated while a query is planned."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid


def _day_of(unit: str) -> Callable[[Column], Column]:
    return lambda x: F.call_function(unit, x)


def _int(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


#: Fields of date patterns that are numbers: Spark's pattern, or a Column and its width. Fixed values of the language.
NUMBERS: dict[str, str | tuple[Callable[[Column], Column], int]] = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS",
    "Q": (F.quarter, 1), "DDD": (F.dayofyear, 3), "D": (F.dayofweek, 1), "ID": (lambda x: F.weekday(x) + 1, 1), "IW": (F.weekofyear, 2),
    "WW": (lambda x: F.floor((F.dayofyear(x) - 1) / 7) + 1, 2), "W": (lambda x: F.floor((F.dayofmonth(x) - 1) / 7) + 1, 1),
    "IYYY": (lambda x: F.extract(F.lit("YEAROFWEEK"), x), 4), "CC": (lambda x: F.ceil(F.year(x) / 100), 2),
    "SSSS": (lambda x: F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x), 1),
}
#: Fields that are names, in the case that they are spelled in; a full name is as wide as the longest.
NAMES = {"MONTH": "MMMM", "MON": "MMM", "DAY": "EEEE", "DY": "EEE", "AM": "a", "PM": "a"}
_FIELD = re.compile(r'"(?P<text>[^"]*)"|(?P<fm>FM)?(?P<field>' + "|".join(sorted([*NUMBERS, *NAMES], key=len, reverse=True)) + r")|(?P<other>.)", re.I | re.S)


def _cased(c: Column, spelled: str) -> Column:
    return F.upper(c) if spelled.isupper() else F.lower(c) if spelled.islower() else c


def date_text(x: Column, pattern: str) -> Column:
    """A date or time as text."""
    out = []
    for m in _FIELD.finditer(pattern):
        field, short = (m["field"] or "").upper(), bool(m["fm"])
        if field in NUMBERS:
            how = NUMBERS[field]
            text = F.date_format(x, how) if isinstance(how, str) else _int(how[0](x), how[1])
            out.append(F.regexp_replace(text, "^0+(?=.)", "") if short else text)
        elif field:
            name = _cased(F.date_format(x, NAMES[field]), m["field"])
            out.append(F.rpad(name, 9, " ") if field in ("MONTH", "DAY") and not short else name)
        else:
            out.append(F.lit(m["text"] if m["text"] is not None else m["other"]))
    return F.concat(*out) if out else F.lit("")


def date_pattern(pattern: str) -> str:
    """Spark's pattern for reading texts of a pattern."""
    out = []
    for m in _FIELD.finditer(pattern):
        field = (m["field"] or "").upper()
        how = NUMBERS.get(field) or NAMES.get(field)
        if isinstance(how, tuple):
            if field != "DDD":
                raise invalid(f"{field} is not read from texts")
            how = "DDD"
        if how:
            out.append(how[0] if m["fm"] and how in ("MM", "dd", "HH", "hh", "mm", "ss") else how)
        else:
            text = m["text"] if m["text"] is not None else m["other"]
            out.append("'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", text) else text)
    return "".join(out)


def number_text(x: Column, pattern: str) -> Column:
    """A number as text: digits, groups, a decimal point and the signs FM, S, MI and PR."""
    p = pattern.upper()
    short = p.startswith("FM")
    p = p.removeprefix("FM")
    sign = next((s for s in ("MI", "PR", "S") if s in p), "")
    front = p.startswith("S")
    p = p.replace(sign, "", 1) if sign else p
    if not re.fullmatch(r"[90,G]*([.D][90]*)?", p) or not re.search("[90]", p):
        raise invalid(f"no number pattern: {pattern}")
    whole, point, rest = re.fullmatch(r"([90,G]*)([.D]?)([90]*)", p).groups()
    digits = re.sub("[,G]", "", whole)
    least = len(digits) - digits.index("0") if "0" in digits else 0
    after = [len(re.sub("[,G]", "", whole[i:])) for i, c in enumerate(whole) if c in ",G"]
    d = x.cast(f"decimal(38,{len(rest)})")
    text = F.abs(d).cast("string")
    head, tail = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    fits = F.length(head) <= len(digits)
    if not least and rest:
        head = F.when(head == "0", "").otherwise(head)
    head = F.when(F.length(head) < least, F.lpad(head, least, "0")).otherwise(head) if least else head
    parts, size = [], F.length(head)
    for i, n in enumerate([*after, 0]):
        upto = F.greatest(size - n, F.lit(0))
        start = F.greatest(size - after[i - 1], F.lit(0)) if i else F.lit(0)
        parts.append(F.nullif(F.substring(head, (start + 1).cast("int"), (upto - start).cast("int")), F.lit("")))
    body = F.concat_ws(",", *parts)
    if point:
        if short:
            keep = rest.rindex("0") + 1 if "0" in rest else 0
            tail = F.regexp_replace(tail, "0+$", "")
            tail = F.when(F.length(tail) < keep, F.rpad(tail, keep, "0")).otherwise(tail) if keep else tail
        body = F.concat(body, F.lit("."), tail if rest else F.lit(""))
    body = F.when(fits, body).otherwise(re.sub("[90]", "#", p.replace("G", ",").replace("D", ".")))
    width = len(p)
    minus = d < 0
    if sign == "PR":
        out = F.when(minus, F.concat(F.lit("<"), body, F.lit(">"))).otherwise(body if short else F.concat(F.lit(" "), body, F.lit(" ")))
        width += 2
    elif sign == "MI" or (sign == "S" and not front):
        out = F.concat(body, F.when(minus, "-").otherwise("+" if sign == "S" else "" if short else " "))
        width += 1
    else:
        out = F.concat(F.when(minus, "-").otherwise("+" if sign else ""), body)
        width += 1
    return out if short else F.when(F.length(out) < width, F.lpad(out, width, " ")).otherwise(out)


def age(a: Column, b: Column) -> Column:
    """The time between two timestamps in years, months, days and a time of day, as text; a day borrowed
    from a month is the earlier one's."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    late, early = F.greatest(a, b), F.least(a, b)
    micros = lambda x: (F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")
    time = micros(late) - micros(early)
    days = F.dayofmonth(late) - F.dayofmonth(early) - F.when(time < 0, 1).otherwise(0)
    time = time + F.when(time < 0, F.lit(86_400_000_000)).otherwise(0)
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - F.when(days < 0, 1).otherwise(0)
    days = days + F.when(days < 0, F.dayofmonth(F.last_day(early))).otherwise(0)
    minus = F.when(a < b, "-").otherwise("")
    seconds = F.floor(time / 1_000_000)
    part = time % 1_000_000
    clock = F.concat(minus, F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"),
                     F.when(part > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", ""))).otherwise(""))
    unit = lambda n, one, many: F.when(n > 0, F.concat(minus, n.cast("string"), F.when((n == 1) & (minus == ""), f" {one}").otherwise(f" {many}")))
    years = F.floor(months / 12)
    date = F.concat_ws(" ", unit(years, "year", "years"), unit(months % 12, "mon", "mons"), unit(days, "day", "days"))
    out = F.when((time == 0) & (date != ""), date).otherwise(F.concat_ws(" ", F.nullif(date, F.lit("")), clock))
    return F.when(a.isNotNull() & b.isNotNull(), out)
