"""Calendar dates, UTC instants, a finite EDTF subset and CSL date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"


def is_calendar_date(value: Column) -> Column:
    """A real Gregorian day written YYYY-MM-DD."""
    return value.rlike(DAY) & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def is_instant(value: Column) -> Column:
    """A real UTC instant of whole seconds or up to three fraction digits."""
    day = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull()
    clock = F.substring(value, 12, 8).rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    return value.rlike(INSTANT) & day & clock


def _is_atom(value: Column) -> Column:
    year, month, day = (F.regexp_extract(value, r"^([0-9X]{4})(?:-([0-9X]{2})(?:-([0-9X]{2}))?)?[?~%]?$", i) for i in (1, 2, 3))
    month_ok = (month == "") | (month == "XX") | month.rlike("^(0[1-9]|1[0-2])$")
    day_ok = (day == "") | (day == "XX") | day.rlike(r"^(0[1-9]|[12]\d|3[01])$")
    full = year.rlike(r"^\d{4}$") & month.rlike(r"^\d{2}$") & day.rlike(r"^\d{2}$")
    real = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd").isNotNull()
    return (year != "") & month_ok & day_ok & ~((month == "XX") & (day != "") & (day != "XX")) & (~full | real)


def _is_expression(value: Column) -> Column:
    parts = F.split(value, "/")
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(F.size(parts) == 1, _is_atom(one)).when(F.size(parts) == 2, _is_atom(one) & ((two == "..") | _is_atom(two))).otherwise(False)


def is_edtf(value: Column) -> Column:
    """X digits, ? ~ %, intervals with open end, and sets [..] or {..} of 2 to 100 expressions."""
    body = F.regexp_extract(value, r"^(?:\[(.*)\]|\{(.*)\})$", 1)
    body = F.when(value.startswith("{"), F.regexp_extract(value, r"^\{(.*)\}$", 1)).otherwise(body)
    members = F.split(body, ",")
    many = F.size(members).between(2, 100) & F.forall(members, lambda m: (m != "") & _is_expression(m))
    return F.coalesce(F.when(value.rlike(r"^(\[.*\]|\{.*\})$"), many).otherwise(_is_expression(value)), F.lit(False))


def date_from_parts(parts: Column) -> Column:
    """CSL date parts (year, month, day) as text."""
    item = lambda i: F.get(parts, F.lit(i)).cast("string")
    return F.concat_ws("-", F.lpad(item(0), 4, "0"), F.lpad(item(1), 2, "0"), F.lpad(item(2), 2, "0"))


def parts_from_date(value: Column) -> Column:
    """CSL date parts of YYYY, YYYY-MM or a real YYYY-MM-DD; null for what has to stay a literal."""
    ints = F.transform(F.split(value, "-"), lambda x: x.try_cast("int"))
    shape = value.rlike(r"^\d{4}(-(0[1-9]|1[0-2]))?$") | is_calendar_date(value)
    return F.when(shape, ints)


def year_of(year: Column, issued: Column, fixed_field: Column | None = None) -> Column:
    """The explicit year, else the first four characters of the issue date, else positions 7-10 of a 008 field."""
    found = [F.nullif(year, F.lit("")), F.nullif(F.substring(issued, 1, 4), F.lit(""))]
    if fixed_field is not None:
        found.append(F.nullif(F.substring(fixed_field, 8, 4), F.lit("")))
    return F.coalesce(*found)
