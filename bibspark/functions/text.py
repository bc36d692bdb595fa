"""Scalar text expressions: cleaning, keys, spreadsheet safety, list and cell codecs, escapes. Columns in, Columns out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BIDI = r"[\u202A-\u202E\u2066-\u2069]"
BLANK = r"[\s\p{Z}\p{Cf}']"


def _form(name: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(name, v))

    return F.pandas_udf(run, "string")


def normal_form(value: Column, form: str = "NFC") -> Column:
    """Unicode normal form (NFC, NFKC, NFKD): the only scalar UDF of the library. Arrow batches; ASCII values pass."""
    return _form(form)(value)


def clean_text(value: Column, unicode: bool = False) -> Column:
    """LF line ends, no white space around; unicode adds NFC."""
    return trim_white(source_text(value, unicode))


def source_text(value: Column, unicode: bool = False) -> Column:
    out = F.regexp_replace(value, r"\r\n?", "\n")
    return normal_form(out, "NFC") if unicode else out


def trim_white(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\uFEFF\p{Z}]+|[\s\uFEFF\p{Z}]+$", "")


def text_problem(value: Column, most: int, required: bool = False) -> Column:
    """First reason why a cleaned text is not acceptable, or null."""
    tests = [(value.rlike(CONTROL), "control"), (F.length(value) > most, "length")]
    if required:
        tests.append((F.coalesce(value, F.lit("")) == "", "missing"))
    return first_reason(*tests)


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The name of the first true test, or null."""
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in tests])


def is_canonical(value: Column, most: int, required: bool = False, unicode: bool = False) -> Column:
    """Whether a text equals its cleaned form and breaks no rule."""
    return (value == clean_text(value, unicode)) & text_problem(value, most, required).isNull()


def audit_text(value: Column, most: int, fallback: str) -> Column:
    out = F.substring(trim_white(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F]+", " ")), 1, most)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def audit_target(digest: Column, fmt: Column, name: Column, most: int = 512) -> Column:
    """What an import's audit event names: digest, format and file name, bounded."""
    return audit_text(F.concat_ws(" \u00b7 ", digest, fmt, name), most, "unknown")


def display_name(value: Column) -> Column:
    """A workspace name: NFKC, single spaces; null if empty, bidirectional or controlled, or over 120 characters."""
    out = F.trim(F.regexp_replace(normal_form(value, "NFKC"), r"[\s\p{Z}]+", " "))
    return F.when((out != "") & ~out.rlike(CONTROL) & ~out.rlike(BIDI) & (F.length(out) <= 120), out)


def title_key(title: Column, unicode: bool = True) -> Column:
    """Match key of a title: NFKD, lower case, runs of other than a-z and 0-9 become one space."""
    value = normal_form(title, "NFKD") if unicode else title
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def has_format_control(value: Column) -> Column:
    return value.rlike(r"\p{Cf}")


def is_identity_text(value: Column) -> Column:
    return (trim_white(value) != "") & ~has_format_control(value)


def key_skeleton(value: Column) -> Column:
    """Look-alike key of a column name: NFKC without format controls, lower case."""
    return F.lower(F.regexp_replace(normal_form(value, "NFKC"), r"\p{Cf}", ""))


def formula_like(value: Column, unicode: bool = False) -> Column:
    rest = F.regexp_replace(value, f"^{BLANK}+", "")
    return (normal_form(rest, "NFKC") if unicode else rest).rlike("^[=+@-]")


def spreadsheet_class(value: Column, unicode: bool = False) -> Column:
    """safe, protected (a leading apostrophe guards a formula) or active-risk."""
    guarded = value.startswith("'") & formula_like(F.substring(value, 2, 1 << 30), unicode)
    return F.when(guarded, "protected").when(formula_like(value, unicode), "active-risk").otherwise("safe")


def protect_cell(value: Column, unicode: bool = False) -> Column:
    return F.when(formula_like(value, unicode), F.concat(F.lit("'"), value)).otherwise(value)


def unprotect_cell(value: Column, unicode: bool = False) -> Column:
    return F.when(spreadsheet_class(value, unicode) == "protected", F.substring(value, 2, 1 << 30)).otherwise(value)


def split_list(value: Column) -> Column:
    """Non-empty trimmed parts between `;` or `|`."""
    return F.filter(F.transform(F.split(value, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def encode_pipe_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))), "|")


def decode_pipe_list(value: Column) -> Column:
    """Inverse of encode_pipe_list for non-empty trimmed values; empty members are left out."""
    runs = F.regexp_extract_all(value, F.lit(r"((?:\\[\\|]|[^|])+)"), F.lit(1))
    out = F.transform(runs, lambda x: F.trim(F.regexp_replace(x, r"\\([\\|])", "$1")))
    return F.filter(out, lambda x: x != "")


def json_list(value: Column) -> Column:
    """The strings of a JSON list cell; null if it is not a list of strings."""
    parsed = F.from_json(value, "array<string>")
    return F.when(value.rlike(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'), parsed)


def encode_json_list(values: Column) -> Column:
    return F.to_json(values)


def one_per_line(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def strict_boolean(value: Column, fallback: bool | None = None) -> Column:
    """true/yes/y/1 and false/no/n/0 in any case; empty gives the fallback, anything else null."""
    key = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(key.isin("true", "yes", "y", "1"), True).when(key.isin("false", "no", "n", "0"), False).when(key == "", F.lit(fallback).cast("boolean"))


def tsv_escape(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def tsv_unescape(value: Column) -> Column:
    mark = "\ue000"
    out = F.replace(value, F.lit("\\\\"), F.lit(mark))
    for raw, code in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def csv_cell(value: Column) -> Column:
    """A protected cell, quoted where it must be."""
    safe = protect_cell(value)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def xml_escape(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for raw, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def xml_unescape(value: Column) -> Column:
    out = value
    for raw, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def bibtex_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([{}\\%&$#_])", r"\\$1")


def bibtex_unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"\\([{}\\%&$#_])", "$1")


def plain_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\r\n]+", " "))


def split_names(value: Column) -> Column:
    """Names between ` and ` (for values without braces)."""
    return F.filter(F.transform(F.split(value, r"(?i)\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def render(values: Column, dash: str = "—") -> Column:
    return F.coalesce(F.nullif(F.array_join(values, "; "), F.lit("")), F.lit(dash))


def typed(values: Column, kind: str) -> Column:
    """Texts as values of a kind (integer, decimal, boolean or text); null where one is not."""
    if kind == "boolean":
        return F.transform(values, lambda x: strict_boolean(x))
    return F.transform(values, lambda x: x.try_cast({"integer": "long", "decimal": "double"}.get(kind, "string")))


def slug(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)


def output_name(base: Column, extension: str) -> Column:
    return F.concat(F.coalesce(F.nullif(slug(base), F.lit("")), F.lit("export")), F.lit(f".{extension}"))


def is_language_tag(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")


def is_media_type(value: Column) -> Column:
    token = r"[A-Za-z0-9!#$&^_.+-]+"
    return value.rlike(rf'^{token}/{token}(\s*;\s*{token}=({token}|"[^"]*"))*$')


def is_checksum(value: Column) -> Column:
    return F.lower(value).rlike("^(sha256:[a-f0-9]{64}|sha512:[a-f0-9]{128}|md5:[a-f0-9]{32})$")


def is_safe_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9._:-]{1,128}$")


def is_ncname(value: Column) -> Column:
    return value.rlike("^[A-Za-z_][A-Za-z0-9_.-]{0,127}$")
