"""BibTeX: entries are cut in-engine at their `@`, only brace-balanced fields are read in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions import formats, text
from bibspark.sources.canonical import IDENTIFIER, finish, first_of

HEAD = re.compile(r"@\s*([A-Za-z]+)\s*\{\s*([^,\s{}]+)\s*,")
NAME = re.compile(r"[\s,]*([A-Za-z][\w:-]*)\s*=\s*")


def _value(entry: str, at: int) -> tuple[str, int] | None:
    """The braced, quoted or bare value at a place, and where it ends."""
    if at >= len(entry):
        return None
    if entry[at] in '{"':
        depth, quoted, i = 0, entry[at] == '"', at + 1
        while i < len(entry):
            c = entry[i]
            if c == "\\":
                i += 2
                continue
            if c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif (c == '"' and quoted and not depth) or (c == "}" and not quoted):
                return entry[at + 1 : i], i + 1
            i += 1
        return None
    m = re.compile(r"[A-Za-z0-9_:-]+").match(entry, at)
    return (m[0], m.end()) if m and m[0].isdigit() else None


def entry_fields(entry: str) -> tuple[str | None, str | None, list[tuple[str, str]], str | None]:
    """(type, key, fields, problem) of one entry."""
    m = HEAD.match(entry)
    if not m:
        return None, None, [], "head"
    fields, at = [], m.end()
    while True:
        n = NAME.match(entry, at)
        if not n:
            rest = entry[at:].strip(" \r\n\t,")
            return m[1].lower(), m[2], fields, None if rest == "}" or re.fullmatch(r"\}\s*(%[^\n]*\s*)*", rest) else "unbalanced"
        got = _value(entry, n.end())
        if got is None:
            return m[1].lower(), m[2], fields, "macro-or-unbalanced"
        fields.append((n[1].lower(), got[0]))
        at = got[1]
        if entry[at:].lstrip().startswith("#"):
            return m[1].lower(), m[2], fields, "concatenation"


def bibtex_fields(files: DataFrame) -> DataFrame:
    """(path, ordinal, pos, kind, key, code, value, problem): one row per field; one row with a null code for an entry
    without fields."""
    body = F.regexp_replace("text", r"(?m)^\s*%.*$", "")
    cut = F.filter(F.split(body, r"(?m)(?=^\s*@)"), lambda x: x.rlike(r"^\s*@"))
    entries = files.select("path", F.posexplode(cut).alias("ordinal", "entry"))
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("code", pa.string()), ("value", pa.string()), ("problem", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for path, ordinal, entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind, key, fields, problem = entry_fields(entry.strip())
                if kind in ("string", "preamble"):
                    problem = "macro"
                names = [n for n, _ in fields]
                if problem is None and len(names) != len(set(names)):
                    problem = "duplicate-field"
                out += [(path, ordinal + 1, i, kind, key, n, v, problem) for i, (n, v) in enumerate(fields or [(None, None)])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return entries.mapInArrow(run, "path string, ordinal int, pos int, kind string, key string, code string, value string, problem string")


def bibtex_quarantine(files: DataFrame) -> DataFrame:
    return bibtex_fields(files).where("problem is not null").select("path", "problem").distinct()


def read_bibtex(files: DataFrame) -> DataFrame:
    f = bibtex_fields(files)
    bad = f.where("problem is not null").select("path").distinct()
    f = f.join(bad, "path", "left_anti").withColumn("value", F.trim(F.regexp_replace(text.bibtex_unescape(F.col("value")), r"(?<!\\)[{}]", "")))
    one = lambda *codes: first_of(list(codes))
    rows = f.groupBy("path", "ordinal").agg(
        F.first("key").alias("id"), F.first("kind").alias("kind"), one("title").alias("title"), one("author").alias("author"), one("editor").alias("editor"), one("date", "year").alias("issued"), one("year", "date").alias("year"), one("publisher").alias("publisher"),
        one("address").alias("place"), one("language").alias("language"), one("abstract").alias("abstract"), one("copyright").alias("rights"), one("series").alias("series"), one("journal", "booktitle").alias("container_title"), one("volume").alias("volume"), one("number").alias("issue"),
        one("pages").alias("pages"), one("edition").alias("edition"), one("type").alias("declared"), one("keywords").alias("keywords"), one("note").alias("note"), one("url").alias("url"), one("doi").alias("doi"), one("isbn").alias("isbn"), one("issn").alias("issn"),
    )
    ident = lambda s: F.when(F.col(s) != "", F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value")))
    none = F.array().cast("array<string>")
    names = lambda c: F.when(F.col(c) != "", text.split_names(F.col(c))).otherwise(none)
    out = rows.withColumns({"creators": names("author"), "contributors": names("editor"), "subjects": text.split_list(F.col("keywords")), "notes": F.filter(F.array("note"), lambda x: x != ""), "links": F.filter(F.array("url"), lambda x: x != ""), "identifiers": F.coalesce(F.array_compact(F.array(ident("doi"), ident("isbn"), ident("issn"))), F.array().cast(IDENTIFIER)), "format": F.coalesce(formats.exact_format(F.col("declared")), formats.format_from_bibtex(F.col("kind"))), "year": F.substring("year", 1, 4)})
    return finish(out, "bibtex")
