"""CSL-JSON, schema.org JSON-LD and native packets: VARIANT paths to canonical records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.functions import dates, formats, identity, text
from bibspark.functions.text import first_reason
from bibspark.operators.scan import running
from bibspark.operators.tables import stage
from bibspark.sources.canonical import IDENTIFIER, finish

CONTEXTS = ("https://schema.org", "https://schema.org/", "http://schema.org", "http://schema.org/")
NAME = "array<struct<literal:string,family:string,given:string>>"


def _items(files: DataFrame, path: str) -> DataFrame:
    """(path, ordinal, item): members of an array (or of an array at path), or the one object."""
    v = F.try_parse_json("text")
    many = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return files.select("path", F.posexplode(many).alias("ordinal", "item")).withColumn("ordinal", F.col("ordinal") + 1).where("item is not null")


def _s(path: str, item: str = "item") -> Column:
    return F.coalesce(F.try_variant_get(F.col(item), path, "string"), F.lit(""))


def json_quarantine(files: DataFrame) -> DataFrame:
    """(path, problem): JSON that does not parse or repeats a member name."""
    return files.where(F.try_parse_json("text").isNull()).select("path", F.lit("invalid-json").alias("problem"))


def read_csl(files: DataFrame) -> DataFrame:
    rows = _items(files, "$.items")
    names = lambda p: F.coalesce(F.transform(F.try_variant_get("item", p, NAME), lambda n: F.coalesce(n["literal"], F.concat_ws(", ", n["family"], n["given"]))), F.array().cast("array<string>"))
    ident = lambda scheme, p: F.when(_s(p) != "", F.struct(F.lit(scheme).alias("scheme"), _s(p).alias("value")))
    parts = F.get(F.try_variant_get("item", "$.issued['date-parts']", "array<array<string>>"), F.lit(0))
    issued = F.coalesce(F.nullif(_s("$.issued.literal"), F.lit("")), dates.date_from_parts(parts), F.lit(""))
    links = F.filter(F.array(_s("$.URL")), lambda x: x != "")
    declared = formats.exact_format(_s("$.genre"))
    out = rows.select(
        "path", "ordinal", _s("$.id").alias("id"), _s("$.title").alias("title"), names("$.author").alias("creators"), F.concat(names("$.editor"), names("$.translator")).alias("contributors"), text.split_list(_s("$.keyword")).alias("subjects"), links.alias("links"),
        F.array_compact(F.array(ident("doi", "$.DOI"), ident("isbn", "$.ISBN"), ident("issn", "$.ISSN"), ident("local", "$.PMID"))).alias("identifiers"), F.coalesce(declared, formats.format_from_csl(_s("$.type"), F.size(links) > 0)).alias("format"), issued.alias("issued"),
        _s("$.publisher").alias("publisher"), _s("$['publisher-place']").alias("place"), _s("$.language").alias("language"), _s("$.abstract").alias("abstract"), _s("$['container-title']").alias("container_title"), _s("$.volume").alias("volume"), _s("$.issue").alias("issue"), _s("$.page").alias("pages"), F.filter(F.array(_s("$.note")), lambda x: x != "").alias("notes"),
    )
    return finish(out, "csl-json")


def read_jsonld(files: DataFrame) -> DataFrame:
    rows = _items(files, "$['@graph']")
    as_list = lambda p: F.coalesce(F.try_variant_get("item", p, "array<string>"), F.filter(F.array(_s(p)), lambda x: x != ""))
    people = lambda p: F.coalesce(F.transform(F.try_variant_get("item", p, "array<struct<name:string>>"), lambda n: n["name"]), F.filter(F.array(F.coalesce(F.nullif(_s(f"{p}.name"), F.lit("")), _s(p))), lambda x: x != ""))
    typed = F.coalesce(F.transform(F.try_variant_get("item", "$.identifier", "array<struct<propertyID:string,value:string>>"), lambda i: F.struct(identity.identifier_scheme(F.coalesce(i["propertyID"], F.lit("local"))).alias("scheme"), i["value"].alias("value"))), F.array().cast(IDENTIFIER))
    links = as_list("$.url")
    out = rows.select(
        "path", "ordinal", F.coalesce(identity.urn_payload(_s("$['@id']"), "bibspark"), F.lit("")).alias("id"), F.coalesce(F.nullif(_s("$.name"), F.lit("")), _s("$.headline")).alias("title"), people("$.author").alias("creators"), people("$.contributor").alias("contributors"),
        F.when(F.size(as_list("$.keywords")) > 0, as_list("$.keywords")).otherwise(as_list("$.about")).alias("subjects"), links.alias("links"), F.filter(typed, lambda i: i["value"].isNotNull()).alias("identifiers"),
        F.coalesce(formats.exact_format(_s("$.additionalType")), formats.format_from_schema(_s("$['@type']"), F.size(links) > 0)).alias("format"), _s("$.datePublished").alias("issued"), F.coalesce(F.nullif(_s("$.publisher.name"), F.lit("")), _s("$.publisher")).alias("publisher"),
        _s("$.inLanguage").alias("language"), _s("$.description").alias("abstract"), _s("$.license").alias("license"), _s("$.copyrightNotice").alias("rights"),
    )
    return finish(out, "jsonld")


def jsonld_quarantine(files: DataFrame) -> DataFrame:
    """(path, problem): no accepted context, or a context inside a member of the graph."""
    v = F.try_parse_json("text")
    context = F.coalesce(F.try_variant_get(v, "$['@context']", "string"), F.lit(""))
    problem = first_reason((v.isNull(), "invalid-json"), (~context.isin(*CONTEXTS), "context"), (F.size(F.regexp_extract_all("text", F.lit(r'("@context"\s*:)'), F.lit(1))) > 1, "nested-context"))
    return files.select("path", problem.alias("problem")).where("problem is not null")


PACKET_KEYS = ("id", "title", "creators", "contributors", "year", "format", "identifiers", "links", "availability", "edition", "location", "suppressed", "public_visible", "requestable", "metadata")
PACKET = f"id string, title string, creators array<string>, contributors array<string>, year string, format string, identifiers {IDENTIFIER}, links array<string>, availability string, edition string, location string, suppressed boolean, public_visible boolean, requestable boolean, metadata struct<issued:string,publisher:string,place:string,language:string,subjects:array<string>,genres:array<string>,abstract:string,rights:string,license:string,series:string,container_title:string,volume:string,issue:string,pages:string,extent:string,coverage:string,relations:array<string>,notes:array<string>>"


def read_packet(files: DataFrame) -> DataFrame:
    """Native packets {format_version, records: [...]} of which no record has an unknown key."""
    rows = _items(files, "$.records").withColumn("json", F.to_json("item"))
    good = rows.where(F.size(F.array_except(F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")), F.array(*map(F.lit, PACKET_KEYS)))) == 0)
    r = good.select("path", "ordinal", F.from_json("json", PACKET).alias("r"))
    none = F.array().cast("array<string>")
    lists = ("subjects", "genres", "relations", "notes")
    meta = [F.coalesce(f"r.metadata.{c}", none if c in lists else F.lit("")).alias(c) for c in ("issued", "publisher", "place", "language", "subjects", "genres", "abstract", "rights", "license", "series", "container_title", "volume", "issue", "pages", "extent", "coverage", "relations", "notes")]
    top = [F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("id", "title", "year", "format", "availability", "edition", "location")]
    arrays = [F.coalesce(f"r.{c}", none).alias(c) for c in ("creators", "contributors", "links")]
    return finish(r.select("path", "ordinal", *top, *arrays, F.coalesce("r.identifiers", F.array().cast(IDENTIFIER)).alias("identifiers"), F.coalesce("r.suppressed", F.lit(False)).alias("suppressed"), *meta), "packet-json")


def packet_unknown_keys(files: DataFrame) -> DataFrame:
    """(path, ordinal, key) of record keys that a packet may not have."""
    rows = _items(files, "$.records").select("path", "ordinal", F.json_object_keys(F.to_json("item")).alias("keys"))
    return rows.select("path", "ordinal", F.explode(F.array_except("keys", F.array(*map(F.lit, PACKET_KEYS)))).alias("key"))


ROOM = np.zeros(256, np.int64)  # what a byte outside strings adds to the depth
ROOM[[ord(c) for c in "[{"]], ROOM[[ord(c) for c in "]}"]] = 1, -1
MARKS = np.isin(np.arange(256), [ord(c) for c in "[]{},:"])


def _pieces(batches, inherited: int):
    """Batches (path, split, piece, what a range inherits ...) -> (key, inherited values, text, starts, flips) of each range's part of
    a batch: key is (path, split), the text is the pieces with a quote behind each, starts are where pieces begin, flips
    whether the quote behind a piece opens or ends a string (not after an odd number of backslashes)."""
    for b in batches:
        path, split = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (split[1:] != split[:-1]), True]) if b.num_rows else np.zeros(1, np.int64)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            piece = b.column(2).slice(a, z - a).cast(pa.large_string())
            at = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + z - a + 1]
            raw = np.frombuffer(piece.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            at = at - at[0]
            text = np.full(len(raw) + z - a, ord('"'), np.uint8)
            text[np.arange(len(raw)) + np.repeat(np.arange(z - a), np.diff(at))] = raw
            starts = at + np.arange(z - a + 1)
            flips = np.ones(z - a, bool)
            for i in np.flatnonzero((np.diff(at) > 0) & (text[np.maximum(starts[1:] - 2, 0)] == ord("\\"))):
                own = text[starts[i] : starts[i + 1] - 1].tobytes()
                flips[i] = (len(own) - len(own.rstrip(b"\\"))) % 2 == 0
            yield (path[a], int(split[a])), [b.column(3 + i)[a].as_py() for i in range(inherited)], text, starts, flips


def _inside(flips: np.ndarray, odd: int) -> np.ndarray:
    """Whether pieces are inside strings, if `odd` quotes stand before the first one."""
    return (np.cumsum(flips) - flips + odd) % 2 == 1


def _range_totals(batches):
    """One row a range: its quotes, and what it adds to the depth if it begins outside (even) or inside a string (odd)."""
    key, total = None, []
    for k, _, text, starts, flips in _pieces(batches, 0):
        if k != key:
            if key:
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "split", "quotes", "even", "odd"), (*key, *total), strict=True))], TOTALS)
            key, total = k, [0, 0, 0]
        depth = np.r_[0, np.cumsum(ROOM[text])]
        depth = depth[starts[1:]] - depth[starts[:-1]]
        inside = _inside(flips, total[0])
        total = [total[0] + int(flips.sum()), total[1] + int(depth[~inside].sum()), total[2] + int(depth[inside].sum())]
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "split", "quotes", "even", "odd"), (*key, *total), strict=True))], TOTALS)


TOTALS = pa.schema([("path", pa.string()), ("split", pa.int64()), ("quotes", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())])
EVENTS = pa.schema([("path", pa.string()), ("split", pa.int64()), ("pos", pa.int64()), ("mark", pa.string()), ("depth", pa.int64()), ("key", pa.string())])
FRAGMENTS = pa.schema([("path", pa.string()), ("split", pa.int64()), ("nth", pa.int64()), ("last", pa.bool_()), ("s", pa.string())])


def _walk(batches, level: int, inherited: int):
    """Ranges whose start is known, (path, split, piece, odd, depth, ...) -> (key, inherited values, first, text, base, events, ends): text
    begins at the range's byte `base`; events are (place, mark, depth, key) of what may begin or end the array: its own
    brackets, and names (mark "") and colons at depth 1 of a root object; ends are commas at the array's depth."""
    key, odd, depth, base = None, 0, 0, 0
    for k, values, text, starts, flips in _pieces(batches, inherited):
        first = k != key
        if first:
            key, odd, depth, base = k, values[0], values[1], 0
        inside = _inside(flips, odd)
        at = np.flatnonzero(MARKS[text] & ~np.repeat(inside, np.diff(starts)))
        mark = text[at]
        now = depth + np.cumsum(ROOM[mark])
        found = (mark == ord("[")) & (now == level) | (mark == ord("]")) & (now == level - 1)
        events = []
        if level == 2:
            found |= (mark == ord(":")) & (now == 1)
            here = np.flatnonzero(inside)
            before = np.searchsorted(at, starts[here])  # marks before the piece
            for i in here[np.r_[depth, now][before] == 1]:
                events.append((int(starts[i]), "", 1, text[starts[i] : starts[i + 1] - 1].tobytes().decode("utf-8", "replace")))
        events += [(int(at[i]), chr(mark[i]), int(now[i]), None) for i in np.flatnonzero(found)]
        yield key, values, first, text, base, sorted(events), at[(mark == ord(",")) & (now == level)]
        odd, depth, base = (odd + int(flips.sum())) % 2, int(now[-1]) if len(now) else depth, base + len(text)


def _events(level: int):
    def run(batches):
        for key, _, _, _, base, events, _ in _walk(batches, level, 2):
            if events:
                yield pa.RecordBatch.from_pylist([dict(zip(EVENTS.names, (*key, base + at, *rest), strict=True)) for at, *rest in events], EVENTS)

    return run


def _fragments(level: int, member: str | None):
    """Ranges (path, split, piece, odd, depth, key, of, within) -> (path, split, nth, last, s): texts between ends of items; a range's first and
    last one may go on in other ranges."""

    def run(batches):
        own, name, of, within, nth, held = None, None, None, False, 0, []
        for key, values, first, text, base, events, ends in _walk(batches, level, 5):
            out = []
            if first:
                if own:
                    out.append((*own, nth, True, b"".join(held).decode("utf-8", "replace")))
                own, (name, of, within), nth, held = key, values[2:], 0, []
            done, ends, k = 0, ends.tolist(), 0
            for at, mark, depth, string in [*events, (len(text), None, 0, None)]:  # up to each event, the text is within the array or not
                while k < len(ends) and ends[k] < at:
                    if within:
                        held.append(text[done : ends[k]].tobytes())
                        out.append((*own, nth, False, b"".join(held).decode("utf-8", "replace")))
                        nth, held = nth + 1, []
                    done, k = ends[k] + 1, k + 1
                opens = mark == "[" and depth == level and (member is None or of == member)
                closes = mark == "]" and depth == level - 1
                if within and (closes or mark is None):
                    held.append(text[done:at].tobytes())
                if opens or closes:
                    done, within = at + 1, opens
                elif mark == ":":
                    of = name
                elif mark == "":
                    name = string
            if out:
                yield batch_of(out)
        if own:
            yield batch_of([(*own, nth, True, b"".join(held).decode("utf-8", "replace"))])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FRAGMENTS.types, strict=True)], schema=FRAGMENTS)

    return run


def read_large_array(spark: SparkSession, path: str, glob: str = "*", member: str | None = None) -> DataFrame:
    """(path, ordinal, json) of the items of JSON arrays in files of any size: the array is the file's root, or the `member`
    of its root object.

    Files are read in ranges, each a task, and cut at every quote. What a range inherits (whether it begins inside a
    string, how deep, behind which name, within the array or not, how many items have ended) is found from one row a
    range and the few names and brackets of the root. So no row is shuffled but the two items at a range's ends. Quotes
    after an odd number of backslashes are inside their string. Null items are items; an empty array gives no row."""
    lines = spark.read.option("lineSep", '"').option("pathGlobFilter", glob).text(path)
    p = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("piece"))
    level = 1 if member is None else 2
    ranges = ["path", "split"]
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    none = lambda c: F.coalesce(c, F.lit(0))
    totals = stage(p.mapInArrow(_range_totals, "path string, split long, quotes long, even long, odd long"), "ranges")
    starts = totals.withColumn("begins", none(F.sum("quotes").over(before)) % 2).withColumn("adds", F.when(F.col("begins") == 0, F.col("even")).otherwise(F.col("odd")))
    starts = starts.select(*ranges, F.col("begins").alias("odd"), none(F.sum("adds").over(before)).alias("depth"))
    known = lambda s: p.join(F.broadcast(s), ranges).select(*ranges, "piece", *[c for c in s.columns if c not in ranges])  # noqa: E731  (a row a range)
    e = stage(known(starts).mapInArrow(_events(level), "path string, split long, pos long, mark string, depth long, key string"), "events")
    e = e.withColumn("of", F.lit(None).cast("string"))
    if member is not None:  # the array behind the member's name and colon in the root object
        named = running(e.drop("of"), ["path"], ["split", "pos"], earlier={"name": F.col("key")})
        e = running(named, ["path"], ["split", "pos"], earlier={"of": F.when(F.col("mark") == ":", F.col("name"))}).withColumn("colon", F.when(F.col("mark") == ":", F.struct(F.col("name").alias("of"))))
    opens = (F.col("mark") == "[") & (F.col("depth") == level) & (F.lit(True) if member is None else F.coalesce(F.col("of") == member, F.lit(False)))
    closes = (F.col("mark") == "]") & (F.col("depth") == level - 1)
    toggle = F.when(opens, True).when(closes, False)
    latest = lambda c, name: F.max_by(c, F.when(c.isNotNull(), F.col("pos"))).alias(name)
    colon = F.col("colon.of") if member is not None else F.lit(None).cast("string")
    state = starts.join(e.groupBy(*ranges).agg(latest(F.col("key"), "key"), latest(colon, "of"), latest(toggle, "within")), ranges, "left")
    state = state.select(*ranges, "odd", "depth", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("key", "of")], F.coalesce(F.last("within", ignorenulls=True).over(before), F.lit(False)).alias("within"))
    found = stage(known(state).mapInArrow(_fragments(level, member), "path string, split long, nth long, last boolean, s string"), "items")
    counts = found.where("last").select(*ranges, none(F.sum("nth").over(before)).alias("earlier"))
    found = found.join(F.broadcast(counts), ranges).withColumn("ordinal", F.col("earlier") + F.col("nth") + 1)
    edges = found.where("nth = 0 or last").groupBy("path", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "s"))), lambda x: x["s"]), "").alias("s"))  # one item is one row
    items = found.where("nth > 0 and not last").select("path", "ordinal", "s").unionByName(edges)
    return items.select("path", "ordinal", F.trim("s").alias("json")).where("json <> ''")
