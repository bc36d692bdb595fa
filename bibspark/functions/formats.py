"""Record formats: inference from foreign types and the way back, archival levels, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record formats, and the type names that exchange formats give them.
RECORD_FORMATS = ("Article", "Book", "Online book", "Book chapter", "Conference paper", "Serial", "Newspaper", "Video", "Audio", "Image", "Map", "Score", "Dataset", "Software", "Website", "Report", "Thesis", "Manuscript", "Archival collection", "Other")
AVAILABILITY = ("Available", "Online", "Unavailable", "Check availability")
LEVELS = ("repository", "fonds", "collection", "record-group", "series", "subseries", "file", "item", "other")
RIS_IN = {"JOUR": "Article", "CHAP": "Book chapter", "CPAPER": "Conference paper", "CONF": "Conference paper", "BOOK": "Book", "EBOOK": "Online book", "SER": "Serial", "NEWS": "Newspaper", "VIDEO": "Video", "SOUND": "Audio", "ART": "Image", "MAP": "Map", "MUSIC": "Score", "DATA": "Dataset", "COMP": "Software", "ELEC": "Website", "RPRT": "Report", "THES": "Thesis", "MANSCPT": "Manuscript"}
RIS_OUT = {v: k for k, v in RIS_IN.items() if k != "CONF"}
BIBTEX_IN = {"article": "Article", "incollection": "Book chapter", "inbook": "Book chapter", "inproceedings": "Conference paper", "conference": "Conference paper", "book": "Book", "booklet": "Book", "periodical": "Serial", "proceedings": "Serial", "techreport": "Report", "report": "Report", "phdthesis": "Thesis", "mastersthesis": "Thesis", "thesis": "Thesis", "unpublished": "Manuscript", "dataset": "Dataset", "software": "Software", "online": "Website", "webpage": "Website"}
BIBTEX_OUT = {"Article": "article", "Book chapter": "incollection", "Conference paper": "inproceedings", "Book": "book", "Online book": "book", "Newspaper": "article", "Report": "techreport", "Thesis": "phdthesis", "Manuscript": "unpublished"}
CSL_OUT = {"Article": "article-journal", "Book chapter": "chapter", "Conference paper": "paper-conference", "Book": "book", "Online book": "book", "Serial": "article", "Newspaper": "article-newspaper", "Video": "motion_picture", "Audio": "song", "Dataset": "dataset", "Software": "software", "Website": "webpage", "Report": "report", "Thesis": "thesis", "Manuscript": "manuscript", "Map": "map", "Score": "musical_score"}
SCHEMA_OUT = {"Article": "ScholarlyArticle", "Book chapter": "Chapter", "Conference paper": "ScholarlyArticle", "Book": "Book", "Online book": "Book", "Serial": "Periodical", "Newspaper": "Newspaper", "Video": "VideoObject", "Audio": "AudioObject", "Image": "ImageObject", "Map": "Map", "Score": "MusicComposition", "Dataset": "Dataset", "Software": "SoftwareSourceCode", "Website": "WebSite", "Report": "Report", "Thesis": "Thesis", "Manuscript": "Manuscript", "Archival collection": "ArchiveComponent"}
MODS_OUT = {**dict.fromkeys(("Article", "Book", "Online book", "Book chapter", "Conference paper", "Serial", "Newspaper", "Report", "Thesis", "Manuscript"), "text"), "Video": "moving image", "Audio": "sound recording", "Image": "still image", "Map": "cartographic", "Score": "notated music", "Software": "software, multimedia"}
CSL_IN = {**dict.fromkeys(("article", "article-journal", "article-magazine", "article-newspaper"), "Article"), "book": "Book", "chapter": "Book chapter", "paper-conference": "Conference paper", "thesis": "Thesis", "report": "Report", "dataset": "Dataset", "software": "Software", "webpage": "Website", "motion_picture": "Video", "song": "Audio", "map": "Map", "manuscript": "Manuscript"}
SCHEMA_IN = {
    **dict.fromkeys(("article", "scholarlyarticle", "newsarticle", "techarticle", "medicalscholarlyarticle"), "Article"), "chapter": "Book chapter", **dict.fromkeys(("book", "audiobook"), "Book"), "periodical": "Serial", "newspaper": "Newspaper", "videoobject": "Video", **dict.fromkeys(("audioobject", "audioobjectsnapshot"), "Audio"),
    **dict.fromkeys(("imageobject", "imageobjectsnapshot"), "Image"), "map": "Map", **dict.fromkeys(("musiccomposition", "musicrecording", "sheetmusic"), "Score"), "dataset": "Dataset", **dict.fromkeys(("softwaresourcecode", "softwareapplication"), "Software"), **dict.fromkeys(("website", "webpage"), "Website"), "report": "Report", "thesis": "Thesis", "manuscript": "Manuscript",
    **dict.fromkeys(("archivecomponent", "archiveorganization"), "Archival collection"),
}
# Words of MODS resource types and genres: those that name a material, and those that name a kind of text.
MATERIALS = {
    **dict.fromkeys(("archival", "archive", "archives", "collection", "collections"), "Archival collection"), **dict.fromkeys(("cartographic", "map", "maps"), "Map"), **dict.fromkeys(("dataset", "datasets"), "Dataset"), **dict.fromkeys(("moving", "video", "videos"), "Video"),
    **dict.fromkeys(("notated", "score", "scores"), "Score"), **dict.fromkeys(("photograph", "photographs", "still"), "Image"), "software": "Software", "sound": "Audio",
}
TEXTS = {**dict.fromkeys(("article", "articles"), "Article"), **dict.fromkeys(("book", "books"), "Book"), **dict.fromkeys(("conference", "conferences"), "Conference paper"), **dict.fromkeys(("dissertation", "dissertations", "theses", "thesis"), "Thesis"), **dict.fromkeys(("report", "reports"), "Report")}
# Codes of MARC 21 that name a record format, by their vocabulary.
CONTENT_TYPES = {"cod": "Dataset", "cop": "Software"}  # 336$b: computer dataset, computer program
RECORD_TYPES = {"c": "Score", "d": "Score", "e": "Map", "f": "Map", "g": "Video", "i": "Audio", "j": "Audio", "k": "Image", "t": "Manuscript"}  # leader, position 6
LEVELS_OF_RECORDS = {"a": "Book chapter", "b": "Article", "i": "Website", "s": "Serial"}  # leader, position 7: parts, integrating resources, serials
LEVEL_ALIASES = {"recordgrp": "record-group", "recordgroup": "record-group", "subfonds": "subseries", "record-series": "series"}
ATOM_LEVELS = {x: x.replace("-", " ").capitalize() for x in LEVELS}


def lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A map of fixed size as one expression."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def online_book(fmt: Column, online: Column) -> Column:
    return F.when((fmt == "Book") & online, "Online book").otherwise(fmt)


def exact_format(value: Column) -> Column:
    """The record format that a declared value names, in any case; null if none."""
    return lookup(F.lower(F.trim(value)), {x.lower(): x for x in RECORD_FORMATS})


def format_from_text(value: Column) -> Column:
    return F.coalesce(exact_format(value), F.lit("Other"))


def format_from_csl(kind: Column, online: Column) -> Column:
    return online_book(lookup(F.lower(F.trim(kind)), CSL_IN, "Other"), online)


def format_from_schema(kind: Column, online: Column) -> Column:
    """The format of a schema.org class, with or without its address."""
    return online_book(lookup(F.lower(F.regexp_replace(kind, r"^\s*(https?://schema\.org/|schema:)?|\s+$", "")), SCHEMA_IN, "Other"), online)


def format_from_ris(kind: Column) -> Column:
    return lookup(F.upper(kind), RIS_IN, "Other")


def format_from_bibtex(kind: Column) -> Column:
    return lookup(F.lower(kind), BIBTEX_IN, "Other")


def format_from_mods(kind: Column, genres: Column, online: Column) -> Column:
    """The first word of the resource type and the genres that names a material, else a kind of text; plain text is a book."""
    words = F.split(F.lower(F.concat_ws(" ", kind, F.array_join(genres, " "))), "[^a-z]+")
    first = lambda table: F.get(F.array_compact(F.transform(words, lambda w: lookup(w, table))), F.lit(0))
    plain = F.when(F.lower(kind) == "text", "Book").otherwise("Other")
    return online_book(F.coalesce(first(MATERIALS), first(TEXTS), plain), online)


def format_from_marc(trace: Column, genres: Column, declared: Column) -> Column:
    """What the record declares, else what its most specific evidence says: genre terms, content type, type of record (of
    mixed material: a collection), bibliographic level, text on an online carrier, the local code; else a book."""
    t = lambda k: F.try_element_at(trace, F.lit(k))
    said = F.get(F.array_compact(F.transform(declared, exact_format)), F.lit(0))
    film = F.when(F.exists(genres, lambda g: g.rlike("(?i)video|motion picture")), "Video")
    collection = F.when((t("LDR/06") == "p") & (t("LDR/07") == "c"), "Archival collection")
    online = F.when((t("336$b") == "txt") & (t("338$b") == "cr"), "Online book")
    local = F.when(t("999$a") == "VID", "Video")
    return F.coalesce(said, film, lookup(t("336$b"), CONTENT_TYPES), lookup(t("LDR/06"), RECORD_TYPES), collection, lookup(t("LDR/07"), LEVELS_OF_RECORDS), online, local, F.lit("Book"))


def to_ris(fmt: Column) -> Column:
    return lookup(fmt, RIS_OUT, "GEN")


def to_bibtex(fmt: Column) -> Column:
    return lookup(fmt, BIBTEX_OUT, "misc")


def to_csl(fmt: Column) -> Column:
    return lookup(fmt, CSL_OUT, "document")


def to_schema(fmt: Column) -> Column:
    return lookup(fmt, SCHEMA_OUT, "CreativeWork")


def to_mods(fmt: Column) -> Column:
    return lookup(fmt, MODS_OUT, "mixed material")


def level_in(value: Column, other: Column) -> Column:
    """Archival level of a foreign spelling; null if it is not supported."""
    raw = F.coalesce(F.nullif(value, F.lit("")), F.lit("other"))
    named = F.when(F.lower(F.trim(raw)) == "otherlevel", F.coalesce(F.nullif(other, F.lit("")), F.lit("other"))).otherwise(raw)
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(named)), r"\s+of\s+description$", ""), "[ _]+", "-")
    return F.when(key.isin(*LEVELS), key).otherwise(lookup(key, LEVEL_ALIASES))


def level_ead4(level: Column) -> Column:
    return F.when(level == "record-group", "recordGroup").otherwise(level)


def level_legacy(level: Column) -> Column:
    return F.when(level == "record-group", "recordgrp").when(level.isin("repository", "other"), "otherlevel").otherwise(level)


def level_atom(level: Column) -> Column:
    return lookup(level, ATOM_LEVELS)


def availability_default(availability: Column, links: Column) -> Column:
    given = lookup(F.lower(availability), {x.lower(): x for x in AVAILABILITY})
    return F.coalesce(given, F.when(F.size(links) > 0, "Online").otherwise("Check availability"))


def is_suppressed(status_999s: Column, note_852x: Column) -> Column:
    return F.exists(F.concat(status_999s, note_852x), lambda x: x.rlike("(?i)suppres|withdrawn"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def service_of_finding(code: Column) -> Column:
    return F.when(code.rlike("URL|DOI"), "Electronic access").when(code.contains("REQUEST"), "Fulfillment").otherwise("Discovery metadata")


def action_of_finding(code: Column) -> Column:
    """A short code of what to do next about a finding."""
    named = {"SUPPRESSION_LEAK": "unpublish-and-recount", "REQUEST_MISMATCH": "trace-item-and-policy", "FORMAT_CONFLICT": "compare-source-fields", "URL_UNSAFE": "quarantine-and-replace-link"}
    return F.coalesce(lookup(code, named), F.when(code.contains("DUPLICATE"), "compare-editions").otherwise("verify-and-correct"))
