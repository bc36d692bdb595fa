"""Small dimension tables: service fields, archival core fields, MARC and RIS names, format rules, sample records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fields of service records: area, kind of record, field, kind of value, required, repeatable.
SERVICE_FIELDS = [
    ("collections", "collection-policy", "scope", "long-text", True, False),
    ("collections", "collection-policy", "audience", "text", True, True),
    ("collections", "collection-policy", "selection_roles", "text", False, False),
    ("collections", "collection-policy", "review_cycle_months", "integer", False, False),
    ("collections", "collection-policy", "exclusions", "long-text", False, False),
    ("collections", "collection-fund", "fiscal_year", "text", True, False),
    ("collections", "collection-fund", "fund_code", "identifier", True, False),
    ("collections", "collection-fund", "allocation", "decimal", True, False),
    ("collections", "collection-fund", "committed", "decimal", False, False),
    ("collections", "collection-fund", "currency", "controlled-term", True, False),
    ("collections", "collection-fund", "notes", "long-text", False, False),
    ("electronic-resources", "resource-entitlement", "provider", "text", True, False),
    ("electronic-resources", "resource-entitlement", "platform", "text", True, False),
    ("electronic-resources", "resource-entitlement", "coverage_start", "date", False, False),
    ("electronic-resources", "resource-entitlement", "coverage_end", "date", False, False),
    ("electronic-resources", "resource-entitlement", "access_model", "controlled-term", True, False),
    ("electronic-resources", "resource-entitlement", "authentication", "controlled-term", True, False),
    ("electronic-resources", "resource-entitlement", "license_uri", "uri", False, False),
    ("electronic-resources", "resource-entitlement", "renewal_date", "date", False, False),
    ("electronic-resources", "resource-entitlement", "perpetual_access", "boolean", False, False),
    ("electronic-resources", "resource-entitlement", "counter_supported", "boolean", False, False),
    ("electronic-resources", "license-obligation", "agreement_id", "identifier", True, False),
    ("electronic-resources", "license-obligation", "licensor", "text", True, False),
    ("electronic-resources", "license-obligation", "effective_on", "date", False, False),
    ("electronic-resources", "license-obligation", "expires_on", "date", False, False),
    ("electronic-resources", "license-obligation", "authorized_users", "long-text", False, False),
    ("electronic-resources", "license-obligation", "interlibrary_loan", "long-text", False, False),
    ("electronic-resources", "license-obligation", "text_mining", "long-text", False, False),
    ("electronic-resources", "license-obligation", "termination", "long-text", False, False),
    ("electronic-resources", "license-obligation", "notes", "long-text", False, False),
    ("discovery", "discovery-profile", "index_name", "identifier", True, False),
    ("discovery", "discovery-profile", "source_system", "text", True, False),
    ("discovery", "discovery-profile", "mapping_version", "identifier", True, False),
    ("discovery", "discovery-profile", "facets", "text", False, True),
    ("discovery", "discovery-profile", "suppression_rule", "long-text", True, False),
    ("discovery", "discovery-profile", "last_reindex", "date-time", False, False),
    ("discovery", "link-routing", "resolver_target", "uri", True, False),
    ("discovery", "link-routing", "knowledge_base", "text", True, False),
    ("discovery", "link-routing", "proxy_rule", "identifier", False, False),
    ("discovery", "link-routing", "test_identifier", "identifier", True, False),
    ("discovery", "link-routing", "expected_route", "long-text", True, False),
    ("discovery", "link-routing", "last_verified", "date-time", False, False),
    ("preservation", "condition-assessment", "object_identifier", "identifier", True, False),
    ("preservation", "condition-assessment", "material_type", "text", True, False),
    ("preservation", "condition-assessment", "condition_rating", "controlled-term", True, False),
    ("preservation", "condition-assessment", "hazards", "text", False, True),
    ("preservation", "condition-assessment", "housing", "text", False, False),
    ("preservation", "condition-assessment", "assessed_on", "date", True, False),
    ("preservation", "condition-assessment", "next_review", "date", False, False),
    ("preservation", "preservation-action", "action_type", "controlled-term", True, False),
    ("preservation", "preservation-action", "object_identifier", "identifier", True, False),
    ("preservation", "preservation-action", "performed_on", "date", True, False),
    ("preservation", "preservation-action", "agent_role", "text", True, False),
    ("preservation", "preservation-action", "action_note", "long-text", True, False),
    ("preservation", "preservation-action", "before_checksum", "checksum", False, False),
    ("preservation", "preservation-action", "after_checksum", "checksum", False, False),
    ("preservation", "preservation-action", "storage_location", "text", False, False),
    ("technical-services", "acquisition-order", "order_id", "identifier", True, False),
    ("technical-services", "acquisition-order", "vendor", "text", True, False),
    ("technical-services", "acquisition-order", "fund_code", "identifier", False, False),
    ("technical-services", "acquisition-order", "ordered_on", "date", True, False),
    ("technical-services", "acquisition-order", "received_on", "date", False, False),
    ("technical-services", "acquisition-order", "order_status", "controlled-term", True, False),
    ("technical-services", "acquisition-order", "invoice_reference", "identifier", False, False),
    ("technical-services", "metadata-job", "job_name", "text", True, False),
    ("technical-services", "metadata-job", "source_format", "text", True, False),
    ("technical-services", "metadata-job", "target_format", "text", True, False),
    ("technical-services", "metadata-job", "mapping_version", "identifier", True, False),
    ("technical-services", "metadata-job", "authority_sources", "text", False, True),
    ("technical-services", "metadata-job", "record_count", "integer", False, False),
    ("technical-services", "metadata-job", "last_run", "date-time", False, False),
    ("technical-services", "metadata-job", "rollback_reference", "identifier", False, False),
    ("special-collections", "accession", "accession_number", "identifier", True, False),
    ("special-collections", "accession", "source_type", "controlled-term", True, False),
    ("special-collections", "accession", "received_on", "date", True, False),
    ("special-collections", "accession", "extent", "text", True, False),
    ("special-collections", "accession", "deed_status", "controlled-term", False, False),
    ("special-collections", "accession", "restrictions", "long-text", False, False),
    ("special-collections", "accession", "processing_priority", "controlled-term", False, False),
    ("special-collections", "processing-plan", "collection_identifier", "identifier", True, False),
    ("special-collections", "processing-plan", "processing_level", "controlled-term", True, False),
    ("special-collections", "processing-plan", "arrangement", "long-text", True, False),
    ("special-collections", "processing-plan", "description_standard", "text", True, False),
    ("special-collections", "processing-plan", "estimated_hours", "decimal", False, False),
    ("special-collections", "processing-plan", "born_digital", "boolean", False, False),
    ("special-collections", "processing-plan", "target_completion", "date", False, False),
    ("data-services", "dataset-custody", "persistent_id", "identifier", True, False),
    ("data-services", "dataset-custody", "repository", "text", True, False),
    ("data-services", "dataset-custody", "steward_role", "text", True, False),
    ("data-services", "dataset-custody", "media_type", "media-type", False, False),
    ("data-services", "dataset-custody", "checksum", "checksum", False, False),
    ("data-services", "dataset-custody", "retention_rule", "long-text", True, False),
    ("data-services", "dataset-custody", "access_level", "controlled-term", True, False),
    ("data-services", "dataset-custody", "embargo_until", "date", False, False),
    ("data-services", "data-management-plan", "project_identifier", "identifier", True, False),
    ("data-services", "data-management-plan", "funder", "text", False, False),
    ("data-services", "data-management-plan", "storage_tier", "text", True, False),
    ("data-services", "data-management-plan", "backup_schedule", "text", True, False),
    ("data-services", "data-management-plan", "file_formats", "text", True, True),
    ("data-services", "data-management-plan", "retention_period", "text", True, False),
    ("data-services", "data-management-plan", "rights_basis", "long-text", False, False),
    ("rare-materials", "copy-provenance", "shelfmark", "identifier", True, False),
    ("rare-materials", "copy-provenance", "imprint", "text", True, False),
    ("rare-materials", "copy-provenance", "copy_note", "long-text", True, False),
    ("rare-materials", "copy-provenance", "provenance_events", "text", False, True),
    ("rare-materials", "copy-provenance", "binding", "text", False, False),
    ("rare-materials", "copy-provenance", "marks", "text", False, True),
    ("rare-materials", "copy-provenance", "cataloging_standard", "text", False, False),
    ("rare-materials", "copy-provenance", "verified_on", "date", False, False),
    ("rare-materials", "conservation-treatment", "object_identifier", "identifier", True, False),
    ("rare-materials", "conservation-treatment", "treatment_type", "text", True, False),
    ("rare-materials", "conservation-treatment", "condition_before", "long-text", True, False),
    ("rare-materials", "conservation-treatment", "materials_used", "text", False, True),
    ("rare-materials", "conservation-treatment", "treatment_date", "date", True, False),
    ("rare-materials", "conservation-treatment", "conservator_role", "text", True, False),
    ("rare-materials", "conservation-treatment", "aftercare", "long-text", False, False),
    ("rare-materials", "conservation-treatment", "next_review", "date", False, False),
]
# The terms of controlled fields.
VOCABULARIES = {
    "currency": ["USD", "CAD", "EUR", "GBP", "AUD"],
    "access_model": ["subscription", "perpetual", "evidence-based", "demand-driven", "open-access", "consortial"],
    "authentication": ["ip", "proxy", "saml", "openid-connect", "library-card", "public"],
    "condition_rating": ["stable", "monitor", "treatment-needed", "do-not-handle"],
    "action_type": ["treatment", "rehousing", "stabilization", "digitization", "migration", "normalization", "fixity-check"],
    "order_status": ["requested", "approved", "ordered", "partially-received", "received", "cancelled", "claimed"],
    "source_type": ["transfer", "gift", "purchase", "deposit", "unknown"],
    "deed_status": ["not-required", "pending", "executed", "incomplete", "unknown"],
    "processing_priority": ["low", "normal", "high", "urgent"],
    "processing_level": ["collection", "series", "file", "item", "minimal"],
    "access_level": ["open", "campus", "mediated", "embargoed", "restricted"],
}
AREAS = tuple(dict.fromkeys(area for area, *_ in SERVICE_FIELDS))
SERVICE_STATES = ("active", "review", "due", "blocked", "retired")
SENSITIVITIES = ("public", "internal", "restricted")

# Core fields of archival description and where exchange formats keep them.
CORE = [
    ("reference_code", "identifier", True, False, "unitId", "unit_id", "identifier", "identifier"),
    ("title", "text", True, False, "unitTitle", "title", "title", "name"),
    ("dates", "edtf", False, True, "unitDate", "dates", "eventDates", "date"),
    ("creator", "text", False, True, "agents", "creators", "eventActors", "hasOrHadAgent"),
    ("extent", "text", False, True, "extent", "extents", "extentAndMedium", "quantity"),
    ("scope_content", "long-text", False, False, "scopeContent", "n_scopecontent", "scopeAndContent", "scope"),
    ("arrangement", "long-text", False, False, "arrangement", "n_arrangement", "arrangement", "classification"),
    ("access_conditions", "long-text", False, False, "accessConditions", "n_accessrestrict", "accessConditions", "conditionsOfAccess"),
    ("use_conditions", "long-text", False, False, "useConditions", "n_userestrict", "reproductionConditions", "conditionsOfUse"),
    ("language", "language-code", False, True, "languageOfMaterial", "language_of_material", "language", "language"),
    ("repository", "text", False, False, "repository", "repository", "repository", "isOrWasHeldBy"),
    ("subjects", "controlled-term", False, True, "subjectHeadings", "subjects", "subjectAccessPoints", "hasOrHadSubject"),
    ("related_material", "long-text", False, True, "relatedMaterial", "n_relatedmaterial", "relatedUnitsOfDescription", "hasOrHadRelation"),
    ("digital_object_uri", "uri", False, True, "formsAvailable", "digital_object_uri", "digitalObjectURI", "digitalInstantiation"),
    ("note", "long-text", False, True, "otherDescription", "n_odd", "generalNote", "descriptiveNote"),
]
PROFILES = ("blank", "dacs", "ead4", "ead3", "ead2002", "archives-space", "atom", "ric")

# Names of source fields.
FIELD_NAMES = {
    "marc": {"LDR": "Leader", "001": "Control number", "003": "Control number source", "008": "Fixed-length data", "020": "ISBN", "022": "ISSN", "024": "Other identifier", "041": "Language", "100": "Main personal name", "245": "Title", "250": "Edition", "260": "Publication", "264": "Production or publication", "300": "Extent", "336": "Content type", "337": "Media type", "338": "Carrier type", "500": "Note", "520": "Summary", "650": "Subject", "655": "Genre", "700": "Added personal name", "720": "Added name", "852": "Location", "856": "Electronic access", "999": "Local data"},
    "ris": {"TY": "Type", "ID": "Identifier", "TI": "Title", "T1": "Title", "AU": "Author", "A1": "Author", "A2": "Editor", "PY": "Year", "Y1": "Year", "PB": "Publisher", "CY": "Place", "LA": "Language", "ET": "Edition", "T2": "Container title", "T3": "Series", "VL": "Volume", "IS": "Issue", "SP": "First page", "EP": "Last page", "KW": "Keyword", "AB": "Abstract", "N2": "Abstract", "N1": "Note", "C1": "Rights", "DO": "DOI", "SN": "ISBN or ISSN", "UR": "Link", "M3": "Declared type", "ER": "End of record"},
    "dc": {e: e.capitalize() for e in ("title", "creator", "contributor", "publisher", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights", "subject", "description")},
}


def service_fields(spark: SparkSession) -> DataFrame:
    """(area, schema_id, field_id, kind, required, repeatable, vocabulary); schema_id is the kind of record."""
    rows = [(*row, VOCABULARIES.get(row[2], [])) for row in SERVICE_FIELDS]
    return spark.createDataFrame(rows, "area string, schema_id string, field_id string, kind string, required boolean, repeatable boolean, vocabulary array<string>")


def archive_template(spark: SparkSession, schema_id: str, profile: str) -> DataFrame:
    """Field definitions of a new schema: two fields for a blank profile, else the core."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    core = CORE[:2] if profile == "blank" else CORE
    rows = [(schema_id, i, f, f.replace("_", " ").capitalize(), *rest[:3], [], *rest[3:]) for i, (f, *rest) in enumerate(core)]
    return spark.createDataFrame(rows, "schema_id string, position int, field_id string, label string, kind string, required boolean, repeatable boolean, vocabulary array<string>, map_ead string, map_aspace string, map_atom string, map_ric string")


def service_template(spark: SparkSession, kind: str, record_id: str) -> DataFrame:
    """A new service record with its defaults."""
    area = next(a for a, k, *_ in SERVICE_FIELDS if k == kind)
    return spark.createDataFrame([(record_id, kind, area, "", "review", "", "", "internal")], "id string, kind string, area string, title string, state string, owner_role string, system string, sensitivity string")


def field_names(spark: SparkSession, family: str) -> DataFrame:
    return spark.createDataFrame(list(FIELD_NAMES[family].items()), "code string, name string")


def format_rules(spark: SparkSession) -> DataFrame:
    """(format, extension, lossless, keeps_evidence) of all exchange formats."""
    rows = [("packet-json", "json", True, False), ("csv", "csv", True, False), ("tsv", "tsv", True, False), ("dcxml", "xml", False, False), ("modsxml", "xml", False, False), ("csl-json", "json", False, False), ("jsonld", "jsonld", False, False), ("ris", "ris", False, False), ("bibtex", "bib", False, False), ("marc-text", "mrk", False, False)]
    return spark.createDataFrame(rows, "format string, extension string, lossless boolean, keeps_evidence boolean")


def sample_catalog(spark: SparkSession) -> DataFrame:
    """Six synthetic records, each with one defect or none."""
    ident = "array<struct<scheme:string,value:string>>"
    isbn = [("isbn", "9780306406157")]
    rows = [
        ("S-1", "First sample", "Book", isbn, [], "Available", "Stacks", True, True, True, {}),
        ("S-2", "Second sample", "Book", isbn, [], "Available", "Stacks", False, True, False, {}),
        ("S-3", "Moving sample", "Video", [], [], "Online", "Online", False, True, True, {"336$b": "txt", "338$b": "cr"}),
        ("S-4", "Same sample", "Map", [], [], "Available", "Maps", False, True, True, {}),
        ("S-5", "Same Sample!", "Map", [], [], "Available", "Maps", False, True, True, {}),
        ("S-6", "Clean sample", "Online book", [("doi", "10.1234/clean")], ["https://example.org/clean"], "Online", "Online", False, True, False, {}),
    ]
    schema = f"id string, title string, format string, identifiers {ident}, links array<string>, availability string, location string, suppressed boolean, public_visible boolean, requestable boolean, trace map<string,string>"
    return spark.createDataFrame(rows, schema).selectExpr("*", "true as synthetic", "array() as creators")
