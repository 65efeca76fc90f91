"""Column expressions over access logs, error texts, addresses and catalogue records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .names import any_of


def classify_access(stage: Column, status: Column, text: Column) -> Column:
    """``ok``, ``auth-required`` or ``no-range-support`` for one request.

    A status code decides where there is one, else the error text. Only a ranged read can
    lack range support; an authentication problem counts at any stage.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    ranged = F.when(stage == "range-get", "no-range-support").otherwise("ok")
    by_code = F.when(status.isin(*fixed.AUTH_CODES), "auth-required").when(status == 206, "ok").otherwise(ranged)
    by_text = F.when(any_of(low, fixed.LOGIN_MARKERS) | any_of(low, fixed.AUTH_MARKERS), "auth-required").otherwise(ranged)
    return F.when(status.isNotNull(), by_code).otherwise(by_text)


def combine_access(head: Column, ranged: Column) -> Column:
    """The ranged read decides if it went well; else authentication at either stage, else the ranged read."""
    auth = F.coalesce(head == "auth-required", F.lit(False)) | F.coalesce(ranged == "auth-required", F.lit(False))
    return F.when(ranged == "ok", "ok").when(auth, "auth-required").otherwise(ranged)


def range_status(classification: Column) -> Column:
    """The status of finding D1-range for a classification."""
    pairs = [F.lit(x) for kv in fixed.RANGE_STATUS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), classification), F.lit("skipped"))


def looks_like_archive(url: Column) -> Column:
    return any_of(F.lower(url), fixed.ARCHIVE_MARKERS)


def infer_archive(url: Column) -> Column:
    """The short name of the archive that an address points to; the first hint in order wins."""
    low = F.lower(url)
    return reduce(lambda case, x: case.when(F.contains(low, F.lit(x[0])), F.lit(x[1])), fixed.ARCHIVE_OF, F.when(F.lit(False), "")).otherwise(F.lit(None))


def classify_store_error(text: Column) -> Column:
    """``credentials-endpoint-auth``, ``in-region-only`` or ``unknown`` for the text of an error chain."""
    low = F.lower(F.coalesce(text, F.lit("")))
    login = any_of(low, fixed.CREDENTIAL_MARKERS)
    return (
        F.when(any_of(low, fixed.CREDENTIAL_STATUS) & login, "credentials-endpoint-auth")
        .when(any_of(low, fixed.DENIAL_MARKERS) & ~login, "in-region-only").otherwise("unknown")
    )


LINK = "struct<URL:string,Type:string,Description:string>"
RECORD = f"RelatedUrls array<{LINK}>, License string, Abstract string, ScienceKeywords array<string>, ContactPersons array<string>, ContactGroups array<string>"


def related_urls(record: Column) -> Column:
    """From a granule record (JSON): direct S3 addresses, HTTPS addresses and the first credentials endpoint."""
    links = F.coalesce(F.from_json(record, RECORD)["RelatedUrls"], F.array().cast(f"array<{LINK}>"))
    url = lambda x: F.coalesce(x["URL"], F.lit(""))
    s3 = F.filter(links, lambda x: (x["Type"] == "GET DATA VIA DIRECT ACCESS") & url(x).startswith("s3://"))
    https = F.filter(links, lambda x: x["Type"] == "GET DATA")
    login = F.filter(links, lambda x: F.endswith(F.lower(F.regexp_replace(url(x), "/+$", "")), F.lit("/s3credentials")))
    return F.struct(
        F.transform(s3, lambda x: x["URL"]).alias("s3_urls"), F.transform(https, lambda x: x["URL"]).alias("https_urls"),
        F.get(login, F.lit(0))["URL"].alias("credentials_url"),
    )


def catalogue_meta(record: Column) -> Column:
    """License, DOI, contact, documentation links and sizes of keywords and description; null without a record."""
    read = F.from_json(record, RECORD)
    links = F.coalesce(read["RelatedUrls"], F.array().cast(f"array<{LINK}>"))
    docs = F.filter(links, lambda x: F.contains(F.upper(F.coalesce(x["Type"], F.lit(""))), F.lit("DOCUMENTATION")))
    plain = F.get_json_object(record, "$.DOI")
    doi = F.coalesce(F.get_json_object(record, "$.DOI.DOI"), F.when(~plain.startswith("{"), plain))
    contact = (F.coalesce(F.size(read["ContactPersons"]), F.lit(0)) > 0) | (F.coalesce(F.size(read["ContactGroups"]), F.lit(0)) > 0)
    return F.when(
        record.isNotNull(),
        F.struct(
            read["License"].alias("license"), doi.alias("doi"), contact.alias("contact"), F.transform(docs, lambda x: x["URL"]).alias("doc_links"),
            F.greatest(F.lit(0), F.coalesce(F.size(read["ScienceKeywords"]), F.lit(0))).alias("n_keywords"),
            F.coalesce(F.length(read["Abstract"]), F.lit(0)).alias("description_len"),
        ),
    )
