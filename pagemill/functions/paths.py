"""Path, identifier and URL predicates as Column expressions; they fail closed."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import patterns as P
from pagemill.functions.text import nfkc, trim


def is_safe_relative(c: Column) -> Column:
    """No backslash, drive or leading slash, and no empty, ``.`` or ``..`` segment; false for null."""
    parts = F.split(c, "/")
    return F.coalesce(
        (F.length(c) > 0) & ~c.rlike(r"\\|^[a-zA-Z]:|^/") & F.forall(parts, lambda s: (s != "") & (s != ".") & (s != "..")), F.lit(False)
    )


def is_safe_package_path(c: Column) -> Column:
    """A path that may stand in a package: at most 24 segments of at most 255 characters, without names that a file system treats apart."""
    parts = F.split(c, "/")
    ok = lambda s: (s != "") & (s != ".") & (s != "..") & (F.length(s) <= 255) & ~s.rlike(P.BAD_SEGMENT)
    return F.coalesce((F.length(c) > 0) & (c == trim(c)) & ~c.rlike(r"\\|\x{00}|^/") & (F.size(parts) <= 24) & F.forall(parts, ok), F.lit(False))


def path_key(c: Column) -> Column:
    """Key under which two paths collide: compatibility form in lower case."""
    return F.lower(nfkc(c))


@F.pandas_udf(T.StringType())
def percent_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Percent-decoded text; null if an escape or the resulting bytes are malformed. A plus stays."""
    import re

    bad = re.compile(r"%(?![0-9A-Fa-f]{2})")

    def one(s: str | None) -> str | None:
        if s is None or "%" not in s:
            return s
        if bad.search(s):
            return None
        try:
            return unquote_to_bytes(s).decode("utf-8")
        except UnicodeDecodeError:
            return None

    for s in batches:
        yield s.map(one, na_action="ignore")


def asset_path(c: Column) -> Column:
    """Path of a local asset, or null: decoded, slashes forward, no ``./``, scheme, root, ``..`` or NUL."""
    bare = F.regexp_replace(trim(c), r"^<|>$", "")
    decoded = F.when(bare.contains("%"), percent_decode(F.when(bare.contains("%"), bare))).otherwise(bare)
    v = F.regexp_replace(F.replace(decoded, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return F.when((F.length(v) > 0) & ~v.rlike(r"\x{00}|^/") & ~v.rlike(P.SCHEME) & ~F.array_contains(F.split(v, "/"), ".."), v)


def is_opaque_id(c: Column) -> Column:
    return F.coalesce(c.rlike(P.OPAQUE_ID), F.lit(False))


def is_private_ipv4(host: Column) -> Column:
    """Whether a dotted host is a private or reserved IPv4 address; false for names."""
    part = lambda i: F.try_element_at(F.split(host, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    v4 = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    reserved = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19, 51)) | ((a == 203) & (b == 0))
    )
    return v4 & reserved


def url_parts(c: Column) -> dict[str, Column]:
    get = lambda i: F.regexp_extract(c, P.URL, i)
    authority = get(2)
    return {
        "ok": c.rlike(P.URL), "scheme": F.lower(get(1)), "credentials": authority.contains("@"),
        "host": F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d+$", "")),
        "port": F.regexp_extract(authority, r":(\d+)$", 1), "path": get(3), "query": get(4),
    }


def is_fetchable_url(c: Column) -> Column:
    """An http(s) URL without credentials on a public dotted host."""
    u = url_parts(c)
    host = u["host"]
    public = host.contains(".") & ~host.rlike(r"^\[|(?:^|\.)localhost$|\.local$") & ~is_private_ipv4(host)
    return F.coalesce(u["ok"] & ~u["credentials"] & public, F.lit(False))


def public_https_url(c: Column) -> Column:
    """The URL without fragment if it is https, at most 4096 characters, without credentials and on a public host; else null."""
    t = trim(c)
    u = url_parts(t)
    return F.when((F.length(t) <= 4096) & is_fetchable_url(t) & (u["scheme"] == "https"), F.regexp_replace(t, r"#[\s\S]*$", ""))


def paper_query(c: Column) -> Column:
    """Kind and value of a paper query: pmcid, pmid, doi, url or title; kind ``error`` and the reason else.

    A URL that bears an identifier counts as that identifier; other URLs lose their
    fragment. A null text is an error.
    """
    t = trim(c)
    u = url_parts(t)
    host, path = u["host"], F.when(u["path"].contains("%"), percent_decode(F.when(u["path"].contains("%"), u["path"]))).otherwise(u["path"])
    ncbi = F.regexp_extract(path, r"(?i)^/pubmed/(\d{1,9})/?$", 1)
    pubmed = F.regexp_extract(path, r"^/(\d{1,9})/?$", 1)
    pmc = F.upper(F.regexp_extract(path, r"(?i)^/articles/(PMC\d+)/?$", 1))
    euro = F.upper(F.regexp_extract(path, r"(?i)^/(?:articles|article/PMC)/(PMC\d+)/?$", 1))
    med = F.regexp_extract(path, r"(?i)^/article/MED/(\d{1,9})/?$", 1)
    doi_path = F.regexp_replace(path, r"^/+", "")
    doi = lambda x: F.lower(F.regexp_replace(F.regexp_extract(x, P.DOI, 1), r"[.,;]+$", ""))
    out = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    fail = lambda why: out("error", F.lit(why))
    is_doi_host = host.isin("doi.org", "dx.doi.org")
    return (
        F.when(t.isNull() | (F.length(t) == 0) | (F.length(t) > 2048) | t.rlike(r"[\x{00}-\x{1F}\x{7F}]"), fail("length"))
        .when(t.rlike(P.PMCID), out("pmcid", F.upper(F.regexp_extract(t, P.PMCID, 1))))
        .when(t.rlike(P.PMID), out("pmid", F.regexp_extract(t, P.PMID, 1)))
        .when(t.rlike(P.DOI), out("doi", doi(t)))
        .when(t.rlike(P.ID_PREFIX), fail("identifier"))
        .when(u["ok"] & u["credentials"], fail("url"))
        .when(u["ok"] & path.isNull(), fail("encoding"))
        .when(u["ok"] & is_doi_host & doi_path.rlike(P.DOI), out("doi", doi(doi_path)))
        .when(u["ok"] & is_doi_host, fail("doi"))
        .when(u["ok"] & (host == "pubmed.ncbi.nlm.nih.gov") & (pubmed != ""), out("pmid", pubmed))
        .when(u["ok"] & host.isin("ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov") & (ncbi != ""), out("pmid", ncbi))
        .when(u["ok"] & (host == "pmc.ncbi.nlm.nih.gov") & (pmc != ""), out("pmcid", pmc))
        .when(u["ok"] & host.isin("europepmc.org", "www.europepmc.org") & (euro != ""), out("pmcid", euro))
        .when(u["ok"] & host.isin("europepmc.org", "www.europepmc.org") & (med != ""), out("pmid", med))
        .when(u["ok"], out("url", F.regexp_replace(t, r"#[\s\S]*$", "")))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), fail("url"))
        .when(F.length(F.regexp_replace(t, rf"{P.WS}+", " ")) < 4, fail("title"))
        .otherwise(out("title", F.regexp_replace(t, rf"{P.WS}+", " ")))
    )
