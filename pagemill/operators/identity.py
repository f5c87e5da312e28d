"""Identity of papers from the records of several providers, and the choice of a full text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import text as X

IDS = ("pmid", "pmcid", "doi")
#: Routes that need nobody (fixed values).
AUTOMATIC = ("clipper_core", "mineru")
RELEVANT, HIGH, LEAD, BEST = 0.65, 0.92, 0.08, 5


def with_tokens(records: DataFrame) -> DataFrame:
    """Adds the normalized title and its tokens."""
    return records.withColumn("title_norm", X.normalize_title(F.col("title"))).withColumn("title_tokens", X.title_tokens(F.col("title_norm")))


def identifier_conflict(a: str, b: str) -> Column:
    """Whether an identifier is on both sides and differs."""
    out = F.lit(False)
    for k in IDS:
        out = out | F.coalesce(F.lower(f"{a}.{k}") != F.lower(f"{b}.{k}"), F.lit(False))
    return out


def shared_identifier(a: str, b: str) -> Column:
    """Whether an identifier is on both sides and equal."""
    out = F.lit(False)
    for k in IDS:
        out = out | F.coalesce(F.lower(f"{a}.{k}") == F.lower(f"{b}.{k}"), F.lit(False))
    return out


def metadata_conflict(a: str, b: str) -> Column:
    """Whether years differ by more than one or titles are not alike."""
    years = F.coalesce(F.abs(F.col(f"{a}.year") - F.col(f"{b}.year")) > 1, F.lit(False))
    titles = F.coalesce((F.length(f"{a}.title") > 0) & (F.length(f"{b}.title") > 0) & (X.dice(F.col(f"{a}.title_tokens"), F.col(f"{b}.title_tokens")) < RELEVANT), F.lit(False))
    return years | titles


def rank_sources(sources: DataFrame) -> DataFrame:
    """Sources of each paper, one for each URL (the one of least priority number, the first of these), in order: adds ``rank``."""
    one = Window.partitionBy("paper_id", "url").orderBy("priority", "pos")
    order = Window.partitionBy("paper_id").orderBy("priority", "provider", "format", "url")
    return sources.withColumn("__r", F.row_number().over(one)).filter("__r = 1").drop("__r").withColumn("rank", F.row_number().over(order))


def plan_acquisition(sources: DataFrame) -> DataFrame:
    """How to get each paper: paper_id, plan, source_id, alternatives, requires_confirmation.

    The first source that needs neither a browser session nor a permission and has an
    automatic route; else the extension if any source is left; else unavailable.
    """
    ranked = rank_sources(sources)
    free = ~F.col("requires_browser_session") & ~F.col("requires_domain_permission") & F.col("acquisition_route").isin(*AUTOMATIC)
    per = ranked.groupBy("paper_id").agg(
        F.min_by(F.when(free, F.struct("source_id", "format")), F.when(free, F.col("rank"))).alias("auto"), F.min_by("source_id", "rank").alias("first"), F.count("*").alias("n")
    )
    kind = F.when(F.col("auto.format") == "xml", "pmc_xml").when(F.col("auto.format") == "pdf", "public_pdf").when(F.col("auto").isNotNull(), "public_html").otherwise("browser_extension")
    return per.select(
        "paper_id", kind.alias("plan"), F.coalesce("auto.source_id", "first").alias("source_id"), (F.col("n") - 1).alias("alternatives"),
        F.coalesce(F.col("auto.format") == "pdf", F.lit(True)).alias("requires_confirmation"),
    )


RANKED = "query string, rank int, title string, year int, pmid string, pmcid string, doi string, title_similarity double, providers array<string>, sure boolean"


def _dice(a: set[str], b: set[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def rank_candidates(records: DataFrame) -> DataFrame:
    """Candidates of each query, records of one paper merged: rank, identity, similarity, providers, and whether the first is sure.

    A record joins the first group with which it shares an identifier and conflicts
    in nothing; the order of the records decides, so a query's records, which are a
    few for each provider, are taken in order in one step.
    """
    relevant = with_tokens(records).withColumn("query_tokens", X.title_tokens(X.normalize_title(F.col("query"))))
    cols = ["query", "provider", "pos", "title", "year", *IDS, "title_norm", "title_tokens", "query_tokens"]
    relevant = relevant.filter(X.dice(F.col("title_tokens"), F.col("query_tokens")) >= RELEVANT).select(*cols)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        low = lambda x: x.lower() if isinstance(x, str) else None
        for r in pdf.sort_values(["pos", "provider"]).to_dict("records"):
            ids = {k: low(r[k]) for k in IDS}
            year = None if pd.isna(r["year"]) else int(r["year"])
            tokens = set(r["title_tokens"])

            def fits(g: dict) -> bool:
                both = [(g["ids"][k], ids[k]) for k in IDS if g["ids"][k] and ids[k]]
                apart = g["year"] and year and abs(g["year"] - year) > 1
                return bool(both) and all(a == b for a, b in both) and not apart and _dice(g["tokens"], tokens) >= RELEVANT

            got = next((g for g in groups if fits(g)), None)
            if got is None:
                groups.append({"title": r["title"], "norm": r["title_norm"], "tokens": tokens, "year": year, "ids": ids, "raw": {k: r[k] if isinstance(r[k], str) else None for k in IDS}, "providers": {r["provider"]}})
            else:
                got["year"] = got["year"] or year
                got["providers"].add(r["provider"])
                for k in IDS:
                    if not got["ids"][k]:
                        got["ids"][k], got["raw"][k] = ids[k], r[k] if isinstance(r[k], str) else None
        if not groups:
            return pd.DataFrame(columns=[x.split()[0] for x in RANKED.split(", ")])
        asked = set(pdf["query_tokens"].iloc[0])
        for g in groups:
            g["s"] = round(_dice(asked, g["tokens"]), 4)
        best = sorted(groups, key=lambda g: (-g["s"], -len(g["providers"]), g["ids"]["doi"] or "", g["title"]))[:BEST]
        exact = lambda g: g["norm"] == norm
        norm = " ".join(X.fold_python(pdf["query"].iloc[0]).split())
        top = best[0]
        sure = top["s"] >= HIGH and len(top["providers"]) >= 2 and any(top["ids"].values()) and (len(best) == 1 or round(top["s"] - best[1]["s"], 6) >= LEAD or (exact(top) and not exact(best[1])))
        return pd.DataFrame(
            [
                {"query": pdf["query"].iloc[0], "rank": i + 1, "title": g["title"], "year": g["year"], **g["raw"], "title_similarity": g["s"], "providers": sorted(g["providers"]), "sure": bool(sure and i == 0)}
                for i, g in enumerate(best)
            ]
        ).astype({"year": "Int32"})

    return relevant.groupBy("query").applyInPandas(group, RANKED)
