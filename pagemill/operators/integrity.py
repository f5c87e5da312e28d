"""Integrity of packages and contracts: checks as tables of codes, inventories, duplicates and derived states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.paths import is_safe_package_path, path_key
from pagemill.runtime import latest

BLOCK_KINDS = ("title", "heading", "body", "caption", "footnote", "visual_slot", "unknown")
FILE_BYTES, PACKAGE_BYTES = 256 * 1024 * 1024, 768 * 1024 * 1024


def codes(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each key and rule that holds: keys, code. A rule that is null does not hold."""
    held = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(held).alias("code"))


def block_checks(blocks: DataFrame) -> DataFrame:
    """Faults of single blocks against the reader contract: id, code."""
    b = latest(blocks.filter("id is not null"), ["id"])
    slot = F.col("kind") == "visual_slot"
    sha, sim = F.col("fingerprint.visible_text_sha256"), F.col("fingerprint.simhash64")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    span_bad = F.exists(
        "source_spans",
        lambda s: s.isNull() | s["bbox"].isNull() | bad((s["bbox"]["x"] >= 0) & (s["bbox"]["y"] >= 0) & (s["bbox"]["width"] > 0) & (s["bbox"]["height"] > 0)
                                                         & (s["bbox"]["x"] + s["bbox"]["width"] <= 1) & (s["bbox"]["y"] + s["bbox"]["height"] <= 1)) | bad(s["page_index"] >= 0),
    )
    return codes(
        b, ["id"],
        {
            "invalid-block-kind": bad(F.col("kind").isin(*BLOCK_KINDS)),
            "invalid-block-id": bad(F.when(slot, F.col("id").rlike(P.SLOT_ID)).otherwise(F.col("id").rlike(P.BLOCK_ID))),
            "invalid-block-anchor": bad((F.col("anchor.syntax") == F.when(slot, "p2md:slot").otherwise("p2md:block")) & (F.col("anchor.id") == F.col("id"))),
            "invalid-block-fingerprint": bad(sha.rlike(P.SHA256) & sim.rlike(P.HEX16) & (F.col("fingerprint.text_length") >= 0)),
            "invalid-slot-asset": slot & bad(F.col("asset_id").rlike(P.ASSET_ID)),
            "invalid-block-asset": ~slot & F.col("asset_id").isNotNull(),
            "missing-source-span": (F.col("kind") != "title") & (F.coalesce(F.size("source_spans"), F.lit(0)) < 1),
            "invalid-source-span": span_bad,
        },
    )


def contract_checks(blocks: DataFrame) -> DataFrame:
    """Faults of whole contracts: doc_id, code, n."""
    b = latest(blocks.filter("id is not null and doc_id is not null"), ["id"])
    per = b.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "title").alias("titles"), F.min_by("kind", "block_order").alias("first"), F.count("*").alias("blocks"),
        F.countDistinct("block_order").alias("orders"), F.count("block_order").alias("ordered"), F.min("block_order").alias("low"), F.max("block_order").alias("high"),
    )
    title = per.filter(~F.coalesce((F.col("first") == "title") & (F.col("titles") == 1), F.lit(False))).select("doc_id", F.lit("invalid-title-block").alias("code"), F.col("titles").alias("n"))
    order = per.filter((F.col("orders") < F.col("ordered"))).select("doc_id", F.lit("duplicate-block-order").alias("code"), (F.col("ordered") - F.col("orders")).alias("n"))
    reused = b.filter("asset_id is not null").groupBy("doc_id", "asset_id").agg(F.count("*").alias("k")).filter("k > 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    return title.unionByName(order).unionByName(reused.select("doc_id", F.lit("asset-reused").alias("code"), "n"))


def anchor_state(blocks: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """State of each package by its contract and anchors: doc_id, expected, missing, unexpected, repeated, faults, state.

    Expected are the block ids; actual the ids that the anchors name. The first that
    holds: ``invalid-contract`` with a fault of a block or of the contract,
    ``ambiguous`` with repeated or malformed anchors or anchors of no block,
    ``recoverable`` with missing ones, ``edited-with-anchors`` where ``articles``
    (doc_id, recorded, actual digest) says that the text was changed, else ``valid``.
    A package without a block has no row.
    """
    b = latest(blocks.filter("id is not null and doc_id is not null"), ["id"])
    faults = block_checks(b).groupBy("id").agg(F.count("*").alias("faults"))
    own = b.select("doc_id", "id").join(faults, "id").groupBy("doc_id").agg(F.sum("faults").alias("own"))
    whole = contract_checks(b).groupBy("doc_id").agg(F.count("*").alias("whole"))
    named = b.select("doc_id", F.col("anchor.id").alias("id")).filter("id is not null")
    have = named.groupBy("doc_id", "id").agg(F.count("*").alias("h"), F.max((~(F.col("id").rlike(P.BLOCK_ID) | F.col("id").rlike(P.SLOT_ID))).cast("int")).alias("odd"))
    both = b.select("doc_id", "id").withColumn("w", F.lit(1)).join(have, ["doc_id", "id"], "full")
    per = both.groupBy("doc_id").agg(
        F.count("w").alias("expected"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("unexpected"), F.count_if((F.col("h") > 1) | (F.col("odd") > 0)).alias("repeated")
    )
    per = per.join(own, "doc_id", "left").join(whole, "doc_id", "left").withColumn("faults", F.coalesce("own", F.lit(0)) + F.coalesce("whole", F.lit(0))).drop("own", "whole")
    edited = F.lit(False)
    if articles is not None:
        changed = articles.filter(~F.lower("recorded").eqNullSafe(F.lower("actual"))).select("doc_id").distinct().withColumn("edited", F.lit(True))
        per, edited = per.join(changed, "doc_id", "left"), F.coalesce("edited", F.lit(False))
    state = (
        F.when(F.col("faults") > 0, "invalid-contract").when((F.col("repeated") > 0) | (F.col("unexpected") > 0), "ambiguous")
        .when(F.col("missing") > 0, "recoverable").when(edited, "edited-with-anchors").otherwise("valid")
    )
    return per.withColumn("state", state).drop("edited")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """Output files of the manifests: package_id, pos, path, size, sha256."""
    return manifests.filter("package_id is not null").select("package_id", F.posexplode("outputs").alias("pos", "o")).filter("o is not null").select("package_id", "pos", "o.path", "o.size", F.lower("o.sha256").alias("sha256"))


def file_checks(manifests: DataFrame) -> DataFrame:
    """Faults of file records: package_id, pos, code; paths that collide in one package included."""
    f = manifest_files(manifests)
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    own = codes(f, ["package_id", "pos"], {"invalid-path": bad(is_safe_package_path(F.col("path"))), "invalid-size": bad(F.col("size").between(1, FILE_BYTES)), "invalid-hash": bad(F.col("sha256").rlike(P.SHA256))})
    keyed = f.withColumn("k", path_key(F.col("path")))
    twice = keyed.groupBy("package_id", "k").agg(F.count("*").alias("n"), F.collect_list("pos").alias("at")).filter("n > 1").select("package_id", F.explode("at").alias("pos"), F.lit("conflicting-path").alias("code"))
    return own.unionByName(twice)


def package_totals(manifests: DataFrame) -> DataFrame:
    """Files and bytes of each package, and whether they are within the bound."""
    f = manifest_files(manifests)
    return f.groupBy("package_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("within", F.col("bytes") <= PACKAGE_BYTES)


def inventory(manifests: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Differences of the files from the expected ones: package_id, path, side (missing or unexpected)."""
    f = manifest_files(manifests).select("package_id", "path").filter("path is not null").distinct()
    want = manifests.filter("package_id is not null").select("package_id", F.explode(F.array(*map(F.lit, expected))).alias("path")).distinct()
    both = want.withColumn("w", F.lit(1)).join(f.withColumn("h", F.lit(1)), ["package_id", "path"], "full").filter("w is null or h is null")
    return both.select("package_id", "path", F.when(F.col("h").isNull(), "missing").otherwise("unexpected").alias("side"))


def bind(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files as they are against the records of their package: package_id, path, status.

    Both have package_id, path, size and sha256. Status: bound, size-differs,
    hash-differs, missing (recorded only) or unexpected (file only).
    """
    both = records.alias("r").join(files.alias("f"), (F.col("r.package_id") == F.col("f.package_id")) & (F.col("r.path") == F.col("f.path")), "full")
    status = (
        F.when(F.col("f.path").isNull(), "missing").when(F.col("r.path").isNull(), "unexpected").when(~F.col("f.size").eqNullSafe(F.col("r.size")), "size-differs")
        .when(~F.lower("f.sha256").eqNullSafe(F.lower("r.sha256")), "hash-differs").otherwise("bound")
    )
    return both.select(F.coalesce("r.package_id", "f.package_id").alias("package_id"), F.coalesce("r.path", "f.path").alias("path"), status.alias("status"))


def unique_matches(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows that match exactly one row on either side; all others abstain."""
    once = lambda df: df.groupBy(on).agg(F.count("*").alias("__n")).filter("__n = 1").select(on)
    return reduce(lambda x, y: x.join(y, on), [once(left), left, once(right), right])


def decisions(groups: DataFrame) -> DataFrame:
    """Decisions of the groups against their confidence: doc_id, id, decision, confidence, verdict."""
    g = latest(groups.filter("doc_id is not null and id is not null"), ["doc_id", "id"])
    want = F.when(F.col("confidence") >= 0.85, "auto").when(F.col("confidence") >= 0.65, "review").otherwise("skip")
    verdict = F.when(F.col("confidence").isNull() | F.col("decision").isNull(), "incomplete").when(F.col("decision") == want, "valid").otherwise("invalid")
    return g.select("doc_id", "id", "decision", "confidence", verdict.alias("verdict"))


def review_package(candidates: DataFrame, most: int = 128) -> DataFrame:
    """Candidates of each document: doc_id, candidates, status; more than ``most`` is an error, not a cut."""
    c = candidates.filter("doc_id is not null and candidate_id is not null").select("doc_id", "candidate_id", "kind").distinct()
    per = c.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.countDistinct("kind").alias("kinds"))
    return per.withColumn("status", F.when(F.col("candidates") > most, "too-many").otherwise("ready"))


#: Parts of the reader contract (fixed values).
ASSET_KINDS, RELATION_TYPES = ("figure", "table", "equation", "unknown"), ("places", "caption-of")
RELATION_ID, ANY_BLOCK_ID, ASSET_PATH = r"^rel_[0-9a-f]{24}$", r"^(?:blk|slot)_[0-9a-f]{24}$", r"^images/[^/]+\.png$"
#: Names of contracts, without the name of their writer that stands before them, and where the contract lies.
ANCHOR_CONTRACT, FINGERPRINT_CONTRACT, READER_CONTRACT = "markdown-anchor-v0.1", "visible-block-fingerprint-v0.1", "reader-v0.1"
BOUND_MANIFESTS, READER_PATH = ("manifest-v0.8", "manifest-v0.9", "manifest-v0.10"), r"^_[a-z0-9]+/reader\.json$"
ASSET_COUNT, ASSET_BYTES, ALL_ASSET_BYTES = 256, 32 * 1024 * 1024, 256 * 1024 * 1024


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _named(c: Column, *names: str) -> Column:
    """Whether a contract's name is one of these behind its writer's."""
    return F.regexp_extract(c, r"^[a-z0-9]+-(.+)$", 1).isin(*names)


def asset_checks(assets: DataFrame) -> DataFrame:
    """Faults of a contract's assets: doc_id, id, code; faults of all assets of a document have a null id.

    Assets: doc_id, id, kind, path, sha256, size_bytes, width_px, height_px,
    display_label, caption_block_id, placement_block_id.
    """
    a = assets.filter("doc_id is not null")
    own = codes(
        a, ["doc_id", "id"],
        {
            "invalid-asset-id": _not(F.col("id").rlike(P.ASSET_ID)), "invalid-asset-kind": _not(F.col("kind").isin(*ASSET_KINDS)), "invalid-asset-path": _not(F.col("path").rlike(ASSET_PATH)),
            "invalid-asset-hash": _not(F.col("sha256").rlike(P.SHA256)), "asset-too-large": F.col("size_bytes") > ASSET_BYTES,
            "invalid-asset-metadata": _not((F.col("size_bytes") >= 1) & (F.col("width_px") >= 1) & (F.col("height_px") >= 1)),
            "invalid-display-label": F.col("display_label").isNotNull() & (F.trim("display_label") == ""),
            "invalid-caption-block": F.col("caption_block_id").isNotNull() & _not(F.col("caption_block_id").rlike(P.BLOCK_ID)),
            "invalid-placement-block": _not(F.col("placement_block_id").rlike(P.SLOT_ID)),
        },
    )
    per = a.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("size_bytes") >= 1, F.col("size_bytes"))).alias("bytes")).withColumn("id", F.lit(None).cast("string"))
    return own.unionByName(codes(per, ["doc_id", "id"], {"too-many-assets": F.col("n") > ASSET_COUNT, "asset-total-too-large": F.col("bytes") > ALL_ASSET_BYTES}))


def relation_checks(relations: DataFrame) -> DataFrame:
    """Faults of a contract's relations: doc_id, id, code. Relations: doc_id, id, type, source_id, target_id, label."""
    return codes(
        relations.filter("doc_id is not null"), ["doc_id", "id"],
        {
            "invalid-relation-id": _not(F.col("id").rlike(RELATION_ID)), "invalid-relation-type": _not(F.col("type").isin(*RELATION_TYPES)), "invalid-relation-source": _not(F.col("source_id").rlike(ANY_BLOCK_ID)),
            "invalid-relation-target": _not(F.col("target_id").rlike(P.ASSET_ID)), "invalid-relation-label": F.col("label").isNotNull() & (F.trim("label") == ""),
        },
    )


def contract_heads(contracts: DataFrame) -> DataFrame:
    """Faults of the heads of contracts: doc_id, code.

    Contracts: doc_id, article struct<path, sha256, anchor_contract,
    block_fingerprint_version>, capabilities struct<layout_semantics, caption_binding, body_references>.
    """
    a, c = F.col("article"), F.col("capabilities")
    there = a.isNotNull()
    return codes(
        contracts.filter("doc_id is not null"), ["doc_id"],
        {
            "invalid-article": ~there, "invalid-article-path": there & _not(a["path"] == "article.md"), "invalid-article-hash": there & _not(a["sha256"].rlike(P.SHA256)),
            "unsupported-anchor-contract": there & _not(_named(a["anchor_contract"], ANCHOR_CONTRACT)), "unsupported-fingerprint-contract": there & _not(_named(a["block_fingerprint_version"], FINGERPRINT_CONTRACT)),
            "invalid-capabilities": _not((c["layout_semantics"] == "reviewed") & (c["caption_binding"] == "reviewed-layout-geometry") & (c["body_references"] == "unavailable")),
        },
    )


def manifest_binding(manifests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Faults between manifests and the contracts that they name: doc_id, code.

    Manifests: doc_id, manifest_version, source_sha256, reader struct<contract_version,
    path, sha256, article_path, article_sha256, anchor_contract>, outputs array<struct<path,
    role, sha256>>. Contracts: doc_id, source_sha256, article_path, article_sha256,
    reader_sha256. A manifest of an unknown version has this fault only, and one
    without reader no fault of its parts; without a contract nothing matches.
    """
    m, c = manifests.filter("doc_id is not null").alias("m"), contracts.filter("doc_id is not null").alias("c")
    both = m.join(c, F.col("m.doc_id") == F.col("c.doc_id"), "left").withColumn("key", F.col("m.doc_id"))
    known, r, outputs = F.coalesce(_named(F.col("m.manifest_version"), *BOUND_MANIFESTS), F.lit(False)), F.col("m.reader"), F.col("m.outputs")
    read, listed = known & r.isNotNull(), known & r.isNotNull() & outputs.isNotNull()

    def once(path: Column, role: str, sha: Column) -> Column:
        at = F.filter(outputs, lambda o: o["path"] == path)
        first = F.try_element_at(at, F.lit(1))
        return (F.size(at) == 1) & (first["role"] == role) & (first["sha256"] == sha)

    found = codes(
        both, ["key"],
        {
            "unsupported-manifest-version": ~known, "manifest-source-mismatch": known & ~F.col("m.source_sha256").eqNullSafe(F.col("c.source_sha256")), "invalid-manifest-reader": known & r.isNull(),
            "manifest-reader-contract-mismatch": read & _not(_named(r["contract_version"], READER_CONTRACT) & r["path"].rlike(READER_PATH) & (r["article_path"] == F.col("c.article_path")) & _named(r["anchor_contract"], ANCHOR_CONTRACT)),
            "manifest-reader-hash-mismatch": read & _not(r["sha256"].rlike(P.SHA256) & (r["sha256"] == F.col("c.reader_sha256"))),
            "manifest-article-hash-mismatch": read & _not(r["article_sha256"].rlike(P.SHA256) & (r["article_sha256"] == F.col("c.article_sha256"))),
            "invalid-manifest-outputs": read & outputs.isNull(),
            "manifest-reader-output-mismatch": listed & _not(once(r["path"], "reader_index", r["sha256"])), "manifest-article-output-mismatch": listed & _not(once(r["article_path"], "markdown", r["article_sha256"])),
        },
    )
    return found.withColumnRenamed("key", "doc_id")


def single_claims(requests: DataFrame, gap: list[str]) -> DataFrame:
    """Requests whose gap no other request claims."""
    once = requests.groupBy(*gap).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    return requests.join(once, gap, "left_semi")


def source_pdf(files: DataFrame) -> DataFrame:
    """The PDF that a package was made of: package_id, name; packages that leave it open have no row. Files: package_id, name."""
    pdf = files.filter(F.lower("name").endswith(".pdf")).select("package_id", "name").distinct()
    origin = F.col("name").rlike(r"(?i)(?:^|[_-])origin\.pdf$")
    per = pdf.groupBy("package_id").agg(F.count_if(origin).alias("o"), F.max(F.when(origin, F.col("name"))).alias("origin"), F.count("*").alias("n"), F.max("name").alias("only"))
    return per.select("package_id", F.when(F.col("o") == 1, F.col("origin")).when(F.col("n") == 1, F.col("only")).alias("name")).filter("name is not null")


def natural_key(path: Column) -> Column:
    """A text by which paths sort with their numbers in order: runs of digits filled up to 20 places, lower case."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d{1,20}$"), F.lpad(x, 20, "0")).otherwise(x)), "")
