"""Figure fragments of a page: enclosure, adjacency, components, groups with their score, and captions on the next page.

Pairs are formed within a page only. What depends on earlier decisions (merging of
components) runs in Python on one row for each page that has several visuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import geometry as G
from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.operators.elements import caption_items, viewer_blocks
from pagemill.operators.integrity import codes
from pagemill.runtime import latest

PADDING = 6
AUTO, REVIEW = 0.85, 0.65


def located_visuals(blocks: DataFrame) -> DataFrame:
    """Blocks of the role visual with an asset and a box."""
    return blocks.filter((F.col("role") == "visual") & F.col("asset_path").isNotNull() & F.col("box").isNotNull())


def _page_pairs(visuals: DataFrame) -> DataFrame:
    """All ordered pairs of visuals of one page; a page has few."""
    v = visuals.select("doc_id", "page_idx", "id", "page_order", "box")
    a, b = v.alias("a"), v.alias("b")
    return a.join(b, ["doc_id", "page_idx"]).select(
        "doc_id", "page_idx", F.col("a.id").alias("a_id"), F.col("a.page_order").alias("a_order"), F.col("a.box").alias("a"),
        F.col("b.id").alias("b_id"), F.col("b.page_order").alias("b_order"), F.col("b.box").alias("b"),
    )


def enclosing_visuals(blocks: DataFrame, containment: float = 0.95, ratio: float = 1.2) -> DataFrame:
    """The smallest visual around each visual: doc_id, page_idx, child_id, parent_id, containment."""
    p = _page_pairs(located_visuals(blocks)).filter("a_id <> b_id")
    inside = G.intersection(F.col("a"), F.col("b")) / G.area(F.col("a"))
    p = p.filter((G.area(F.col("b")) >= ratio * G.area(F.col("a"))) & (inside >= containment))
    best = F.min_by(F.struct(F.col("b_id").alias("parent_id"), F.round(inside, 4).alias("containment")), F.struct(G.area(F.col("b")), F.col("b_order")))
    return p.groupBy("doc_id", "page_idx", F.col("a_id").alias("child_id")).agg(best.alias("m")).select("doc_id", "page_idx", "child_id", "m.parent_id", "m.containment")


def visual_adjacency(blocks: DataFrame, most_gap: float = 20, share: float = 0.15) -> DataFrame:
    """Pairs of visuals of a page that lie next to each other, with their gaps."""
    p = _page_pairs(located_visuals(blocks)).filter("a_order < b_order").filter(G.adjacent(F.col("a"), F.col("b"), most_gap, share))
    return p.select(
        "doc_id", "page_idx", F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"),
        F.round(G.x_gap(F.col("a"), F.col("b")), 6).alias("x_gap"), F.round(G.y_gap(F.col("a"), F.col("b")), 6).alias("y_gap"),
    )


# --- Python on one page -------------------------------------------------------------------


def _overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def _near(a: list[float], b: list[float], gap: float, share: float, pick=min) -> bool:
    """Close on one axis, and overlapping on the other by a share of the picked size."""
    for i, j in ((0, 1), (1, 0)):
        apart = max(0.0, max(a[i], b[i]) - min(a[i + 2], b[i + 2]))
        if apart <= gap and _overlap(a[j], a[j + 2], b[j], b[j + 2]) >= share * pick(a[j + 2] - a[j], b[j + 2] - b[j]):
            return True
    return False


def _size(b: list[float]) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def _hull(blocks: list[dict]) -> list[float]:
    boxes = [x["box"] for x in blocks]
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def union_find(n: int, pairs: Iterator[tuple[int, int]]) -> list[list[int]]:
    """Connected components of 0..n-1, each sorted, in the order of their first member."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def clusters(visuals: list[dict], gap: float = 20, share: float = 0.15) -> list[list[dict]]:
    """Components of visuals that lie next to each other."""
    pairs = ((i, j) for i in range(len(visuals)) for j in range(i + 1, len(visuals)) if _near(visuals[i]["box"], visuals[j]["box"], gap, share))
    return [[visuals[i] for i in c] for c in union_find(len(visuals), pairs)]


def caption_distance(caption: list[float], visual: list[float]) -> float | None:
    """As ``geometry.caption_score``."""
    shared = _overlap(caption[0], caption[2], visual[0], visual[2]) / max(1.0, min(caption[2] - caption[0], visual[2] - visual[0]))
    if shared < 0.55:
        return None
    for apart, most in ((caption[1] - visual[3], 100), (visual[1] - caption[3], 80)):
        if apart >= -20:
            return max(0.0, apart) + (1 - shared) * 40 if max(0.0, apart) <= most else None
    return None


def image_context(blocks: list[dict]) -> dict:
    """How the blocks' images stand in the Markdown: ids in order, coverage, widest gap, and whether they are contiguous."""
    spans = sorted({(m["order"], m["id"], m["start"], m["end"]) for b in blocks for m in b["images"]})
    coverage = sum(bool(b["images"]) for b in blocks) / len(blocks) if blocks else 0.0
    gaps = [max(0, b[2] - a[3]) for a, b in zip(spans, spans[1:])]
    widest = max(gaps) if gaps else None
    contiguous = len(spans) >= 2 and spans[-1][0] - spans[0][0] + 1 == len(spans) and coverage >= 0.8 and widest is not None and widest <= 160
    return {"ids": [s[1] for s in spans], "coverage": coverage, "widest": widest, "contiguous": contiguous}


def following_caption(component: list[dict], page: list[dict]) -> dict | None:
    """The first text behind the component that begins with a formal figure caption."""
    last = max(b["page_order"] for b in component)
    return next((b for b in page if b["page_order"] > last and b["role"] in ("text", "title") and b["formal"]), None)


def _by_place(components: list[list[dict]]) -> list[list[dict]]:
    return sorted(components, key=lambda c: (_hull(c)[1], _hull(c)[0]))


def merge_bands(components: list[list[dict]]) -> list[list[dict]]:
    """Joins neighbouring components under one figure caption, again and again, from the top of the page."""
    work = _by_place([sorted(c, key=lambda b: b["page_order"]) for c in components])
    at = 0
    while at < len(work) - 1:
        both = sorted(work[at] + work[at + 1], key=lambda b: b["page_order"])
        fits = (
            _near(_hull(work[at]), _hull(work[at + 1]), 40, 0.65, max)
            and len(both) >= 3
            and sum(b["anchors"] for b in both) == 1
            and image_context(both)["contiguous"]
            and 0.03 <= _size(_hull(both)) / 1e6 <= 0.8
        )
        if fits:
            work[at : at + 2] = [both]
            work, at = _by_place(work), 0
        else:
            at += 1
    return work


def merge_by_caption(components: list[list[dict]], page: list[dict]) -> list[list[dict]]:
    """Joins components that are close and precede one formal caption, if it lies next to what they make together."""
    captions = [following_caption(c, page) for c in components]
    pairs = (
        (i, j)
        for i in range(len(components))
        for j in range(i + 1, len(components))
        if captions[i] and captions[j] and captions[i]["id"] == captions[j]["id"] and _near(_hull(components[i]), _hull(components[j]), 65, 0.2)
    )
    out = []
    for group in union_find(len(components), pairs):
        caption = captions[group[0]]
        both = sorted((b for i in group for b in components[i]), key=lambda b: b["page_order"])
        if len(group) > 1 and caption and caption["box"] and caption_distance(caption["box"], _hull(both)) is not None:
            out.append(both)
        else:
            out.extend(components[i] for i in group)
    return _by_place(out)


def score_group(members: list[dict], parts: list[dict], edges: int, existing: bool, standalone: bool) -> dict:
    """Confidence, decision, signals, reasons and warnings of a group.

    The confidence is a sum of parts for the evidence, with upper bounds where the
    evidence is weak or contradicts itself.
    """
    long_, panels = sum(b["long"] for b in members), sum(b["panels"] for b in members)
    anchors = sum(b["anchors"] for b in members) + standalone
    context = image_context(members)
    share = _size(_hull(parts)) / 1e6
    most = 0.99
    if existing:
        aliases = max(0, len(members) - 1)
        rows = [(True, 0.78 + min(0.12, aliases * 0.03), "enclosing_visual_asset"), (long_ > 0, 0.05, "long_caption_attached"), (context["contiguous"], 0.05, "markdown_references_contiguous")]
        warn = [(share > 0.85 and aliases < 2, "near_full_page_enclosing_asset", 0.79)]
    else:
        rows = [
            (True, 0.5 + (0.15 if len(parts) >= 3 else 0.08), None),
            (edges >= max(1, len(parts) - 1), 0.1, "same_page_connected_visuals"),
            (long_ > 0, 0.1, "long_caption_attached"),
            (panels > 0, 0.05, "panel_labels_detected"),
            (standalone, 0.12, "standalone_figure_caption_after_visuals"),
            (context["contiguous"], 0.1, "markdown_references_contiguous"),
            (0.03 <= share <= 0.8, 0.05, "plausible_union_area"),
            (anchors > 1, -0.25, None),
            (anchors == 0 and long_ > 2, -0.15, None),
            (share > 0.85, -0.2, None),
        ]
        warn = [(anchors > 1, "multiple_figure_caption_anchors", most), (anchors == 0 and long_ > 2, "multiple_long_caption_anchors", most), (share > 0.85, "near_full_page_union", most)]
    strong = ((long_ > 0 or standalone) and anchors == 1) or (not existing and len(parts) >= 4 and edges >= len(parts) - 1 and panels >= 2 and context["coverage"] >= 0.8)
    warn += [(not strong, "insufficient_figure_anchor_evidence", 0.79), (anchors > 1, "multiple_figure_caption_anchors", 0.79), (anchors == 0 and long_ > 2, "multiple_long_caption_anchors", 0.79)]
    confidence = sum(n for holds, n, _ in rows if holds)
    warnings: list[str] = []
    for holds, code, bound in warn:
        if holds:
            confidence = min(confidence, bound)
            if code not in warnings:
                warnings.append(code)
    confidence = round(max(0.0, min(most, confidence)) + 1e-12, 3)
    return {
        "confidence": confidence,
        "decision": "auto" if confidence >= AUTO else "review" if confidence >= REVIEW else "skip",
        "reasons": [code for holds, _, code in rows if holds and code],
        "warnings": warnings,
        "coverage": round(context["coverage"], 4),
        "widest_gap": context["widest"],
        "area": round(share, 4),
        "anchors": anchors,
        "image_ids": context["ids"],
    }


def page_groups(page: list[dict]) -> list[dict]:
    """Groups of the visuals of one page, in order of their place; ``n`` counts them before nested ones are united."""
    visuals = [b for b in page if b["role"] == "visual" and b["asset_path"] and b["box"]]
    inside: dict[str, str] = {}
    for c in visuals:
        around = [p for p in visuals if p is not c and _size(p["box"]) >= 1.2 * _size(c["box"])]
        shared = lambda p, c=c: _overlap(c["box"][0], c["box"][2], p["box"][0], p["box"][2]) * _overlap(c["box"][1], c["box"][3], p["box"][1], p["box"][3])
        around = [p for p in around if shared(p) >= 0.95 * _size(c["box"])]
        if around:
            inside[c["id"]] = min(around, key=lambda p: _size(p["box"]))["id"]
    aliases: dict[str, list[dict]] = {}
    for c in visuals:
        top, seen = c["id"], set()
        while top in inside and top not in seen:
            seen.add(top)
            top = inside[top]
        if top != c["id"]:
            aliases.setdefault(top, []).append(c)
    parts = merge_by_caption(merge_bands(clusters([v for v in visuals if v["id"] not in inside])), page)
    out = []
    for component in parts:
        members = sorted({b["id"]: b for b in [*component, *(a for r in component for a in aliases.get(r["id"], ()))]}.values(), key=lambda b: b["page_order"])
        if len(members) == 1:
            continue
        box = _hull(component)
        caption = following_caption(component, page)
        attached = sum(b["anchors"] for b in members)
        standalone = attached == 0 and bool(caption and caption["box"] and caption_distance(caption["box"], box) is not None)
        edges = sum(_near(a["box"], b["box"], 20, 0.15) for i, a in enumerate(component) for b in component[i + 1 :])
        existing = len(component) == 1
        got = score_group(members, component, edges, existing, standalone)
        if len(clusters(component)) > 1:
            got["reasons"].append("caption_anchored_spatial_bridge")
        out.append(
            got
            | {
                "members": [b["id"] for b in members],
                "anchors_at": [b["id"] for b in members if b["long"]] + ([caption["id"]] if standalone and caption else []),
                "mode": "existing_asset" if existing else "pdf_crop",
                "box": box,
                "edges": edges,
            }
        )
    placed = sorted(out, key=lambda g: (g["box"][1], g["box"][0]))
    return merge_nested([g | {"n": i} for i, g in enumerate(placed)], page)


#: How much larger a group must be than one inside it, and the share of the inner one that must lie inside.
NESTED_SIZE, NESTED_SHARE = 1.35, 0.97


def _nested(outer: dict, inner: dict, blocks: dict[str, dict]) -> float | None:
    """The share of ``inner`` inside ``outer`` if they are one figure drawn twice, else None.

    Both are sure crops of the page, their blocks touch in reading order, and
    together they name exactly one figure, formally or as one on the next page.
    """
    sure = all(g["decision"] == "auto" and g["mode"] == "pdf_crop" for g in (outer, inner))
    a, b = outer["box"], inner["box"]
    if not sure or _size(b) <= 0 or _size(a) < NESTED_SIZE * _size(b):
        return None
    inside = _overlap(a[0], a[2], b[0], b[2]) * _overlap(a[1], a[3], b[1], b[3]) / _size(b)
    (first, last), (low, high) = ((min(at), max(at)) for at in ([blocks[i]["page_order"] for i in g["members"]] for g in (outer, inner)))
    named = {k for g in (outer, inner) for i in g["members"] for k in (*blocks[i]["formal_keys"], *blocks[i]["next_keys"])}
    return inside if inside >= NESTED_SHARE and low <= last + 1 and first <= high + 1 and len(named) == 1 else None


def merge_nested(groups: list[dict], page: list[dict]) -> list[dict]:
    """Unites groups that lie in each other, from the first pair on, until none is left."""
    blocks = {b["id"]: b for b in page}
    order = lambda ids: sorted(dict.fromkeys(ids), key=lambda i: blocks[i]["page_order"])
    union = lambda *lists: list(dict.fromkeys(x for one in lists for x in one))
    while True:
        pairs = ((i, j, *sorted((groups[i], groups[j]), key=lambda g: -_size(g["box"]))) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        hit = next(((i, j, a, b, share) for i, j, a, b in pairs if (share := _nested(a, b, blocks)) is not None), None)
        if hit is None:
            return groups
        i, j, a, b, share = hit
        one = a | {
            "members": order(a["members"] + b["members"]), "anchors_at": order(a["anchors_at"] + b["anchors_at"]), "confidence": min(a["confidence"], b["confidence"]),
            "edges": a["edges"] + b["edges"], "anchors": a["anchors"] + b["anchors"], "image_ids": union(a["image_ids"], b["image_ids"]), "nested": round(share, 4),
            "reasons": union(a["reasons"], b["reasons"], ["nested_visual_overlap_deduplicated"]), "warnings": union(a["warnings"], b["warnings"]),
        }
        groups = [one if k == i else g for k, g in enumerate(groups) if k != j]


GROUPS = "doc_id string, page_idx int, id string, member_block_ids array<string>, caption_anchor_block_ids array<string>, mode string, bbox_norm array<double>, confidence double, decision string, adjacent_pair_count int, union_area_fraction double, markdown_reference_coverage double, max_markdown_gap_chars int, reason_codes array<string>, warning_codes array<string>"


def described_blocks(elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Viewer blocks with the counts of their captions, the formal key of their text and their Markdown images.

    ``images``: doc_id, id, order, asset_path, occurrence, start, end. The k-th block
    with a path takes the k-th image with that path.
    """
    blocks = viewer_blocks(elements)
    caps = caption_items(elements).groupBy("doc_id", "source_index").agg(
        F.count_if(F.length("text") >= 30).alias("long"), F.count_if(F.col("formal_key").isNotNull()).alias("anchors"),
        F.count_if(F.col("text").rlike(P.PANEL_LABEL)).alias("panels"),
        F.array_sort(F.collect_set("figure_key")).alias("figure_keys"), F.array_sort(F.collect_set("formal_key")).alias("formal_keys"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "next-page-placeholder", F.col("figure_key")))).alias("next_keys"),
    )
    t = X.trim(F.coalesce("text", F.lit("")))
    out = blocks.join(caps, ["doc_id", "source_index"], "left").select(
        "doc_id", "page_idx", "source_index", "id", "page_order", "role", "box", "asset_path",
        *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("long", "anchors", "panels")],
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("figure_keys", "formal_keys", "next_keys")],
        F.length(t).alias("chars"), X.figure_key(t).alias("key"), X.formal_figure_key(t).alias("formal"),
        X.ends_with_terminal(t).alias("ended"), (X.first_letter_is_lower(t) | t.rlike(P.PANEL_START)).alias("goes_on"),
    )
    if images is None:
        return out.withColumn("images", F.array().cast("array<struct<id:string,order:int,start:int,end:int>>"))
    nth = Window.partitionBy("doc_id", "asset_path").orderBy("source_index")
    numbered = out.withColumn("nth", F.when(F.col("asset_path").isNotNull(), F.row_number().over(nth) - 1))
    at = images.select("doc_id", "asset_path", F.col("occurrence").alias("nth"), F.struct("id", F.col("order").cast("int").alias("order"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("image"))
    return numbered.join(at, ["doc_id", "asset_path", "nth"], "left").withColumn("images", F.when(F.col("image").isNotNull(), F.array("image")).otherwise(F.array().cast("array<struct<id:string,order:int,start:int,end:int>>"))).drop("image", "nth")


def visual_groups(elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Groups of figure fragments of each page, with confidence and decision.

    Only pages with at least two located visuals are looked at; of those, one row
    for each page goes to Python.
    """
    blocks = described_blocks(elements, images)
    visual = (F.col("role") == "visual") & F.col("asset_path").isNotNull() & F.col("box").isNotNull()
    wanted = blocks.filter(visual | F.col("role").isin("text", "title"))
    cols = ["page_order", "id", "role", "box", "asset_path", "long", "anchors", "panels", "formal", "formal_keys", "next_keys", "images"]
    pages = wanted.groupBy("doc_id", "page_idx").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("blocks"), F.count_if(visual).alias("n")).filter("n > 1").drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for g in page_groups(r["blocks"]):
                    rows.append((r["doc_id"], r["page_idx"], f"vr-p{r['page_idx']:04d}-g{g['n']:04d}", g["members"], g["anchors_at"], g["mode"], g["box"], g["confidence"], g["decision"], g["edges"], g["area"], g["coverage"], g["widest_gap"], g["reasons"], g["warnings"]))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            names = [x.split()[0] for x in GROUPS.split(", ")]
            cols_ = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds)], names=names)

    return pages.mapInArrow(run, GROUPS)


def visual_components(blocks: DataFrame) -> DataFrame:
    """Components of the visuals of each page, named by their first member: doc_id, id, component."""
    pages = located_visuals(blocks).groupBy("doc_id", "page_idx").agg(F.sort_array(F.collect_list(F.struct("page_order", "id", "box"))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["doc_id"], x["id"], min(y["id"] for y in c)) for r in b.to_pylist() for c in clusters(r["blocks"]) for x in c]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["doc_id", "id", "component"])

    return pages.mapInArrow(run, "doc_id string, id string, component string")


# --- captions on the next page -------------------------------------------------------------


#: Roles at which a search for a caption ends, and roles whose text can be one.
BARRIERS, TEXTS = ("visual", "table", "equation"), ("text", "title")


def _first(blocks: Column, where: Callable[[Column], Column]) -> Column:
    """The first of the blocks of a page, in reading order, for which a condition holds; null if there is none."""
    return F.try_element_at(F.filter(blocks, lambda b: F.coalesce(where(b), F.lit(False))), F.lit(1))


def _written(b: Column) -> Column:
    return b["role"].isin(*TEXTS) & (b["chars"] > 0)


def _at_top(b: Column) -> Column:
    return F.coalesce(b["box"][1] <= 320, F.lit(False))


def _page_header(b: Column) -> Column:
    x = b["box"]
    return (b["role"] == "title") & b["chars"].between(1, 16) & (x[0] <= 200) & (x[1] <= 40) & (x[2] - x[0] <= 180) & (x[3] <= 65) & b["key"].isNull()


def _decided(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    out = otherwise
    for holds, value in reversed(cases):
        out = F.when(holds, value).otherwise(out)
    return out


def with_link(df: DataFrame, key: str, page: str) -> DataFrame:
    """Adds where the caption of figure ``key`` stands on a page: ``link``, a struct of status, caption_block_ids and reason_codes.

    ``page``: the column of the page's blocks as an ordered array. Two blocks decide. The *head* is
    the first block that is a barrier or has text, page headers left out; it is the
    caption or there is none. The *tail* is the first block behind the head that is
    a barrier, has text, or is an empty column beside it; it repeats the caption
    (ambiguous), goes on with it, or leaves it partial. A null page has no caption.
    """
    said = lambda status, ids, *codes: F.struct(F.lit(status).alias("status"), ids.alias("caption_block_ids"), F.array(*codes).cast("array<string>").alias("reason_codes"))
    none = F.array().cast("array<string>")
    reaches = lambda b: b["role"].isin(*BARRIERS) | _written(b)
    # each block is picked in a step of its own, else it would be searched for again at each use
    df = df.withColumn("__head", _first(F.col(page), lambda b: reaches(b) & ~F.coalesce(_page_header(b), F.lit(False))))
    head, key = F.col("__head"), F.col(key)
    barrier = lambda b, ending: F.concat(b["role"], F.lit(ending))
    is_barrier = lambda b: b["role"].isin(*BARRIERS)
    named = lambda b: b["key"].isNotNull()
    no_head = _decided(
        [
            (is_barrier(head), barrier(head, "_boundary")),
            (~_at_top(head), F.lit("body_band_boundary")),
            (named(head) & (head["key"] != key), F.lit("different_figure_key")),
            (named(head), F.lit("nonformal_figure_reference")),
        ],
        F.when(head["role"] == "title", "title_boundary").otherwise("body_text_boundary"),
    )
    beside = lambda b: F.coalesce(G.same_top_band(head["box"], b["box"]), F.lit(False))
    df = df.withColumn("__behind", F.filter(F.col(page), lambda b: b["page_order"] > head["page_order"]))
    empty = lambda b: b["role"].isin(*TEXTS) & (b["chars"] == 0)
    df = df.withColumn("__again", _first(F.col("__behind"), reaches)).withColumn("__tail", _first(F.col("__behind"), lambda b: reaches(b) | (empty(b) & beside(b))))
    again, tail = F.col("__again"), F.col("__tail")
    repeated = F.coalesce(_written(again) & (again["formal"] == key) & _at_top(again) & beside(again), F.lit(False))
    df = df.withColumn("__refused", _decided(
        [
            (tail.isNull(), F.lit("unterminated_caption_anchor")),
            (is_barrier(tail), barrier(tail, "_boundary_before_caption_continuation")),
            (tail["chars"] == 0, F.lit("empty_adjacent_caption_column")),
            (named(tail), F.lit("new_figure_anchor_in_adjacent_column")),
            (tail["role"] == "title", F.lit("title_band_in_adjacent_column")),
            (~beside(tail), F.lit("body_text_boundary_before_caption_continuation")),
            (~F.coalesce(tail["goes_on"], F.lit(False)), F.lit("uncertain_adjacent_caption_continuation")),
        ],
        F.lit(None).cast("string"),
    ))
    refused = F.col("__refused")
    ended = lambda b: F.coalesce(b["ended"], F.lit(False))
    both = F.array(head["id"], tail["id"])
    link = _decided(
        [
            (head.isNull(), said("missing", none)),
            (~F.coalesce(_written(head) & _at_top(head) & (head["formal"] == key), F.lit(False)), said("missing", none, no_head)),
            (repeated, said("ambiguous", none, F.lit("duplicate_formal_caption_anchor"))),
            (ended(head), said("complete", F.array(head["id"]))),
            (refused.isNotNull(), said("partial", F.array(head["id"]), refused)),
            (ended(tail), said("complete", both)),
        ],
        said("partial", both, F.lit("unterminated_caption_continuation")),
    )
    return df.withColumn("link", link).drop("__head", "__behind", "__again", "__tail", "__refused")


def caption_links(elements: DataFrame) -> DataFrame:
    """Captions on the next page: one row for each visual that says so.

    Status ``unclear`` if the visual names no figure or several, ``missing`` if the
    caption is not found, ``ambiguous`` if it is found twice, else complete or
    partial. The visuals that say so are few; each is joined with the next page only.
    """
    blocks = described_blocks(elements)
    saying = blocks.filter((F.col("role") == "visual") & F.col("asset_path").isNotNull() & F.col("box").isNotNull() & (F.size("next_keys") > 0))
    key = F.when((F.size("figure_keys") == 1) & (F.col("figure_keys") == F.col("next_keys")), F.col("figure_keys")[0])
    saying = saying.select("doc_id", F.col("id").alias("visual_block_id"), F.col("page_idx").alias("source_page_idx"), (F.col("page_idx") + 1).alias("page_idx"), key.alias("figure_key"))
    cols = ["page_order", "id", "role", "box", "chars", "key", "formal", "ended", "goes_on"]
    wanted = saying.select("doc_id", "page_idx").distinct()
    pages = blocks.join(wanted, ["doc_id", "page_idx"], "left_semi").groupBy("doc_id", "page_idx").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("blocks"))
    none = F.array().cast("array<string>")
    status = F.when(F.col("figure_key").isNull(), F.struct(F.lit("unclear").alias("status"), none.alias("caption_block_ids"), none.alias("reason_codes"))).otherwise(F.col("link"))
    return with_link(saying.join(pages, ["doc_id", "page_idx"], "left"), "figure_key", "blocks").select("doc_id", "visual_block_id", "source_page_idx", "figure_key", status.alias("s")).select("doc_id", "visual_block_id", "source_page_idx", "figure_key", "s.*")


def following_captions(elements: DataFrame) -> DataFrame:
    """For each located visual the next text of its page that begins with a formal caption, and how far it is."""
    blocks = viewer_blocks(elements)
    t = X.trim(F.coalesce("text", F.lit("")))
    formal = F.when(F.col("role").isin("text", "title"), X.formal_figure_key(t))
    later = Window.partitionBy("doc_id", "page_idx").orderBy("page_order").rowsBetween(1, Window.unboundedFollowing)
    seen = blocks.withColumn("f", formal).withColumn("cap", F.when(F.col("f").isNotNull(), F.struct("id", "f", "box"))).withColumn("next", F.first("cap", True).over(later))
    return located_visuals(seen).filter("next is not null").select(
        "doc_id", "page_idx", "id", F.col("next.id").alias("caption_id"), F.col("next.f").alias("figure_key"),
        F.round(G.caption_score(F.col("next.box"), F.col("box")), 6).alias("distance"),
    )


MODES, DECISIONS = ("pdf_crop", "existing_asset"), ("auto", "review", "skip")


def group_checks(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Faults of figure groups against the blocks of their package: doc_id, id, code.

    Of a group delivered more than once the last ``received_at`` counts. Members and
    anchors are looked up by package and id, so a large package is spread. A caption
    outside the members must be a text or title of the group's page; a crop must
    cover every located member; an existing asset must be that of a member.
    """
    g = latest(groups.filter("doc_id is not null and id is not null").select("doc_id", "id", "page_idx", "member_block_ids", "caption_anchor_block_ids", "decision", "confidence", "replacement", "received_at"), ["doc_id", "id"])
    crop = G.contract_box(F.col("replacement.bbox_norm"))
    known = blocks.select("doc_id", F.col("id").alias("block"), F.col("page_idx").alias("block_page"), "role", F.col("box").alias("block_box"))
    named = lambda column: g.select("doc_id", "id", "page_idx", crop.alias("crop"), (F.col("replacement.mode") == "pdf_crop").alias("cropped"), "member_block_ids", F.explode(column).alias("block")).distinct().join(known, ["doc_id", "block"], "left")
    per_block = named("member_block_ids").filter("block is not null")
    shared = per_block.groupBy("doc_id", "block").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "block", F.lit(True).alias("shared"))
    holds = lambda c: F.max(F.coalesce(c, F.lit(False)))
    members = per_block.join(shared, ["doc_id", "block"], "left").groupBy("doc_id", "id").agg(
        holds(F.col("block_page").isNull()).alias("unknown"), holds(F.col("shared")).alias("shared"), holds(F.col("block_page") != F.col("page_idx")).alias("elsewhere"),
        holds(F.col("cropped") & (G.intersection(F.col("crop"), F.col("block_box")) < G.area(F.col("block_box")) - 1e-6)).alias("uncovered"),
    )
    placed = F.coalesce((F.col("block_page") == F.col("page_idx")) & F.col("role").isin(*TEXTS), F.lit(False))
    outside = F.coalesce(~F.array_contains("member_block_ids", F.col("block")), F.lit(True))
    anchors = named("caption_anchor_block_ids").filter("block is not null").filter(outside).groupBy("doc_id", "id").agg(holds(~placed).alias("stray"))
    all_ = g.join(members, ["doc_id", "id"], "left").join(anchors, ["doc_id", "id"], "left")
    r, mode = F.col("replacement"), F.col("replacement.mode")
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    asset = mode == "existing_asset"
    return codes(
        all_, ["doc_id", "id"],
        {
            "invalid-confidence": bad(F.col("confidence").between(0, 1)), "invalid-decision": bad(F.col("decision").isin(*DECISIONS)), "no-members": F.coalesce(F.size("member_block_ids"), F.lit(0)) < 1,
            "unknown-block": F.col("unknown"), "block-in-several-groups": F.col("shared"), "member-on-another-page": F.col("elsewhere"), "invalid-caption-anchor": F.col("stray"),
            "missing-replacement": r.isNull(), "unsupported-mode": r.isNotNull() & bad(mode.isin(*MODES)), "invalid-crop-box": (mode == "pdf_crop") & crop.isNull(), "crop-misses-member": F.col("uncovered"),
            "missing-asset": asset & bad(F.length(r["asset_path"]) > 0), "asset-of-no-member": asset & bad(F.array_contains("member_block_ids", r["block_id"])),
        },
    )
