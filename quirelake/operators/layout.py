"""Order and merging of blocks on a page. Everything here is keyed by page; the folds work on one page's blocks at a time."""

from __future__ import annotations

from statistics import mean

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as T

FAR = 10**9
REGION_PRIORITY = {"title": 0, "header": 0, "paragraph": 1, "body": 1, "other": 1, "table": 2, "form": 2, "footer": 3}
PAGE = ["record_id", "page_pos"]


def order_keys() -> list[Column]:
    """Reading order, then top, left and position; missing ones last."""
    return [F.coalesce(F.col("block.metadata.reading_order"), F.lit(FAR)), F.coalesce(G.at(F.col("block.bbox"), 1), F.lit(1e9)), F.coalesce(G.at(F.col("block.bbox"), 0), F.lit(1e9)), F.col("block_pos")]


def block_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order_keys())))


def region(block: str = "block") -> Column:
    """A block's region: as recorded, else by its height on the page (needs `page_bottom`), else by its layout label or type."""
    b = F.col(block)
    y0, y1 = G.at(b["bbox"], 1), G.at(b["bbox"], 3)
    recorded = F.lower(b["metadata"]["region"])
    return F.coalesce(recorded, F.when(y1 <= 0.14 * F.col("page_bottom"), "header").when(y0 >= 0.94 * F.col("page_bottom"), "footer"), F.lower(b["metadata"]["layout_label"]), F.lower(b["type"]), F.lit("other"))


def region_order(blocks: DataFrame) -> DataFrame:
    """Blocks by region (titles and headers, body, tables and forms, footers), then by top, left and position."""
    bottom = F.max(G.at(F.col("block.bbox"), 3)).over(Window.partitionBy(*PAGE))
    d = blocks.withColumn("page_bottom", bottom).withColumn("region", region())
    priority = F.lit(1)
    for name, p in REGION_PRIORITY.items():
        priority = F.when(F.col("region") == name, p).otherwise(priority)
    d = d.withColumn("priority", priority)
    w = Window.partitionBy(*PAGE).orderBy("priority", F.coalesce(G.at(F.col("block.bbox"), 1), F.lit(1e9)), F.coalesce(G.at(F.col("block.bbox"), 0), F.lit(1e9)), "block_pos")
    return d.withColumn("ord", F.row_number().over(w))


def right_side_values(blocks: DataFrame) -> DataFrame:
    """Label blocks (two labels or more) with the value blocks to their right: later in order, within the label's height.

    A join on the page with range conditions: pages bound the groups.
    """
    o = block_order(blocks).select(*PAGE, "block_pos", "ord", F.col("block.type").alias("type"), F.col("block.bbox").alias("box"), F.size(F.filter(F.transform(T.lines(F.coalesce("block.text", F.lit(""))), T.label_key), lambda x: x.isNotNull())).alias("labels"))
    l = o.where("labels >= 2 AND size(box) = 4").select(*PAGE, F.col("block_pos").alias("label_pos"), F.col("ord").alias("label_ord"), F.col("box").alias("l"))
    v = o.where("type IN ('paragraph', 'form') AND size(box) = 4").select(*PAGE, "block_pos", "ord", F.col("box").alias("v"))
    near = (F.col("ord") > F.col("label_ord")) & (G.at(F.col("v"), 0) > G.at(F.col("l"), 2) - 8) & (G.at(F.col("v"), 1) >= G.at(F.col("l"), 1) - 18) & (G.at(F.col("v"), 1) <= G.at(F.col("l"), 3) + F.greatest(F.lit(120.0), 0.75 * G.height(F.col("l"))))
    return l.join(v, PAGE).where(near).select(*PAGE, "label_pos", "block_pos")


def best_layout(blocks: DataFrame, boxes: DataFrame, least: float = 0.15) -> DataFrame:
    """Each block with the layout box of its page that covers most of it (over `least`; the first on ties), or null."""
    b = blocks.select(*PAGE, "block_pos", F.col("block.bbox").alias("a"))
    met = b.join(boxes.select(*PAGE, "box_no", "label", F.col("box").alias("b")), PAGE).withColumn("share", G.covered(F.col("a"), F.col("b"))).where(F.col("share") > least)
    best = met.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "block_pos").orderBy(F.desc("share"), "box_no"))).where("n = 1")
    return b.join(best.select(*PAGE, "block_pos", "box_no", "label", "share"), [*PAGE, "block_pos"], "left").drop("a")


def merge_paragraphs(rows: list[dict], gap: float = 22, shift: float = 45) -> list[dict]:
    """Neighbouring paragraphs of one layout label, region, column and source joined where they stand close; boxes unite,
    confidence is the mean of each pair in turn (rounded to 2)."""
    out: list[dict] = []
    same = ("layout_label", "region", "column_index", "source")
    for r in rows:
        p = out[-1] if out else None
        if p and r["type"] == p["type"] == "paragraph" and all(r[k] == p[k] for k in same) and p["bbox"] and r["bbox"] and 0 <= r["bbox"][1] - p["bbox"][3] <= gap and abs(r["bbox"][0] - p["bbox"][0]) <= shift:
            p["text"] = "\n".join(x for x in (p["text"], r["text"]) if x)
            p["bbox"] = [min(p["bbox"][0], r["bbox"][0]), min(p["bbox"][1], r["bbox"][1]), max(p["bbox"][2], r["bbox"][2]), max(p["bbox"][3], r["bbox"][3])]
            known = [c for c in (p["confidence"], r["confidence"]) if c is not None]
            p["confidence"] = round(mean(known), 2) if known else None
            p["merged"] += 1
        else:
            out.append({**r, "merged": 1})
    return out


def cluster_columns(boxes: list[tuple[float, float]], page_width: float) -> list[int]:
    """Column numbers of (left, right) extents: each joins the column it overlaps best, else opens one; columns from the left."""
    threshold = max(24.0, 0.08 * page_width)
    columns: list[list[float]] = []  # mean left, mean right, members
    chosen: list[int] = []
    for left, right in boxes:
        best, at = None, None
        for i, (cl, cr, _) in enumerate(columns):
            common = max(0.0, min(right, cr) - max(left, cl))
            share = common / max(min(right - left, cr - cl), 1e-9)
            centre = abs((left + right) / 2 - (cl + cr) / 2)
            if share >= 0.10 and (centre <= 1.5 * threshold or abs(left - cl) <= threshold):
                score = share - centre / max(page_width, 1e-9)
                if best is None or score > best:
                    best, at = score, i
        if at is None:
            columns.append([left, right, 1])
            at = len(columns) - 1
        else:
            c = columns[at]
            c[0], c[1], c[2] = (c[0] * c[2] + left) / (c[2] + 1), (c[1] * c[2] + right) / (c[2] + 1), c[2] + 1
        chosen.append(at)
    rank = {c: i for i, c in enumerate(sorted(range(len(columns)), key=lambda i: columns[i][0]))}
    return [rank[c] for c in chosen]


def pair_labels(labels: list[str], values: list[str], fits) -> list[tuple[str, str]]:
    """Labels with values in order: a fitting pair is taken; a value that fits a later label skips this one; else the value is skipped."""
    out, i, j = [], 0, 0
    while i < len(labels) and j < len(values):
        if fits(labels[i], values[j]):
            out.append((labels[i], values[j]))
            i, j = i + 1, j + 1
        elif any(fits(x, values[j]) for x in labels[i + 1 :]):
            i += 1
        else:
            j += 1
    return out


def merge_lines(lines: list[dict], page_height: float, anchor, continues) -> list[list[dict]]:
    """Body lines of a prescription: a continuation, or a neighbour of up to three words, joins the line above it where the
    gap and the overlap allow; a short line that fits the next one better waits for it."""
    reach = max(42.0, 0.035 * page_height)
    out: list[list[dict]] = []
    for line in lines:
        prev = out[-1][-1] if out else None
        near = prev is not None and line["bbox"][1] - prev["bbox"][3] <= reach
        common = max(0.0, min(line["bbox"][2], prev["bbox"][2]) - max(line["bbox"][0], prev["bbox"][0])) if near else 0.0
        least = min(line["bbox"][2] - line["bbox"][0], prev["bbox"][2] - prev["bbox"][0]) if near else 1.0
        overlap = near and least > 0 and common / least >= 0.55
        short = len(line["text"].split()) <= 3 or (prev is not None and len(prev["text"].split()) <= 3)
        if near and overlap and not anchor(line["text"]) and ((anchor(out[-1][0]["text"]) and continues(line["text"])) or short):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def per_page(blocks: DataFrame, fold, schema: str) -> DataFrame:
    """Applies fold(list of block rows in order) -> list of rows to the blocks of each page."""
    o = block_order(blocks).select(*PAGE, "ord", "block_pos", F.col("block.type").alias("type"), F.col("block.text").alias("text"), F.col("block.source").alias("source"), F.col("block.confidence").alias("confidence"), F.col("block.bbox").alias("bbox"), F.col("block.metadata.layout_label").alias("layout_label"), F.col("block.metadata.region").alias("region"), F.col("block.metadata.column_index").alias("column_index"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ord").astype(object).where(lambda d: d.notna(), None).to_dict("records")
        for r in rows:
            r["bbox"] = [float(x) for x in r["bbox"]] if r["bbox"] is not None and len(r["bbox"]) == 4 and all(x is not None for x in r["bbox"]) else None
        return pd.DataFrame(fold(rows), columns=names)

    return o.groupBy(*PAGE).applyInPandas(run, schema)
