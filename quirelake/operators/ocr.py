"""Recognised pages: words and lines to blocks, handwritten pages, and hooks for engines that are not part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as PT

from quirelake.functions import geometry as G
from quirelake.functions import text as T
from quirelake.operators import extract as E
from quirelake.operators.retrieval import words

PAGE = ["record_id", "page_pos"]


def with_engine(pages: DataFrame, engine: Callable[[bytes], list[dict]], content: str = "content") -> DataFrame:
    """Runs a recogniser over page images in batches: adds lines array<struct<text, bbox, confidence>> and error.

    engine: image bytes -> [{text, bbox, confidence}]; it is made once per worker by the closure. A page that fails has
    no lines and its error; the batch goes on.
    """
    line = PT.StructType([PT.StructField("text", PT.StringType()), PT.StructField("bbox", PT.ArrayType(PT.DoubleType())), PT.StructField("confidence", PT.DoubleType())])
    schema = pages.drop(content).schema.add("lines", PT.ArrayType(line)).add("error", PT.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines, errors = [], []
            for image in pdf[content]:
                try:
                    lines.append(engine(image))
                    errors.append(None)
                except Exception as x:  # the page is marked, the job is not failed
                    lines.append([])
                    errors.append(f"{type(x).__name__}: {x}")
            yield pdf.drop(columns=[content]).assign(lines=lines, error=errors)

    return pages.mapInPandas(run, schema)


def vision_text(engine: Callable[[bytes], str]) -> Callable[[bytes], tuple[str, float]]:
    """A text engine with a confidence by the length of its text; empty text and 0 where it fails."""

    def run(image: bytes) -> tuple[str, float]:
        try:
            text = " ".join(engine(image).split())
        except Exception:
            return "", 0.0
        n = len(text.split())
        return text, 0.85 if n >= 20 else 0.75 if n >= 8 else 0.65

    return run


def prepare_words(ws: Column, page_width: Column, page_height: Column) -> Column:
    """Words with a text and an area, boxes on a scale of 1000, in order of top and left."""
    full = F.filter(ws, lambda w: (F.trim(F.coalesce(w["text"], F.lit(""))) != "") & (G.area(w["bbox"]) > 0))
    placed = F.transform(full, lambda w: F.struct(G.at(w["bbox"], 1).alias("y"), G.at(w["bbox"], 0).alias("x"), w["text"].alias("text"), G.to_thousand(w["bbox"], page_width, page_height).alias("bbox")))
    return F.transform(F.array_sort(placed), lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox")))


def fallback_layout(lines: Column, page_height: Column) -> Column:
    """Layout without a model: a header box around the lines above max(40, 18 % of the height), a paragraph box around the rest."""
    cut = F.greatest(F.lit(40.0), 0.18 * page_height)

    def around(part: Column, label: str, position: int) -> Column:
        boxes = F.transform(part, lambda x: x["bbox"])
        edge = lambda i, f: f(F.transform(boxes, lambda b: G.at(b, i)))
        box = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
        return F.when(F.size(part) > 0, F.struct(F.lit(label).alias("label"), box.alias("bbox"), F.lit(position).alias("position")))

    placed = F.filter(lines, lambda x: F.size(x["bbox"]) == 4)
    top = F.filter(placed, lambda x: G.at(x["bbox"], 3) <= cut)
    rest = F.filter(placed, lambda x: G.at(x["bbox"], 3) > cut)
    return F.array_compact(F.array(around(top, "Header", 0), around(rest, "Paragraph", 1)))


def body_scores(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds the body score of each line of a handwritten page and whether it is kept, and marks where the body starts.

    lines: (record_id, page_pos, line_no, text, bbox, page_height). +4 like a prescription, +2 for a form word, a dose or
    a frequency code each, +1 in the lower 70 % of the page, -3 for words of hospitals, doctors and web addresses. Lines
    from 1 point on are kept; the body starts at the first of 4 and more.
    """
    d = E.with_signals(lines.withColumn("_c", E.clean_line(F.col(text))), "_c")
    low = F.lower("_c")

    def points(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    score = (
        points(F.col("prescription"), 4) + points(low.rlike(r"^(?:adv|rx|tab|cap|syp|gel)"), 2) + points(F.col("_c").rlike(E.DOSE), 2) + points(F.col("_c").rlike(E.FREQUENCY), 2)
        + points(G.at(F.col("bbox"), 1) >= 0.30 * F.col("page_height"), 1) - points(low.rlike(words(["hospital", "clinic", "doctor", "dr", "www", "consultant"])), 3)
    )
    d = d.withColumn("body_score", score).drop("footer", "explicit", "narrative", "score", "prescription", "_c")
    first = F.min(F.when(F.col("body_score") >= 4, F.col("line_no"))).over(Window.partitionBy(*PAGE))
    return d.withColumn("keep", F.col("body_score") >= 1).withColumn("segment", F.when(first.isNull() | (F.col("line_no") < first), "header").when(G.at(F.col("bbox"), 1) >= 0.94 * F.col("page_height"), "footer").otherwise("body"))


def lines_to_blocks(pages: DataFrame) -> DataFrame:
    """Recognised lines as blocks: (record_id, page_pos, block_pos, type, text, bbox, confidence, needs_review)."""
    d = pages.select(*PAGE, F.posexplode("lines").alias("block_pos", "l"))
    return d.where("trim(l.text) <> ''").select(*PAGE, "block_pos", F.lit("paragraph").alias("type"), T.squeeze(F.col("l.text")).alias("text"), F.col("l.bbox").alias("bbox"), F.col("l.confidence").alias("confidence"), F.coalesce(F.col("l.confidence") < 0.70, F.lit(True)).alias("needs_review"))


def table_rows(grid: Column) -> Column:
    """Rows of (k, v) cells from a grid of texts: the first row names the columns; cells beyond it are named column_<i>."""
    head = F.coalesce(F.get(grid, F.lit(0)), F.expr("CAST(array() AS array<string>)"))

    def named(row: Column) -> Column:
        return F.transform(row, lambda v, i: F.struct(F.coalesce(F.nullif(F.trim(F.get(head, i)), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("k"), v.alias("v")))

    return F.when(F.size(grid) > 1, F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), named)).otherwise(F.expr("CAST(array() AS array<array<struct<k:string,v:string>>>)"))


def best_reading(readings: Column) -> Column:
    """Of readings (text, confidence) the surest with a text; the longer on ties; null for none."""
    full = F.filter(readings, lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != "")
    ranked = F.array_sort(F.transform(full, lambda r: F.struct((-F.coalesce(r["confidence"], F.lit(0.0))).alias("c"), (-F.length(r["text"])).alias("l"), r["text"].alias("text"))))
    return F.get(ranked, F.lit(0))["text"]


def by_route(pages: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], page_class: str = "page_class") -> DataFrame:
    """Each page class to its extractor, the results put together; unknown pages go to the 'unknown' extractor if there is one."""
    known = [c for c in routes if c != "unknown"]
    parts = [f(pages.where(F.col(page_class) == c)) for c, f in routes.items() if c != "unknown"]
    if "unknown" in routes:
        parts.append(routes["unknown"](pages.where(~F.col(page_class).isin(*known) | F.col(page_class).isNull())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pair_spans(questions: list[dict], answers: list[dict], back: float = 30, reach: float = 80) -> list[tuple[str, str, float]]:
    """(question, answer, confidence) of spans {text, bbox, confidence}: each question takes the nearest free answer that
    begins at most `back` left of it and lies within `reach` of its middle; the confidence is the mean of both."""
    out, free = [], list(answers)
    mid = lambda s: (s["bbox"][1] + s["bbox"][3]) / 2
    for q in questions:
        near = [(abs(mid(a) - mid(q)), a["bbox"][0], i) for i, a in enumerate(free) if a["bbox"][0] >= q["bbox"][0] - back and abs(mid(a) - mid(q)) <= reach]
        if near:
            a = free.pop(min(near)[2])
            out.append((q["text"], a["text"], (q["confidence"] + a["confidence"]) / 2))
    return out
