"""Page routing and review flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quirelake.functions import geometry as G
from quirelake.operators.retrieval import words

TINY, MOSTLY = 0.02, 0.70
# Hints of handwritten prescriptions in file names and texts, and of forms in crops.
NAME_HINTS = ("rx", "prescription", "tablet", "capsule", "syrup", "tab", "handwritten", "script")
TEXT_HINTS, TEXT_MARKERS = ("rx", "sig", "tab", "caps"), ("adv:", "cc:", "diagnosis", "dose", "stat", "od", "bd", "days")
FORM_HINTS = ("name", "dob", "address", "phone", "signature", "date of birth", "patient id", "mrn")


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def image_coverage(page_area: Column, boxes: Column, tiny: float = TINY) -> Column:
    """Struct (coverage, images): share of the page that boxes of at least `tiny` of it take, and how many they are."""
    areas = F.filter(F.transform(F.coalesce(boxes, F.expr("CAST(array() AS array<array<double>>)")), G.area), lambda a: a.isNotNull() & (a / page_area >= tiny))
    total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)
    return F.when(page_area > 0, F.struct((total / page_area).alias("coverage"), F.size(areas).alias("images"))).otherwise(F.struct(F.lit(0.0).alias("coverage"), F.lit(0).alias("images")))


def handwritten(file_name: Column, text: Column, good: Column, mostly_image: Column) -> Column:
    stem = F.regexp_replace(F.lower(F.coalesce(file_name, F.lit(""))), r"^.*/|\.[a-z0-9]+$", "")
    named = F.arrays_overlap(F.split(stem, "[_-]"), F.array(*[F.lit(h) for h in NAME_HINTS]))
    low = F.lower(F.coalesce(text, F.lit("")))
    dose = low.rlike(words([r"\d+\s?(?:mg|mcg|ml|g)"]))
    return (named & mostly_image) | (_any(low, TEXT_HINTS) & ~good) | (mostly_image & (_any(low, TEXT_MARKERS) | dose))


def page_class(is_handwritten: Column, good: Column, images: Column, mostly_image: Column) -> Column:
    return (
        F.when(is_handwritten, "handwritten_prescription").when(good & (images == 0), "copyable_pdf").when(good, "mixed_pdf").when(mostly_image, "fully_scanned_report_form_table").otherwise("unknown")
    )


def crop_class(width: Column, height: Column, text: Column) -> Column:
    """Struct (label, confidence) of an image crop by its size and text."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def is_(label: str, confidence: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (
        F.when(width * height < 15_000, is_("noise", 0.65)).when(_any(low, FORM_HINTS), is_("form", 0.78)).when(low.rlike("[0-9]") & ~F.contains(low, F.lit(":")) & (width > height), is_("report", 0.72))
        .when(F.contains(low, F.lit(":")), is_("printed", 0.70)).otherwise(is_("unknown", 0.55))
    )


def page_review(page_type: Column, blocks: Column) -> Column:
    """Whether a page is to be reviewed: an error or unknown page, or one with a flagged block."""
    flagged = F.exists(F.coalesce(blocks, F.expr("array()")), lambda b: F.coalesce(b["needs_review"], F.lit(False)))
    return F.coalesce(page_type.isin("unknown", "error"), F.lit(False)) | F.coalesce(flagged, F.lit(False))


def flagged_blocks(blocks: Column) -> Column:
    return F.size(F.filter(F.coalesce(blocks, F.expr("array()")), lambda b: F.coalesce(b["needs_review"], F.lit(False))))
