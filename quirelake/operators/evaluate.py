"""Scores of extraction and of answers against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirelake.functions import text as T

# What a question is about, by substrings of the folded question.
INTENTS = {
    "doctor": ("doctor", "dr", "physician", "consultant", "clinician"), "diagnosis": ("diagnosis", "condition", "disease", "assessment", "impression", "diagnosed"), "ip_number": ("ip number", "ip no", "ip", "patient id", "record number"),
    "hospital_stay": ("hospital stay", "days", "how many days", "stay", "recovery"), "medication": ("medication", "medicine", "drug", "prescribed", "prescription", "tablet", "dose"), "dob": ("dob", "date of birth", "born", "birth"), "mrn": ("mrn", "medical record number"),
}


def phrase_recall(truth: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, found, total, accuracy): the key phrases that one of the document's texts holds, folded; null accuracy without phrases.

    Phrases and texts meet on the document and are reduced to one flag per phrase before the next shuffle; no document's
    texts are gathered in one place.
    """
    phrases = F.filter(F.transform(F.coalesce("key_phrases", F.expr("CAST(array() AS array<string>)")), lambda p: T.folded(p)), lambda p: p.isNotNull() & (p != ""))
    t = truth.select("document_id", phrases.alias("p"))
    asked = t.select("document_id", F.explode("p").alias("phrase")).distinct()
    body = texts.select("document_id", T.folded(F.col("text")).alias("body")).distinct()
    held = asked.join(body, "document_id").where(F.contains("body", "phrase")).select("document_id", "phrase").distinct().groupBy("document_id").agg(F.collect_set("phrase").alias("held"))
    j = t.join(held, "document_id", "left")
    found = F.size(F.filter("p", lambda p: F.array_contains(F.coalesce("held", F.expr("CAST(array() AS array<string>)")), p)))
    return j.select("document_id", found.alias("found"), F.size("p").alias("total"), F.when(F.size("p") > 0, F.round(100.0 * found / F.size("p"), 1)).alias("accuracy"))


def intents(folded: Column) -> Column:
    def any_of(marks: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | F.contains(folded, F.lit(m))
        return out

    return F.array_compact(F.array(*[F.when(any_of(marks), F.lit(name)) for name, marks in INTENTS.items()]))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """0.35 words + 0.50 intents + 0.15 phrases, each by Jaccard; words and phrases damped to 0.35 where both have intents but none in common."""
    fa, fb = T.folded(F.coalesce(a, F.lit(""))), T.folded(F.coalesce(b, F.lit("")))
    wa, wb = F.filter(F.split(fa, " "), lambda x: x != ""), F.filter(F.split(fb, " "), lambda x: x != "")
    ia, ib = intents(fa), intents(fb)
    word, intent = _jaccard(F.array_distinct(wa), F.array_distinct(wb)), _jaccard(ia, ib)
    two, three = _jaccard(T.ngrams(wa, 2), T.ngrams(wb, 2)), _jaccard(T.ngrams(wa, 3), T.ngrams(wb, 3))
    phrase = F.when(two > 0, two).otherwise(three)
    damp = F.when((F.size(ia) > 0) & (F.size(ib) > 0) & (intent == 0), 0.35).otherwise(1.0)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(F.round(0.35 * word * damp + 0.50 * intent + 0.15 * phrase * damp, 4))


def answer_score(expected: Column, answer: Column) -> Column:
    """100 where the answer holds all of the expected text, else the share of its words over two letters that it holds."""
    e, a = T.folded(F.coalesce(expected, F.lit(""))), T.folded(F.coalesce(answer, F.lit("")))
    w = F.filter(F.split(e, " "), lambda x: F.length(x) > 2)
    share = F.when(F.size(w) > 0, F.round(100.0 * F.size(F.filter(w, lambda x: F.contains(a, x))) / F.size(w), 1)).otherwise(0.0)
    return F.when((e == "") | (a == ""), 0.0).when(F.contains(a, e), 100.0).otherwise(share)
