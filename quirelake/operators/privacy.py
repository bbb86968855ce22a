"""Labelled personal data in texts for reading by role: spans, masking, keyed digests, masked contexts."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:int,end:int,kind:string,score:double,priority:int>>"
# Labelled patterns with their score; the kind decides placeholder and priority.
_NEXT = r"(?=\s+(?:uhid|uid|patient\s*id|ip\s*no|ip\s*number|mrn|dob|date\s*of\s*birth|phone|email)\b|[.;,]|$)"
PATTERNS = (
    ("PATIENT_NAME", 0.90, re.compile(r"\b(?:patient\s*name|name)\s*:\s*[a-z][a-z .'-]{1,80}?" + _NEXT, re.I)),
    ("UHID", 0.90, re.compile(r"\b(?:uhid|uid|patient\s*id)\s*[:#-]?\s*(?=[a-z/-]*\d)[a-z0-9/-]{4,}", re.I)),
    ("IP_NUMBER", 0.90, re.compile(r"\b(?:ip\s*no|ip\s*number)\s*[.:#-]?\s*(?=[a-z/-]*\d)[a-z0-9/-]{3,}", re.I)),
    ("MRN", 0.90, re.compile(r"\b(?:mrn|medical\s*record\s*number)\s*[:#-]?\s*(?=[a-z/-]*\d)[a-z0-9/-]{3,}", re.I)),
    ("DATE_OF_BIRTH", 0.90, re.compile(r"\b(?:dob|date\s*of\s*birth)\s*[:#-]?\s*\d[\d./-]{3,}\d", re.I)),
    ("AGE", 0.85, re.compile(r"\b\d{1,3}\s*(?:yrs?|years?(?:[\s-]*old)?|y/?o|mos?|months?(?:[\s-]*old)?)\b|\b\d{1,3}-year-old\b", re.I)),
    ("AGE", 0.70, re.compile(r"\b\d{1,3}\s*days?(?:[\s-]*old)?\b", re.I)),
    ("AGE", 0.90, re.compile(r"\b(?:age|aged)\s*[:#-]?\s*\d{1,3}\b", re.I)),
    ("EMAIL", 0.95, re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("DATE", 0.60, re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b")),
    ("PHONE", 0.60, re.compile(r"(?<![\w.])(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\)[ -]?)?\d{3,5}[ .-]\d{3}[ .-]?\d{3,4}\b")),
)
PRIORITY = {"PATIENT_NAME": 5, "UHID": 5, "IP_NUMBER": 5, "MRN": 5, "DATE_OF_BIRTH": 4, "EMAIL": 3, "PHONE": 2, "DATE": 1, "AGE": 1}
LABELLED = {"PATIENT_NAME": "Patient Name: ", "UHID": "UHID: ", "IP_NUMBER": "IP No: ", "MRN": "MRN: ", "DATE_OF_BIRTH": "DOB: "}
GENERIC = {"[PATIENT_NAME]": "[PERSON]", "[DATE_OF_BIRTH]": "[DATE]", "[PHONE]": "[CONTACT]", "[EMAIL]": "[CONTACT]", "[UHID]": "[ID]", "[MRN]": "[ID]", "[IP_NUMBER]": "[ID]"}


def spans_in(text: str | None) -> list[tuple[int, int, str, float, int]]:
    return [(m.start(), m.end(), kind, score, PRIORITY[kind]) for kind, score, rx in PATTERNS for m in rx.finditer(text or "")]


def find_spans(text: Column, recogniser=spans_in) -> Column:
    """All spans of a text, in batches of texts. recogniser: text -> [(start, end, kind, score, priority)], such as a model."""

    @F.pandas_udf(SPAN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "kind", "score", "priority"), x)) for x in recogniser(t)])

    return run(text)


def pick_spans(spans: Column) -> Column:
    """Spans that don't overlap: by start, the longer first, then priority, then score; each that begins after the last kept one."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-(s["end"] - s["start"])).alias("l"), (-s["priority"]).alias("p"), (-s["score"]).alias("c"), s["kind"].alias("kind"), s["end"].alias("end"))))
    zero = F.struct(F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string>>)").alias("kept"), F.lit(0).alias("last"))

    def step(acc, s):
        take = s["start"] >= acc["last"]
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(one))).otherwise(acc["kept"]).alias("kept"), F.when(take, s["end"]).otherwise(acc["last"]).alias("last"))

    return F.aggregate(keyed, zero, step, lambda a: a["kept"])


def placeholder(kind: Column) -> Column:
    """'[KIND]', with the label before it for labelled kinds."""
    label = F.lit("")
    for k, v in LABELLED.items():
        label = F.when(kind == k, v).otherwise(label)
    return F.concat(label, F.lit("["), kind, F.lit("]"))


def redact(text: Column, spans: Column) -> Column:
    """The text with its chosen spans replaced by placeholders."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), placeholder(s["kind"])).alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def generalise(text: Column) -> Column:
    """Kinds of placeholders folded to person, date, contact and id."""
    out = text
    for seen, put in GENERIC.items():
        out = F.replace(out, F.lit(seen), F.lit(put))
    return out


def secret() -> bytes:
    """The key of the digests from QUIRELAKE_HMAC_KEY; a fixed key for tests where it is unset. Never part of a result."""
    return os.environ.get("QUIRELAKE_HMAC_KEY", "quirelake-test-key-only").encode()


def hmac_hex(value: Column, key: bytes | None = None) -> Column:
    """HMAC-SHA256 of a string's UTF-8 bytes in hex, by two SHA-256 with padded keys; all in the JVM. Null stays null."""
    k = key if key is not None else secret()
    if len(k) > 64:
        raise ValueError("keys over 64 bytes are not supported")
    k = k.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256))), 256)


def identity(value: Column, key: bytes | None = None) -> Column:
    """Digest of a value regardless of case and of blanks around it; null for an empty one."""
    v = F.nullif(F.lower(F.trim(value)), F.lit(""))
    return hmac_hex(v, key)


def authorised(role: Column) -> Column:
    return F.coalesce(F.lower(F.trim(role)) == "doctor", F.lit(False))


def masked_document(document_id: Column, key: bytes | None = None) -> Column:
    return F.concat(F.lit("doc_"), F.substring(identity(document_id, key), 1, 12))


def context(cands: DataFrame, role: str = "role", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids and texts as the role may see them: masked document, the chunk's number alone and the masked text unless authorised.

    keep: columns that are carried along; several chunks of a query may have one masked number.
    """
    ok = authorised(F.col(role))
    spans = pick_spans(find_spans(F.col("text")))
    return cands.select(
        "query_id", F.when(ok, F.col("chunk_id")).otherwise(F.substring_index("chunk_id", ":", -1)).alias("chunk_ref"), F.when(ok, F.col("document_id")).otherwise(masked_document(F.col("document_id"))).alias("document_ref"),
        ok.alias("authorized"), F.when(ok, F.col("text")).otherwise(generalise(redact(F.col("text"), spans))).alias("content"), *keep,
    )


def identities(text: Column, spans: Column, key: bytes | None = None) -> Column:
    """Ordered list of (name, digest) of the chosen spans' values, labels taken off; dates and ages have none."""
    value = lambda s: F.regexp_replace(F.substring(text, s["start"] + 1, s["end"] - s["start"]), r"(?i)^(?:patient\s*name|name|uhid|uid|patient\s*id|ip\s*no|ip\s*number|mrn|medical\s*record\s*number|dob|date\s*of\s*birth)\s*[.:#-]?\s*", "")
    kept = F.filter(spans, lambda s: ~s["kind"].isin("DATE", "AGE"))
    return F.transform(kept, lambda s: F.struct(F.lower(s["kind"]).alias("name"), identity(value(s), key).alias("digest")))


def identity_map(listed: Column) -> Column:
    """name -> digest of an identity list; of several values of one name the last holds."""
    names = F.array_distinct(F.transform(listed, lambda x: x["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(listed, lambda x: x["name"] == n), -1)["digest"])))


def index_documents(chunks: DataFrame, text: str = "chunk_text", key: bytes | None = None) -> DataFrame:
    """Chunks as they go to the index: the raw text with the digests of its identities beside it, in a map and in order."""
    d = chunks.withColumn("_s", pick_spans(find_spans(F.coalesce(F.col(text), F.lit("")))))
    d = d.withColumn("identity_list", identities(F.col(text), F.col("_s"), key)).drop("_s")
    return d.withColumn("identity_hmacs", identity_map(F.col("identity_list")))
