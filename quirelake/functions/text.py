"""Column functions over text. Character classes are spelled out so that every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space as Unicode has it, as a class body of a pattern.
WS = r" \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE, _NON_SPACE = f"[{WS}]+", f"[^{WS}]+"
_LINE = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def squeeze(text: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, _SPACE, " "), "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, _LINE)


def squeeze_lines(text: Column) -> Column:
    """White space squeezed within each line, blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines(text), squeeze), lambda x: x != ""), "\n")


def token_list(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_extract_all(text, F.lit(_NON_SPACE), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(token_list(text))


def search_terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; the runs are cut before lowering."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters that match a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def with_quality(df: DataFrame, text: str, min_chars: int = 100, min_words: int = 6, min_alpha: float = 0.45, max_weird: float = 0.25, max_duplicate: float = 0.40) -> DataFrame:
    """Adds counts and ratios of a text and `quality`: good, poor or empty. A null text is empty.

    Each step is a column of its own, so that nothing is computed twice.
    """
    d = df.withColumn("_t", strip(F.coalesce(text, F.lit(""))))
    t = F.col("_t")
    d = d.withColumns({
        "char_count": F.length(t), "word_count": F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_/%.\-]+"), F.lit(0))), "alpha_ratio": _share(t, r"\p{L}+"),
        "weird_ratio": _share(t, rf"[^\p{{L}}\p{{N}}{WS}.,:;\-/()%]+"), "_l": F.filter(F.transform(lines(t), strip), lambda x: x != ""),
    })
    d = d.withColumn("duplicate_ratio", F.when(F.size("_l") > 0, 1 - F.size(F.array_distinct("_l")) / F.size("_l")).otherwise(0.0))
    enough = (F.col("char_count") >= min_chars) | (F.col("word_count") >= min_words)
    good = enough & (F.col("alpha_ratio") >= min_alpha) & (F.col("weird_ratio") <= max_weird) & (F.col("duplicate_ratio") <= max_duplicate)
    return d.withColumn("quality", F.when(F.col("_t") == "", "empty").when(good, "good").otherwise("poor")).drop("_t", "_l")


SECTION_ALIASES = {"medication": "medications", "lab": "labs", "prescribed medications": "prescription", "prescribed medication": "prescription", "patient instructions": "instructions", "patient instruction": "instructions", "instruction": "instructions", "follow-up": "follow up"}
SECTIONS = ("history", "chief complaint", "complaints", "findings", "impression", "plan", "assessment", "diagnosis", "prescribed medications", "prescribed medication", "medications", "medication", "prescription", "labs", "lab", "investigations", "investigation", "advice", "patient instructions", "patient instruction", "instructions", "instruction", "follow-up", "follow up", "discharge summary")


def section_name(heading: Column) -> Column:
    """A heading in its normal form: lower case, no trailing bracket or colon, aliases resolved."""
    h = F.lower(squeeze(F.regexp_replace(F.regexp_replace(heading, r"\([^)]*\)[ ]*:?[ ]*$", ""), r"[:\-][ ]*$", "")))
    out = h
    for alias, name in SECTION_ALIASES.items():
        out = F.when(h == alias, name).otherwise(out)
    return out


def section(text: Column) -> Column:
    """Struct (section, body, only) of a text that begins with a section heading; null where it doesn't.

    The heading ends at a word boundary, may carry a bracket, and is followed by a colon, a dash or the line's end.
    """
    names = "|".join(sorted(SECTIONS, key=len, reverse=True))
    pattern = rf"(?is)^[ \t\n\r]*({names})[ \t]*(?:\([^)\n]*\))?[ \t]*(?:[:\-]+|\r?\n|\r?\z)(.*)\z"
    name, body = F.regexp_extract(text, pattern, 1), strip(F.regexp_extract(text, pattern, 2))
    return F.when(name != "", F.struct(section_name(name).alias("section"), body.alias("body"), (body == "").alias("only")))


def with_section(text: Column, name: Column) -> Column:
    """'Title: text', unless there is no section or the text begins with it."""
    return F.when(name.isNull() | (name == ""), text).when(F.startswith(F.lower(text), F.lower(name)), text).otherwise(F.concat(F.initcap(name), F.lit(": "), text))


def units_of(text: Column) -> Column:
    """Lines of a text with more than one line, one of which has four tokens; else its sentences."""
    rows = F.filter(F.transform(lines(text), squeeze), lambda x: x != "")
    as_lines = (F.size(rows) > 1) & F.exists(rows, lambda x: F.size(F.split(x, " ")) >= 4)
    return F.when(as_lines, rows).otherwise(F.filter(F.split(squeeze(text), r"(?<=[.!?]) +"), lambda x: x != ""))


def cut_long(unit: Column, most: int = 320) -> Column:
    """A unit in parts of at most `most` tokens."""
    tokens = F.filter(F.split(squeeze(unit), " "), lambda x: x != "")
    parts = F.ceil(F.size(tokens) / most).cast("int")
    return F.when(parts <= 1, F.array(F.array_join(tokens, " "))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(tokens, i * most + 1, F.lit(most)), " ")))


def pack_units(units: Column, most: int = 220, overlap: int = 40) -> Column:
    """Units packed greedily to at most `most` tokens; a pack begins with the last units of the one before, up to `overlap` tokens.

    The repeated units count, so a pack may exceed `most` by them. Result: array of arrays of units.
    """
    empty = F.expr("CAST(array() AS array<string>)")
    start = F.struct(F.expr("CAST(array() AS array<array<string>>)").alias("done"), empty.alias("now"), F.lit(0).alias("n"))

    def size(u: Column) -> Column:
        return F.size(F.split(u, " "))

    def tail(pack: Column) -> Column:
        zero = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def back(acc, u):
            fits = acc["open"] & (acc["n"] + size(u) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(u), acc["kept"])).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["n"] + size(u)).otherwise(acc["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(pack), zero, back)["kept"]

    def step(acc, u):
        full = (acc["n"] + size(u) > most) & (F.size(acc["now"]) > 0)
        kept = tail(acc["now"])
        kept_n = F.aggregate(kept, F.lit(0), lambda n, x: n + size(x))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(kept, F.array(u))).otherwise(F.concat(acc["now"], F.array(u))).alias("now"),
            F.when(full, kept_n + size(u)).otherwise(acc["n"] + size(u)).alias("n"),
        )

    return F.aggregate(units, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


LABELS = {"date": "date", "patient name": "name", "name": "name", "address": "address", "dob": "dob", "date of birth": "dob", "allergies": "allergies", "allergy": "allergies", "weight": "weight", "mrn": "mrn", "patient id": "patient_id", "id": "patient_id", "rx": "rx", "prescription": "rx"}


def label_key(line: Column) -> Column:
    """The form label that a whole line is (letters, blanks and / _ -, at most 41 characters, optional colon), or null."""
    shaped = F.regexp_extract(squeeze(line), r"^([A-Za-z][A-Za-z /_\-]{0,40}?) ?:?$", 1)
    out = F.lit(None).cast("string")
    for alias, key in LABELS.items():
        out = F.when(F.lower(shaped) == alias, key).otherwise(out)
    return out


_DATE_LIKE = r"(?i)\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}|^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_DRUG_HINT = r"(?i)\d ?(?:mg|mcg|ml)([^A-Za-z]|$)|tablet|capsule|(^|[^A-Za-z])(?:tab|cap|inj|syp)([^A-Za-z]|$)"


def fits_label(key: Column, value: Column) -> Column:
    """Whether a value has the shape that its label asks for."""
    v = squeeze(value)
    word = F.size(F.split(v, " "))
    dated = v.rlike(_DATE_LIKE)
    return (
        F.when(key == "name", v.rlike(r"^[\p{L} .'\-]+$") & (word >= 2))
        .when(key == "address", ~dated & (v.rlike(r"(?i)(^|[^a-z])(street|st|road|rd|avenue|ave|lane|drive|court|row|way|close)([^a-z]|$)|,") | (v.rlike("[0-9]") & (word >= 3))))
        .when(key.isin("dob", "date"), dated)
        .when(key == "allergies", v.rlike(r"(?i)^(?:nkda|nka)$|[A-Za-z]") & ~v.rlike("[0-9]"))
        .when(key == "weight", v.rlike(r"(?i)\d+(?:\.\d+)? ?(?:kgs?|lbs?)([^a-z]|$)"))
        .when(key.isin("mrn", "patient_id"), v.rlike("[0-9]"))
        .when(key == "rx", v.rlike(_DRUG_HINT))
        .otherwise(False)
    )


CONTINUES = r"(?i)^[\-–— ]*(?:please take|take|dispense|refills?|schedule|monitor|watch|follow-up|continue|instructions?)([^A-Za-z]|$)"
BOILERPLATE = r"(?i)^(?:rx|medication and instructions|patient instructions|hello|prescribing physician|signature|date ?[:\-]? ?\d{4}-\d{2}-\d{2}|page \d+|\[your name\]|sincerely|kind regards)"


def continues_order(line: Column) -> Column:
    return line.rlike(CONTINUES)


def boilerplate(line: Column) -> Column:
    return squeeze(line).rlike(BOILERPLATE)


def starts_order(line: Column) -> Column:
    """A line that names a dose, a dosage form or a therapy and neither continues an order nor is boilerplate."""
    return line.rlike(r"(?i)\d ?mg([^A-Za-z]|$)|(^|[^A-Za-z])(?:tablets?|capsules?|therapy|cbt)([^A-Za-z]|$)") & ~boilerplate(line) & ~continues_order(line)


def fragment(line: Column, before: Column) -> Column:
    """A line that goes on with the one before: that one ends open, or this one begins in lower case or is a short end."""
    short_end = F.endswith(line, F.lit(".")) & (token_count(line) <= 4)
    return before.rlike(r"(?:of|to|for|with|and|,)$") | line.rlike(r"^\p{Ll}") | short_end


def safe_file_name(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("upload.bin"))


def folded(text: Column) -> Column:
    """Lower case, punctuation to blanks, blanks squeezed: the form in which answers are compared."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_" + WS + "]", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct n-grams of a token list; none if it is shorter."""
    return F.when(F.size(tokens) < n, F.expr("CAST(array() AS array<string>)")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))
    )


def length_confidence(text: Column) -> Column:
    n = token_count(F.coalesce(text, F.lit("")))
    return F.when(n >= 20, 0.85).when(n >= 8, 0.75).otherwise(0.65)


def field_key(name: Column) -> Column:
    """A name as a key: lower-case letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


LAYOUT_LABELS = {"table": "Table", "header": "Header", "footer": "Footer", "figure": "Figure", "image": "Figure", "form": "Form", "title": "Header", "text": "Paragraph", "paragraph": "Paragraph", "list": "Paragraph"}


def layout_label(label: Column) -> Column:
    l = F.lower(F.trim(label))
    out = F.lit("Other")
    for seen, name in LAYOUT_LABELS.items():
        out = F.when(l == seen, name).otherwise(out)
    return out


def document_context(document_id: Column) -> Column:
    """Struct (patient, doctor, hospital, mrn) from an id of the form A_B-C_D-Hospital-MRN123; nulls where it has fewer than four parts."""
    parts = F.split(document_id, "-")
    mrn = F.filter(parts, lambda p: p.rlike("^MRN[0-9]+$"))
    at = F.array_position(parts, F.get(mrn, F.lit(0)))
    ok = (F.size(parts) >= 4) & (F.size(mrn) > 0)

    def spoken(c: Column) -> Column:
        return F.replace(c, F.lit("_"), F.lit(" "))

    return F.struct(
        F.when(ok, spoken(parts[0])).alias("patient"),
        F.when(ok, F.concat(F.lit("Dr. "), spoken(parts[1]))).alias("doctor"),
        F.when(ok, F.array_join(F.transform(F.slice(parts, F.lit(3), F.greatest(at - 3, F.lit(0)).cast("int")), spoken), " ")).alias("hospital"),
        F.when(ok, F.get(mrn, F.lit(0))).alias("mrn"),
    )
