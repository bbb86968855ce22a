"""Measured values in different units brought to one common unit per quantity.

A unit string is segmented by dynamic programming over tries of multipliers, prefixes, roots and exponents. Every
decomposition gets a scale and a dimension; the one with the lowest spelling cost that has the dimension of one of the
quantity's known units wins, so that "G/l" is giga per litre for a cell count and gram per litre for haemoglobin.

Defined cases: a block without rows, a row without a number, a row whose quantity or unit is unknown and a row of
medication give no row. A number may carry <, > or ~ and use a comma or blank as separator; three digits after a single
comma are thousands for counts per volume and decimals otherwise. A unit is looked for in the row's unit cell, the value
cell, the name cell or column name, the reference cell and last in the block's text. Repeated records give equal rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirelake.session import spread

# Spellings of SI prefixes, unit roots (scale, dimension) and multipliers.
# Dimension: powers of (gram, mole, metre, percent, degree Celsius, degree Fahrenheit).
PREFIXES = {"": 0, "p": -12, "n": -9, "nano": -9, "u": -6, "μ": -6, "mc": -6, "micro": -6, "m": -3, "milli": -3, "c": -2, "centi": -2, "d": -1, "deci": -1, "k": 3, "kilo": 3}
_G, _MOL, _M, _PCT, _C, _F = ((1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1))
_L, _ONE = (0, 0, 3, 0, 0, 0), (0, 0, 0, 0, 0, 0)
ROOTS = {
    "g": (1.0, _G, True), "gm": (1.0, _G, True), "gms": (1.0, _G, True), "gr": (1.0, _G, False), "gram": (1.0, _G, True), "grams": (1.0, _G, True), "gramm": (1.0, _G, True), "gramme": (1.0, _G, True), "grammes": (1.0, _G, True), "gs": (1.0, _G, True),
    "lb": (453.592, _G, False), "lbs": (453.592, _G, False), "pound": (453.592, _G, False), "pounds": (453.592, _G, False),
    "mol": (1.0, _MOL, True), "mole": (1.0, _MOL, True), "moles": (1.0, _MOL, True), "mols": (1.0, _MOL, True), "M": (1e3, (0, 1, -3, 0, 0, 0), True), "molar": (1e3, (0, 1, -3, 0, 0, 0), True),
    "l": (1e-3, _L, True), "liter": (1e-3, _L, True), "liters": (1e-3, _L, True), "litre": (1e-3, _L, True), "litres": (1e-3, _L, True), "ltr": (1e-3, _L, True), "cc": (1e-6, _L, False),
    "cumm": (1e-9, _L, False), "cmm": (1e-9, _L, False), "cu mm": (1e-9, _L, False), "cu.mm": (1e-9, _L, False), "cubic mm": (1e-9, _L, False),
    "m": (1.0, _M, True), "meter": (1.0, _M, True), "meters": (1.0, _M, True), "metre": (1.0, _M, True), "metres": (1.0, _M, True), "mtr": (1.0, _M, False), "mtrs": (1.0, _M, False), "in": (0.0254, _M, False), "ins": (0.0254, _M, False), "inch": (0.0254, _M, False), "inches": (0.0254, _M, False), "\"": (0.0254, _M, False), "ft": (0.3048, _M, False), "feet": (0.3048, _M, False),
    "%": (1.0, _PCT, False), "percent": (1.0, _PCT, False), "per cent": (1.0, _PCT, False), "pct": (1.0, _PCT, False),
    "C": (1.0, _C, False), "°C": (1.0, _C, False), "celsius": (1.0, _C, False), "centigrade": (1.0, _C, False), "deg C": (1.0, _C, False), "degree C": (1.0, _C, False), "degrees C": (1.0, _C, False), "degC": (1.0, _C, False), "degrees celsius": (1.0, _C, False), "deg celsius": (1.0, _C, False), "° C": (1.0, _C, False),
    "F": (1.0, _F, False), "°F": (1.0, _F, False), "fahrenheit": (1.0, _F, False), "deg F": (1.0, _F, False), "degree F": (1.0, _F, False), "degrees F": (1.0, _F, False), "degF": (1.0, _F, False), "degrees fahrenheit": (1.0, _F, False), "deg fahrenheit": (1.0, _F, False), "° F": (1.0, _F, False),
    "cells": (1.0, _ONE, False), "cell": (1.0, _ONE, False), "count": (1.0, _ONE, False),
    "lakh": (1e5, _ONE, False), "lakhs": (1e5, _ONE, False), "lac": (1e5, _ONE, False), "lacs": (1e5, _ONE, False), "thou": (1e3, _ONE, False), "thousand": (1e3, _ONE, False), "thousands": (1e3, _ONE, False), "K": (1e3, _ONE, False), "G": (1e9, _ONE, False), "giga": (1e9, _ONE, False), "mill": (1e6, _ONE, False), "million": (1e6, _ONE, False), "billion": (1e9, _ONE, False), "bil": (1e9, _ONE, False),
}
NOTES = ("ifcc", "ngsp", "dcct")
_POWER = re.compile(r"[x×*]?\s*10\s*(?:\^|\*\*|\*|[eE])\s*(\d{1,2})|[x×]\s*10(\d)(?!\d)|10(?=[36912]\s*/)([36912])|(\d{1,4})(?=\s*(?:m|d|c|u|μ)?[lL]\b)")
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def _trie(words: dict) -> dict:
    root: dict = {}
    for word, value in words.items():
        node = root
        for ch in word.lower():
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((word, value))
    return root


_PREFIX_TRIE, _ROOT_TRIE = _trie(PREFIXES), _trie(ROOTS)


def _ends(trie: dict, text: str, i: int) -> Iterator[tuple[int, str, object]]:
    """All words of a trie that begin at i: (end, word, value), letters compared without case."""
    node = trie
    for hit in node.get("", ()):
        yield i, *hit
    while i < len(text) and (node := node.get(text[i].lower())) is not None:
        i += 1
        for hit in node.get("", ()):
            yield i, *hit


def tidy(text: str) -> str:
    """One spelling of look-alike signs: micro signs, degree signs, raised digits, blanks."""
    powers = re.sub(r"10([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", lambda m: "10^" + m[1].translate(_SUPER), text)
    t = unicodedata.normalize("NFKC", powers.translate(_SUPER)).replace("µ", "μ").replace("℃", "°C").replace("º", "°")
    return re.sub(r"\s+", " ", t).strip(" .,:;-[](){}|=")


@dataclass(frozen=True)
class Reading:
    """A decomposition: spelling cost, scale in base units, dimension, scale of the volume under the bar."""

    cost: float
    scale: float
    dim: tuple
    per: float


@lru_cache(maxsize=50_000)
def readings(text: str) -> tuple[Reading, ...]:
    """All decompositions of a unit string that use up the whole string, cheapest first for each meaning."""
    t = tidy(text)
    n = len(t)
    if not n or n > 40:
        return ()
    # best[i]: {(log10 scale, dimension, under the bar, per): cost} over t[:i]
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][(0.0, _ONE, False, 0.0, False)] = 0.0

    def put(i, key, cost):
        if cost < best[i].get(key, math.inf) and cost < 9:
            best[i][key] = cost

    for i in range(n):
        for (scale, dim, under, per, some), cost in list(best[i].items()):
            ch = t[i]
            if ch in " .·":
                put(i + 1, (scale, dim, under, per, some), cost)
            if ch == "/" and not under:
                put(i + 1, (scale, dim, True, per, some), cost)
            if t[i : i + 3].lower() == "per" and not under and (i + 3 == n or t[i + 3] == " "):
                put(i + 3, (scale, dim, True, per, some), cost)
            for note in NOTES:
                if some and t[i : i + len(note)].lower() == note:
                    put(i + len(note), (scale, dim, under, per, some), cost)
            if (m := _POWER.match(t, i)) and (i == 0 or not t[i - 1].isalnum()):
                power = float(m[1] or m[2] or m[3] or 0) or math.log10(int(m[4])) if (m[1] or m[2] or m[3] or int(m[4] or 0)) else None
                if power is not None:
                    put(m.end(), (round(scale + (-power if under else power), 6), dim, under, per - power if under else per, True), cost + 0.1)
            if i and t[i - 1].isalpha() and ch.isalpha():  # a factor begins at a sign, blank or digit
                continue
            for j, prefix, exponent in _ends(_PREFIX_TRIE, t, i):
                if prefix and t[i:j] != prefix:
                    wrong = 0.4
                else:
                    wrong = 0.0
                for k, root, (size, rdim, takes) in _ends(_ROOT_TRIE, t, j):
                    if k == j or (prefix and not takes) or (k < n and t[k].isalpha() and t[k - 1].isalpha()):
                        continue
                    off = wrong + (0.0 if t[j:k] in (root, "L") or (len(root) > 2 and t[j:k] == root.capitalize()) else 0.4)
                    power, stop = 1, k
                    if e := re.match(r"\^?([23])(?!\d)", t[k:]):
                        power, stop = int(e[1]), k + e.end()
                    for p, end in {(1, k), (power, stop)}:
                        sign = -p if under else p
                        size10 = (math.log10(size) + exponent) * sign
                        d = tuple(a + b * sign for a, b in zip(dim, rdim))
                        vol = (math.log10(size) + exponent) * p if under and rdim[2] * p == 3 else 0.0
                        put(end, (round(scale + size10, 6), d, under, per + vol, True), cost + off + 0.05 * bool(prefix))
                        if rdim == _PCT and dim[0] == 1 and not under:  # "mg%": per decilitre
                            put(end, (round(scale + 4, 6), (dim[0], dim[1], -3, 0, 0, 0), True, -4.0, True), cost + off)
    out = [Reading(cost, scale, dim, per) for (scale, dim, under, per, some), cost in best[n].items() if some]
    return tuple(sorted(out, key=lambda r: r.cost))


@dataclass
class Known:
    code: str
    common: bool
    factor: float
    shift: float
    as_read: list = field(default_factory=list)


class Units:
    """The unit table: quantities by alias, and the meaning of each unit code under its quantity."""

    def __init__(self, rows: list[dict]):
        self.aliases: dict[str, str] = {}
        self.known: dict[str, list[Known]] = {}
        for r in rows:
            for a in [*(r["aliases"] if r["aliases"] is not None else ()), r["quantity"].replace("_", " ")]:
                self.aliases[self.plain(a)] = r["quantity"]
            k = Known(r["unit_code"], r["is_common"], r["factor"], r["shift"])
            k.as_read = [x for x in readings(r["unit_code"]) if x.cost <= readings(r["unit_code"])[0].cost]
            self.known.setdefault(r["quantity"], []).append(k)
        by_length = sorted(self.aliases, key=len, reverse=True)
        self.pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(a).replace(r"\ ", r"[\s_]+").replace(r"\-", r"[\s\-‐–]?") for a in by_length) + r")(?![^\W_])", re.I)
        self.memo: dict = {}

    @staticmethod
    def plain(text: str) -> str:
        return re.sub(r"\s+", " ", text).strip().lower()

    def quantity(self, text: str) -> tuple[str, str] | None:
        """The quantity that a label names and what the label holds besides."""
        m = self.pattern.search(text)
        if not m:
            return None
        key = self.plain(re.sub(r"[_‐–]", "-", m[0]))
        q = self.aliases.get(key) or next((v for k, v in self.aliases.items() if re.sub(r"[\s\-]", "", k) == re.sub(r"[\s\-]", "", key)), None)
        return (q, text[m.end() :]) if q else None

    def unit(self, quantity: str, text: str | None) -> Known | None:
        """The known unit that a unit string means for a quantity."""
        if not text:
            return None
        at = (quantity, text)
        if at not in self.memo:
            best = None
            for r in readings(text):
                for k in self.known[quantity]:
                    for own in k.as_read:
                        if own.dim == r.dim and abs(own.scale - r.scale) < 0.02:
                            cost = r.cost + (0.3 if abs(own.per - r.per) > 0.02 else 0.0)
                            if best is None or cost < best[0]:
                                best = (cost, k)
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[at] = best and best[1]
        return self.memo[at]

    def unit_in(self, quantity: str, text: str | None) -> Known | None:
        """The unit stated in a label: the whole of it, a bracket, or what follows a separator or 'in'."""
        if not text:
            return None
        for part in (text, *re.findall(r"[(\[]([^)\]]*)[)\]]", text), re.sub(r"^[\s,:;=/\-–|]*(?:in|as|is|are|=)?\s+", "", text), re.sub(r"^\s*[/|,:;]\s*", "", text)):
            if k := self.unit(quantity, part.strip()):
                return k
        return None


_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")
_NUMBER = re.compile(r"^\s*[<>~≤≥≈=]*\s*(?:ca\.?|approx\.?)?\s*([+-]?\d[\d.,'   ]*)(.*)$", re.S)
_MEDICATION = re.compile(r"\b(?:medications?|drugs?|dos(?:e|age)|frequency)\b", re.I)
_UNIT_KEY = re.compile(r"^(?:units?|uom|u/m|einheit(?:en)?|unités?|unidad(?:es)?)$", re.I)
_VALUE_KEY = re.compile(r"^(?:values?|results?|observed|measured|reading|wert|valeur|valor)\b", re.I)
_OTHER_KEY = re.compile(r"^(?:date|time|flag|ref\b.*|reference.*|normal.*|range.*|comment.*|remark.*)$", re.I)
_REF_KEY = re.compile(r"^(?:ref\b.*|reference.*|normal.*|range.*)$", re.I)


def number(text: str, per_volume: bool) -> float | None:
    """A number as written: decimal point or comma, thousands by comma, point, apostrophe or blank."""
    t = re.sub(r"[\s'  ]+(?=\d{3}(?!\d))", "", text).strip(" .,'")
    if re.fullmatch(r"[+-]?\d{1,3}(?:,\d{3})+", t) and (per_volume or t.count(",") > 1):
        t = t.replace(",", "")
    elif "," in t and "." in t:
        t = t.replace(",", "") if t.rfind(".") > t.rfind(",") else t.replace(".", "").replace(",", ".")
    else:
        t = t.replace(",", ".")
    try:
        return float(t)
    except ValueError:
        return None


def split_value(text: str | None) -> tuple[str, str] | None:
    """The number of a value cell and what follows it; None where there is no number or it is a date."""
    if not text or _DATE.search(text):
        return None
    text = text.translate(_SUPER) if not re.search(r"10[⁰¹²³⁴⁵⁶⁷⁸⁹]", text) else text
    m = _NUMBER.match(text)
    if not m:
        return None
    digits, rest = m[1], m[2]
    if (ten := re.search(r"[  ]1[0o]$", digits.rstrip())) and re.match(r"\s*[\^*eE⁰-⁹³⁶]", rest):  # "5.1 10^9/L"
        digits, rest = digits[: ten.start()], "10" + rest
    elif (c := re.match(r"^(.*[  ])(100)$", digits.rstrip())) and re.match(r"\s*m[lL]", rest):
        digits, rest = c[1], c[2] + rest
    return digits, rest


def text_units(units: Units, text: str | None) -> tuple[dict[str, Known], list[str]]:
    """Units that a block's text states for quantities, and unit strings stated for all values."""
    stated: dict[str, Known] = {}
    general: list[str] = []
    for part in re.split(r"[;\n\r]+", text or ""):
        found = units.quantity(part)
        if found:
            q, rest = found
            for piece in [rest, *rest.split("|"), *rest.split(",")]:
                if (k := units.unit_in(q, piece)) or ((v := split_value(piece)) and (k := units.unit(q, v[1].strip()))):
                    stated.setdefault(q, k)
                    break
        elif m := re.search(r"\b(?:units?|values?|results?|all)\b.*?(?:\bin\b|:|=|-)\s*(.+?)\.?\s*$", part, re.I):
            general.append(m[1])
    return stated, general


def resolve(units: Units, rows: list, text: str | None, title: str | None = None) -> Iterator[tuple]:
    """(row_pos, quantity, number, Known) of the rows of one block."""
    hints = None
    for pos, row in enumerate(rows):
        if row is None:
            continue
        cells = [(str(c["k"]), c["v"]) for c in row if c is not None and c["k"] is not None]
        if not cells or any(_MEDICATION.search(k) for k, _ in cells):
            continue
        unit_cell = next((v for k, v in cells if _UNIT_KEY.match(k) and v), None)
        refs = [v for k, v in cells if _REF_KEY.match(k) and v]
        # A label cell with a value cell, else every column that names a quantity.
        label = next((units.quantity(v) for k, v in cells if v and not _OTHER_KEY.match(k) and not _UNIT_KEY.match(k) and not _VALUE_KEY.match(k) and units.quantity(v)), None)
        if label:
            cand = [(label, v, k) for k, v in cells if _VALUE_KEY.match(k)] or [(label, v, k) for k, v in cells if not _OTHER_KEY.match(k) and not _UNIT_KEY.match(k) and v and not units.quantity(v)]
            cand = [c for c in cand if split_value(c[1])][:1]
        else:
            cand = [(q, v, k) for k, v in cells if (q := units.quantity(k)) and split_value(v)]
        for (quantity, rest), value, key in cand:
            digits, tail = split_value(value)
            k = units.unit(quantity, (unit_cell or "").strip()) or units.unit(quantity, tail.strip()) or units.unit_in(quantity, rest)
            if not k and label:
                k = units.unit_in(quantity, re.sub(_VALUE_KEY, "", key))
            for ref in refs if not k else ():
                k = k or units.unit(quantity, re.sub(r"^[\s<>≤≥]*[\d.,]+(?:\s*(?:-|–|to)\s*[\d.,]+)?", "", ref).strip())
            if not k:
                if hints is None:
                    hints = text_units(units, "\n".join(x for x in (title, text) if x))
                k = hints[0].get(quantity)
                for g in hints[1] if not k else ():
                    k = k or units.unit_in(quantity, g)
            if not k:
                continue
            per_volume = any(r.dim == (0, 0, -3, 0, 0, 0) for r in k.as_read)
            n = number(digits, per_volume and k.code.startswith("/"))
            if n is not None:
                yield pos, quantity, n, k


OUT = "record_id bigint, page_pos int, block_pos int, row_pos int, quantity string, unit_code string, is_common boolean, value double, value_common double"
_OUT = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64()]
MAX_UNITS = 10_000


def harmonise(payloads: DataFrame, lab_units: DataFrame) -> DataFrame:
    """Every measured value of the payloads' tables with its recorded unit and its value in the common unit.

    lab_units is a fixed code list; it is read to the driver behind a check of its size (MAX_UNITS rows).
    """
    table = lab_units.limit(MAX_UNITS + 1).collect()
    if len(table) > MAX_UNITS:
        raise ValueError(f"the unit table has more than {MAX_UNITS} rows")
    rows = [r.asDict() for r in table]
    pages = payloads.select("record_id", F.posexplode("pages").alias("page_pos", "page"))
    blocks = pages.select("record_id", "page_pos", F.posexplode("page.blocks").alias("block_pos", "block")).where("size(block.structured_data.rows) > 0")
    # Repeated rows of a record go before the reading, on the text of the block.
    blocks = blocks.select("record_id", "page_pos", "block_pos", F.col("block.structured_data.rows").alias("rows"), F.col("block.text").alias("text"), F.col("block.title").alias("title"))
    blocks = spread(blocks, "record_id", "page_pos", "block_pos").dropDuplicates(["record_id", "page_pos", "block_pos"])

    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches):
        units = Units(rows)
        for batch in batches:
            out = []
            for rid, pp, bp, rs, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                for pos, q, n, k in resolve(units, rs, text, title):
                    out.append((rid, pp, bp, pos, q, k.code, k.common, n, n * k.factor + k.shift))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT)], names)

    return blocks.mapInArrow(run, OUT)
