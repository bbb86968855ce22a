"""Unit readings, numbers and the units of table rows."""

import pytest
from conftest import DATA

from quirelake.operators.units import Units, harmonise, number, resolve, split_value


@pytest.fixture(scope="module")
def units(spark):
    return Units([r.asDict() for r in spark.read.parquet(f"{DATA}/lab_units.parquet").collect()])


@pytest.mark.parametrize(
    "quantity, text, code",
    [
        ("wbc", "G/l", "10^9/L"), ("hemoglobin", "G/L", "g/L"), ("hemoglobin", "gm%", "g/dL"), ("hemoglobin", "mM", "mmol/L"), ("crp", "mg/100 ml", "mg/dL"), ("ldl", "mg%", "mg/dL"), ("wbc", "×10⁹/L", "10^9/L"),
        ("wbc", "x10^3/µL", "10^3/uL"), ("wbc", "cells/mm3", "/uL"), ("platelets", "Lakh / cmm", "lakh/uL"), ("hba1c", "% NGSP", "%"), ("hba1c", "mmol / mol", "mmol/mol"), ("temperature", "℃", "C"), ("temperature", "deg F", "F"),
        ("height", "in.", "in"), ("height", "mtr", "m"), ("weight", "LBS", "lb"), ("creatinine", "micromol per litre", "umol/L"), ("glucose", "xyz", None), ("glucose", "", None), ("weight", "cm", None),
    ],
)
def test_unit(units, quantity, text, code):
    k = units.unit(quantity, text)
    assert (k and k.code) == code


@pytest.mark.parametrize("text, per, n", [("8,39", False, 8.39), ("154,257", True, 154257), ("12 972", True, 12972), ("1,234,567", False, 1234567), ("1.234,5", False, 1234.5), ("0.9", False, 0.9), ("x", False, None)])
def test_number(text, per, n):
    assert number(text, per) == n


def test_value_cells():
    assert split_value("~2.30 mg/dl") == ("2.30 ", "mg/dl") and split_value("pending") is None and split_value("03.01.2025") is None and split_value(None) is None and split_value("") is None


def cells(**kv):
    return [{"k": k.replace("_", " "), "v": v} for k, v in kv.items()]


def test_rows(units):
    rows = [
        cells(Test="LDL", Result="100", Unit="mg/dL"), cells(Test="LDL (mmol/L)", Result="2.5"), cells(Test="CRP", Result="pending", Unit="mg/L"), cells(Medication="x", Dose="5 mg"), None, [],
        cells(Test="Glucose", Result="90"), cells(Test="Unknown", Result="5", Unit="mg/dL"), [None, {"k": None, "v": "1"}], cells(Date="03.01.2025", Hb_g_dL="10"), [{"k": "Hb g/dL", "v": "9.1"}],
    ]
    got = {(pos, k.code) for pos, q, n, k in resolve(units, rows, "Units: Glucose in mg / dL; LDL: mg/dl")}
    assert got == {(0, "mg/dL"), (1, "mmol/L"), (6, "mg/dL"), (10, "g/dL")}
    assert not list(resolve(units, [cells(Test="Glucose", Result="90")], None))


def test_table(spark):
    lab = spark.read.parquet(f"{DATA}/lab_units.parquet")
    pay = spark.read.parquet(f"{DATA}/document_payloads.parquet")
    once, twice = harmonise(pay, lab), harmonise(pay.union(pay), lab)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(once) == key(twice) and once.count() > 0
    assert harmonise(pay.limit(0), lab).count() == 0 and harmonise(pay, lab.limit(0)).count() == 0
