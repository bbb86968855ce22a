"""Structural indexing against the json module."""

import json
import random

from hypothesis import given, settings, strategies as st

from quirelake.operators.flatten import Index, flatten_json, walk


def brute(text):
    try:
        d = json.loads(text)
    except (ValueError, TypeError):
        return []
    out = []
    if not isinstance(d, dict):
        return out
    for i, page in enumerate(d.get("pages") or []):
        if page is None:
            continue
        out.append(("page", i, -1, -1, ""))
        for j, b in enumerate(page.get("blocks") or []):
            if b is None:
                continue
            out.append(("block", i, j, -1, ""))
            out += [("field", i, j, -1, k) for k in b.get("fields") or {}]
            out += [("meta", i, j, -1, k) for k in b.get("metadata") or {}]
            data = b.get("structured_data") or {}
            for r, row in enumerate(data.get("rows") or []):
                if isinstance(row, dict):
                    out += [("cell", i, j, r, k) for k in row]
                elif row is not None:
                    for c, x in enumerate(row):
                        if isinstance(x, dict):
                            out += [("cell", i, j, r, x["k"])] if x.get("k") is not None else []
                        else:
                            cols = data.get("columns") or []
                            out.append(("cell", i, j, r, cols[c] if c < len(cols) and cols[c] is not None else f"column_{c}"))
    return out


def ours(texts):
    w = walk(Index([None if t is None else t.encode() for t in texts]))
    return sorted(zip(w["rec"].tolist(), w["kind"], w["page_pos"].tolist(), w["block_pos"].tolist(), w["row_pos"].tolist(), w["item_key"]))


leaf = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8))
row = st.one_of(st.none(), st.dictionaries(st.text(max_size=4), leaf, max_size=3), st.lists(leaf, max_size=3), st.lists(st.fixed_dictionaries({"k": st.one_of(st.none(), st.text(max_size=3)), "v": leaf}), max_size=2))
block = st.one_of(st.none(), st.fixed_dictionaries({"text": leaf}, optional={"fields": st.one_of(st.none(), st.dictionaries(st.text(max_size=5), leaf, max_size=3)), "metadata": st.one_of(st.none(), st.dictionaries(st.text(max_size=5), leaf, max_size=2)), "structured_data": st.one_of(st.none(), st.fixed_dictionaries({"columns": st.one_of(st.none(), st.lists(st.text(max_size=3), max_size=3)), "rows": st.one_of(st.none(), st.lists(row, max_size=3))}))}))
page = st.one_of(st.none(), st.fixed_dictionaries({"blocks": st.one_of(st.none(), st.lists(block, max_size=3))}, optional={"note": leaf}))
payload = st.fixed_dictionaries({"pages": st.one_of(st.none(), st.lists(page, max_size=3))}, optional={"x": leaf})


@settings(max_examples=150, deadline=None)
@given(st.lists(payload, max_size=4), st.booleans())
def test_random_payloads(payloads, ascii_only):
    texts = [json.dumps(p, ensure_ascii=ascii_only) for p in payloads]
    assert ours(texts) == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t))


def test_validity_is_that_of_json():
    rng = random.Random(3)
    texts = ["", " ", "null", "{}", '{"a":1,}', '{"a":01}', '{"a":"\\x"}', '{"a":"\\u12g4"}', "1 2", "1,", '{"a":1}}', '"x', '{"a":"x\ny"}', "[1 2]", "-", "-1.5e+3"]
    texts += ["".join(rng.choice('{}[],:"\\a1 ') for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for t in texts:
        try:
            json.loads(t, parse_constant=lambda s: 1 / 0)
            good = True
        except (ValueError, ZeroDivisionError):
            good = False
        assert bool(Index([t.encode()]).valid[0]) == good, t


def test_cut_payloads_and_neighbours():
    whole = json.dumps({"pages": [{"blocks": [{"fields": {"a\"b": {"value": "v\\", "confidence": 0.5}}}]}]})
    texts = [whole[:i] for i in range(len(whole))] + [whole, None]
    assert {r[0] for r in ours(texts)} == {len(whole)}


def test_table_with_extra_columns(spark):
    rows = [(1, '{"pages":[{"blocks":[{"fields":{"x":"1"}}]}]}', "page"), (2, None, "kind"), (3, "", "value"), (4, "{", None)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, kind string")
    got = flatten_json(df, "record_id", "payload").collect()
    assert sorted((r["record_id"], r["kind"], r["value"]) for r in got) == [(1, "block", None), (1, "field", "1"), (1, "page", None)]
    assert flatten_json(df.limit(0), "record_id", "payload").count() == 0
