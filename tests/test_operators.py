"""Core operators on small fixtures and against plain Python."""

import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as T
from quirelake.operators import audit, chunk, extract, layout, ocr, privacy, registry, retrieval, sequence
from quirelake.sources.tables import block_texts, schema_of
from quirelake.streaming import ingest


def one(spark, column, schema="x string", value=("",)):
    return spark.createDataFrame([value], schema).select(column.alias("r")).head()["r"]


def test_packing_against_plain(spark):
    sizes = [100, 90, 50, 200, 10]
    units = ["w " * (n - 1) + "w" for n in sizes]
    got = one(spark, T.pack_units(F.col("x"), 220, 0), "x array<string>", (units,))
    assert [[len(u.split()) for u in p] for p in got] == [[100, 90], [50], [200, 10]]
    with_tail = one(spark, T.pack_units(F.col("x"), 100, 50), "x array<string>", (["a " * 39 + "a", "b " * 39 + "b", "c " * 39 + "c"],))
    assert [len(p) for p in with_tail] == [2, 2]
    assert one(spark, T.pack_units(F.col("x")), "x array<string>", ([],)) == []


def test_quality_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n ",), ("One two three four five six seven.",), ("§§§§ %%% ###",), ("same line here\n" * 20,)], "x string")
    assert [r["q"] for r in T.with_quality(df, "x").select(F.col("quality").alias("q")).collect()] == ["empty", "empty", "empty", "good", "poor", "poor"]


def test_sections(spark):
    df = spark.createDataFrame([("Diagnosis: gout",), ("Planned for today",), ("FINDINGS",), ("Follow-up - in May",), ("x",)], "x string")
    got = [r["s"] and (r["s"]["section"], r["s"]["body"], r["s"]["only"]) for r in df.select(T.section(F.col("x")).alias("s")).collect()]
    assert got == [("diagnosis", "gout", False), None, ("findings", "", True), ("follow up", "in May", False), None]


def test_medication_line(spark):
    df = spark.createDataFrame([("Tab. Pantop 40 mg OD x 7 days", 0.9), ("write to info@example.org", 0.9), (None, 0.9), ("", 0.5), ("Cap Xyzol 5 mg l-0-I x l days", 0.4)], "line string, confidence double")
    rows = extract.medications(df).collect()
    assert [(r["medication"], r["dose"], r["frequency"], r["duration"], r["form"], r["needs_review"]) for r in rows] == [("Pantop", "40 mg", "OD", "7 days", "Tab", False), ("Xyzol", "5 mg", "1-0-1", "1 days", "Cap", True)]


def test_labs(spark):
    df = spark.createDataFrame([("LDL 131 mg/dL\nCreatinine 0.9",), (None,), ("nothing",)], "text string")
    assert [(r["test_name"], r["value"], r["unit"]) for r in extract.labs(df).collect()] == [("LDL", "131", "mg/dL"), ("Creatinine", "0.9", None)]


def test_fusion(spark):
    df = spark.createDataFrame([("q", "a", 0.9, None), ("q", "b", 0.8, 1.0), ("q", "c", None, 2.0)], "query_id string, chunk_id string, semantic_score double, keyword_score double")
    got = {r["chunk_id"]: round(r["fused"], 9) for r in retrieval.reciprocal_rank(df).collect()}
    assert got == {"a": round(1 / 61, 9), "b": round(2 / 62, 9), "c": round(1 / 61, 9)}


def test_bm25_against_plain(spark):
    import math

    texts = {1: "the cat sat", 2: "the dog", 3: "", 4: None, 5: "cat cat dog the bird", 6: "CAT-dog"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    qs = spark.createDataFrame([("a", "cat cat dog"), ("b", None), ("c", "zzz")], "query_id string, query_text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(docs, qs, "id", "text").collect()}
    import re

    tok = {k: [x.lower() for x in re.findall("[A-Za-z0-9]+", v or "")] for k, v in texts.items()}
    tok = {k: v for k, v in tok.items() if v}
    avg = sum(map(len, tok.values())) / len(tok)
    exp = {}
    for k, v in tok.items():
        s = 0.0
        for w in ["cat", "cat", "dog"]:
            df = sum(w in x for x in tok.values())
            tf = v.count(w)
            s += math.log(1 + (len(tok) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(v) / avg))
        if s > 0:
            exp[("a", k)] = s
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_vector_topk_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    q = df.where("id % 10 = 0 AND id < 60").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.vector_topk(q, df, k=4, query_block=2, vector_block=16).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, ids in got.items():
        assert ids == set(np.argsort(-(u @ u[i]))[:4].tolist())
    assert len(got) == 6


def test_name_phrases():
    assert retrieval.name_phrases("What is the dose of Dr. Ann Lee") == ["Dr. Ann Lee", "Ann Lee"]
    assert retrieval.name_phrases("history of Bo Ray's cough") == ["Bo Ray"]
    assert retrieval.name_phrases(None) == [] and retrieval.name_phrases("  ") == []


def test_spans(spark):
    spans = [(0, 5, "A", 0.9, 1), (3, 12, "B", 0.9, 1), (6, 8, "C", 0.9, 1)]
    got = one(spark, privacy.pick_spans(F.col("x")), "x array<struct<start:int,end:int,kind:string,score:double,priority:int>>", (spans,))
    assert [(s["start"], s["end"]) for s in got] == [(0, 5), (6, 8)]


def test_redaction(spark):
    text = "Patient Name: Ann Lee, MRN: A1234 born, DOB: 01/02/1980. Mail a.b@example.org"
    df = spark.createDataFrame([(text,), (None,), ("",)], "x string")
    got = [r["r"] for r in df.select(privacy.redact(F.col("x"), privacy.pick_spans(privacy.find_spans(F.col("x")))).alias("r")).collect()]
    assert got == ["Patient Name: [PATIENT_NAME], MRN: [MRN] born, DOB: [DATE_OF_BIRTH]. Mail [EMAIL]", None, ""]


def test_hmac(spark):
    v = "Ünïcode value"
    assert one(spark, privacy.hmac_hex(F.col("x"), b"k1"), value=(v,)) == hmac.new(b"k1", v.encode(), hashlib.sha256).hexdigest()
    assert one(spark, privacy.identity(F.col("x"), b"k1"), value=("  ",)) is None


def test_identity_maps(spark):
    df = spark.createDataFrame([("Name: Ann Lee, Name: Bo Ray. MRN 12345",), ("nothing",), (None,)], "chunk_text string")
    rows = privacy.index_documents(df, key=b"k").collect()
    want = lambda v: hmac.new(b"k", v.encode(), hashlib.sha256).hexdigest()
    assert [(x["name"], x["digest"]) for x in rows[0]["identity_list"]] == [("patient_name", want("ann lee")), ("patient_name", want("bo ray")), ("mrn", want("12345"))]
    assert rows[0]["identity_hmacs"] == {"patient_name": want("bo ray"), "mrn": want("12345")} and rows[1]["identity_hmacs"] == {} and rows[2]["identity_list"] in ([], None)


def test_index_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id int, text string")
    ix = retrieval.keyword_index(docs, "id", "text")
    assert sorted(map(tuple, ix["term_stats"].collect())) == [("a", 1, 2), ("b", 2, 2)] and tuple(ix["corpus_stats"].head()) == (2, 2.0)
    retrieval.save_index(ix, str(tmp_path), 2)
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 3


def test_form_chunks(spark):
    pairs = spark.createDataFrame([(1, 0, 0, "name", "Ann"), (1, 0, 1, "dob", "1.1.1980"), (1, 0, 2, "name", "Ann"), (1, 1, 0, "rx", "x")], "record_id bigint, page_pos int, pair_no int, label string, value string")
    got = sorted((r["page_pos"], r["pair_no"], r["entity_focus"], r["chunk_text"]) for r in chunk.form_chunks(pairs).collect())
    assert got == [(0, -1, "demographic_profile", "Patient Name: Ann\nDate of Birth: 1.1.1980"), (0, 0, "form_field", "Patient Name: Ann"), (0, 1, "form_field", "Date of Birth: 1.1.1980"), (1, 0, "form_field", "Prescription: x")]


def test_spans_pair():
    s = lambda t, x, y, c=0.8: {"text": t, "bbox": [x, y, x + 50, y + 10], "confidence": c}
    assert ocr.pair_spans([s("Name", 0, 0), s("Date", 0, 40)], [s("Ann", 80, 2, 0.6), s("1980", 80, 42), s("far", 80, 400)]) == [("Name", "Ann", 0.7), ("Date", "1980", 0.8)]
    assert ocr.pair_spans([], [s("x", 0, 0)]) == []


def test_audit_pages(spark):
    log = spark.createDataFrame([(f"2025-01-{d:02d}T00:00:00Z#x{d}", f"2025-01-{d:02d}") for d in range(1, 8)], "accessed_at string, d string").withColumn("accessed_day", F.to_date("d"))
    first = [r["accessed_at"] for r in audit.page(log, 3).collect()]
    second = [r["accessed_at"] for r in audit.page(log, 3, audit.cursor_of(first[-1])).collect()]
    assert first[0] > first[-1] > second[0] and len(second) == 3
    assert [r["accessed_at"] for r in audit.page(log, 3, "broken").collect()] == first
    assert audit.page(log, 9, first="2025-01-03", last="2025-01-04").count() == 2


def test_geometry(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), F.array(*map(F.lit, (5.0, 5.0, 15.0, 25.0)))
    assert one(spark, G.covered(a, b)) == 0.25 and one(spark, G.x_overlap(a, b)) == 0.5
    assert one(spark, G.union(F.lit(None).cast("array<double>"), b)) is None
    assert one(spark, G.polygon_box(F.array(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(4.0), F.lit(2.0))))) == [1.0, 2.0, 4.0, 9.0]


def test_layout_folds():
    base = {"type": "paragraph", "layout_label": None, "region": None, "column_index": 0, "source": "s", "confidence": 0.8}
    rows = [{**base, "text": "a", "bbox": [0, 0, 10, 10]}, {**base, "text": "b", "bbox": [5, 20, 12, 30], "confidence": 0.6}, {**base, "text": "c", "bbox": [0, 90, 10, 99]}]
    got = layout.merge_paragraphs(rows)
    assert [(g["text"], g["bbox"], g["confidence"]) for g in got] == [("a\nb", [0, 0, 12, 30], 0.7), ("c", [0, 90, 10, 99], 0.8)]
    assert layout.cluster_columns([(0, 100), (300, 400), (5, 110), (310, 390)], 600) == [0, 1, 0, 1]
    fits = lambda k, v: (k == "dob") == v[0].isdigit()
    assert layout.pair_labels(["name", "dob", "name"], ["Ann", "1980", "x", "y"], fits) == [("name", "Ann"), ("dob", "1980"), ("name", "x")]
    assert layout.pair_labels([], ["x"], fits) == []
    lines = [{"text": "Tab. A 5 mg", "bbox": [0, 0, 100, 10]}, {"text": "od x 5 days after food", "bbox": [0, 12, 90, 20]}, {"text": "Cap B 1 mg", "bbox": [0, 25, 100, 30]}]
    groups = layout.merge_lines(lines, 800, lambda t: " mg" in t, lambda t: t.startswith("od"))
    assert [len(g) for g in groups] == [2, 1]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("b", 2, "n"), ("b", 3, "m"), ("c", None, "z")], "k string, t int, v string")
    got = sorted(map(tuple, registry.upsert(old, new, ["k"], ["t", "v"]).collect()))
    assert got == [("a", 1, "x"), ("b", 3, "m"), ("c", None, "z")]
    assert one(spark, registry.sorted_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert one(spark, registry.read_map(F.col("x")), value=("",)) == {}


def test_ordered_groups(spark):
    rows = [(1, i, i // 7, chr(97 + i % 3), 1 if i % 4 == 0 else 0) for i in range(40)] + [(2, 5, 0, "z", 1)]
    df = spark.createDataFrame(rows, "u int, t int, b int, v string, n int")
    got = sequence.with_running_sum(sequence.with_previous(df, "u", ["t"], "v", F.col("b"), "p"), "u", ["t"], "n", F.col("b"), "s").orderBy("u", "t").collect()
    prev, total = {}, {}
    for r in got:
        assert r["p"] == prev.get(r["u"])
        total[r["u"]] = total.get(r["u"], 0) + r["n"]
        assert r["s"] == total[r["u"]]
        prev[r["u"]] = r["v"]


def test_stream_states(spark, tmp_path):
    old = spark.createDataFrame([("j1", 1, 50)], "job_id string, updated_at int, progress int")
    new = spark.createDataFrame([("j1", 2, 140), ("j2", 1, -3)], "job_id string, updated_at int, progress int")
    assert sorted(map(tuple, ingest.job_states(old, new).collect())) == [("j1", 2, 100), ("j2", 1, 0)]
    run = ingest.ingest_into(str(tmp_path / "reg"))
    batch = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c")], "file_hash string, f string")
    run(batch, 0)
    run(batch.union(spark.createDataFrame([("h3", "d")], "file_hash string, f string")), 1)
    assert sorted(r["file_hash"] for r in spark.read.parquet(str(tmp_path / "reg")).collect()) == ["h1", "h2", "h3"]


def test_block_positions(spark):
    pages = [None, {"page_number": None, "page_type": None, "blocks": [None, {"text": "x"}]}, {"blocks": None}]
    df = spark.createDataFrame([(7, pages)], "record_id bigint, pages " + schema_of("payload")["pages"].dataType.simpleString())
    assert [tuple(r) for r in block_texts(df).collect()] == [(7, 1, 1, "x")]


@pytest.mark.parametrize("fn, args, want", [(T.safe_file_name, ("../a b?.pdf",), "a_b_.pdf"), (T.safe_file_name, ("..",), "upload.bin"), (T.folded, ("Ab-c, D!",), "ab c d"), (T.label_key, ("Patient Name :",), "name"), (T.label_key, ("Other",), None)])
def test_text_functions(spark, fn, args, want):
    assert one(spark, fn(F.col("x")), value=args) == want
