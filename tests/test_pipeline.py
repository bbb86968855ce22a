"""Configuration, recogniser hooks, the whole way from payloads to answers, the command line."""

import os

from conftest import DATA
from pyspark.sql import functions as F

from quirelake import cli, config
from quirelake.operators import ocr
from quirelake.plans import pipeline


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c.json"
    f.write_text('{"bm25": {"k1": 1.2}, "own": 1}')
    c = config.load(f, {"retrieval": {"top_k": 7}})
    assert c["bm25"] == {"k1": 1.2, "b": 0.75} and c["retrieval"]["top_k"] == 7 and c["own"] == 1 and config.DEFAULTS["bm25"]["k1"] == 1.5
    e = tmp_path / ".env"
    e.write_text("# x\nexport QL_A='1'\nQL_B=2\nbad line\n")
    monkeypatch.setenv("QL_B", "old")
    monkeypatch.delenv("QL_A", raising=False)
    assert config.load_env(e) == ["QL_A"] and os.environ["QL_B"] == "old" and config.load_env(tmp_path / "none") == []
    monkeypatch.delenv("QL_A")


def test_engine_hook(spark):
    df = spark.createDataFrame([(1, 0, bytearray(b"ok")), (2, 0, bytearray(b"bad"))], "record_id bigint, page_pos int, content binary")

    def engine(image):
        if bytes(image) == b"bad":
            raise ValueError("no image")
        return [{"text": "Tab. X 5 mg", "bbox": [0.0, 1.0, 2.0, 3.0], "confidence": 0.5}]

    got = {r["record_id"]: r for r in ocr.with_engine(df, engine).collect()}
    assert got[1]["error"] is None and got[2]["lines"] == [] and "no image" in got[2]["error"]
    blocks = ocr.lines_to_blocks(ocr.with_engine(df, engine)).collect()
    assert [(b["text"], b["needs_review"]) for b in blocks] == [("Tab. X 5 mg", True)]
    assert ocr.vision_text(lambda b: "a " * 30)(b"") == ("a " * 29 + "a", 0.85) and ocr.vision_text(engine)(b"bad") == ("", 0.0)


def test_recognised_pages(spark):
    lines = [{"text": "City Hospital", "bbox": [0.0, 5.0, 90.0, 20.0], "confidence": 0.9}, {"text": "Tab. Pantop 40 mg OD", "bbox": [0.0, 300.0, 90.0, 320.0], "confidence": 0.9}]
    df = spark.createDataFrame([(1, 0, i, x["text"], x["bbox"], 800.0) for i, x in enumerate(lines)], "record_id bigint, page_pos int, line_no int, text string, bbox array<double>, page_height double")
    got = [(r["body_score"], r["keep"], r["segment"]) for r in ocr.body_scores(df).orderBy("line_no").collect()]
    assert got == [(-3, False, "header"), (11, True, "body")]
    one = spark.createDataFrame([(lines,)], "l array<struct<text:string,bbox:array<double>,confidence:double>>")
    assert [x["label"] for x in one.select(ocr.fallback_layout(F.col("l"), F.lit(800.0)).alias("x")).head()["x"]] == ["Header", "Paragraph"]
    assert one.select(ocr.best_reading(F.col("l")).alias("x")).head()["x"] == "Tab. Pantop 40 mg OD"
    assert [w["text"] for w in one.select(ocr.prepare_words(F.col("l"), F.lit(100.0), F.lit(800.0)).alias("x")).head()["x"]] == [x["text"] for x in lines]
    grid = spark.createDataFrame([([["a", ""], ["1", "2", "3"]],), ([],)], "g array<array<string>>").select(ocr.table_rows(F.col("g")).alias("r")).collect()
    assert [[(c["k"], c["v"]) for c in row] for row in grid[0]["r"]] == [[("a", "1"), ("column_2", "2"), ("column_3", "3")]] and grid[1]["r"] == []


def test_routes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, page_class string")
    got = ocr.by_route(df, {"a": lambda d: d.withColumn("x", F.lit("A")), "unknown": lambda d: d.withColumn("x", F.lit("?"))}).collect()
    assert sorted((r["i"], r["x"]) for r in got) == [(1, "A"), (2, "?"), (3, "?")]


def test_ask(spark):
    pay = spark.read.parquet(f"{DATA}/document_payloads.parquet")
    chunks = pipeline.ingest(pay)
    assert chunks.where("chunk_index = 0").count() == chunks.select("record_id").distinct().count()
    assert pipeline.ingest(pay, pay.select(F.sha2(F.to_json(F.struct("pages")), 256).alias("file_hash"))).count() == 0
    assert pipeline.refresh(chunks, chunks.where("record_id = 4")).count() == chunks.count()
    table = chunks.select("chunk_id", F.col("record_id").cast("string").alias("document_id"), "section", "entity_focus", F.col("chunk_text").alias("text"))
    q = spark.createDataFrame([("q1", "which dose of warfarin", "doctor", None, 20, 3), ("q2", "which dose of warfarin", "nurse", None, 20, 3), ("q3", "zzzz", "doctor", None, 20, 3)], "query_id string, query_text string, role string, document_id string, candidate_k int, top_k int")
    got = {r["query_id"]: r for r in pipeline.ask(q, table).collect()}
    assert set(got) == {"q1", "q2"} and "warfarin" in got["q1"]["answer"].lower() and len(got["q1"]["sources"]) == 3 and all(":" not in s for s in got["q2"]["sources"])
    log = {r["audit_id"]: r["status"] for r in pipeline.logged(q, pipeline.ask(q, table)).collect()}
    assert log == {"q1": "ok", "q2": "ok", "q3": "no_answer"}


QUERY = "query_id string, query_text string, role string, document_id string, candidate_k int, top_k int"
CHUNK = "chunk_id string, document_id string, section string, entity_focus string, text string"


def _vectors(spark, n):
    """Chunks b:0 to b:2 are further from the question than the chunks a:..."""
    chunks = [(f"a:{i:04d}", "a", "x", None, "fever fever fever") for i in range(n)] + [(f"b:{i:04d}", "b", "x", None, "fever and many other words besides") for i in range(3)]
    vectors = [(c[0], [1.0, 0.001 * i] if c[1] == "a" else [0.1, 1.0]) for i, c in enumerate(chunks)]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(vectors, "id string, vec array<double>")


def test_scope_before_the_cut(spark):
    chunks, vectors = _vectors(spark, 40)
    q = spark.createDataFrame([("b", "fever", "doctor", "b", 20, 5), ("all", "fever", "doctor", None, 20, 5), ("far", "zzzz", "doctor", "b", 20, 5)], QUERY)
    asks = spark.createDataFrame([(x, [1.0, 0.0]) for x in ("b", "all", "far")], "query_id string, vec array<double>")

    def ids(final, x):
        return {r["chunk_id"] for r in final.collect() if r["query_id"] == x}

    words = pipeline.retrieve(q, chunks).cache()
    assert ids(words, "b") == {"b:0000", "b:0001", "b:0002"} and len(ids(words, "all")) == 5
    near = pipeline.retrieve(q, chunks, vectors=vectors, query_vectors=asks).cache()
    assert ids(near, "b") == ids(near, "far") == {"b:0000", "b:0001", "b:0002"} and all(x[0] == "a" for x in ids(near, "all"))


def test_each_side_keeps_the_candidate_window(spark):
    chunks, vectors = _vectors(spark, 40)
    q = spark.createDataFrame([("less", "fever", "doctor", None, 10, 50), ("default", "fever", "doctor", None, None, 50), ("asks", "which dose for fever", "doctor", None, 20, 50), ("more", "fever", "doctor", None, 33, 50)], QUERY)
    window = {"less": 10, "default": 20, "asks": 30, "more": 33}
    words = {r["query_id"]: r["count"] for r in pipeline.retrieve(q, chunks).groupBy("query_id").count().collect()}
    assert words == window
    asks = spark.createDataFrame([(x, [-1.0, 1.0]) for x in window], "query_id string, vec array<double>")  # the words find other chunks first
    both = pipeline.retrieve(q, chunks, vectors=vectors, query_vectors=asks)
    near = {r["query_id"]: r["count"] for r in both.where("semantic_score IS NOT NULL").groupBy("query_id").count().collect()}
    assert near == window


def test_chunks_of_one_number_stay_apart(spark):
    rows = [("q", "a:0003", "a", "first", 1), ("q", "b:0003", "b", "second", 2), ("q", "c:0004", "c", "third", 3)]
    for role, refs in (("nurse", ["0003", "0003", "0004"]), ("doctor", ["a:0003", "b:0003", "c:0004"])):
        final = spark.createDataFrame([(*r, "what", role) for r in rows], "query_id string, chunk_id string, document_id string, text string, place int, query_text string, role string")
        p = pipeline.prompts(final).head()
        assert p["sources"] == refs and [p["prompt"].count(f"]\n{t}") for t in ("first", "second", "third")] == [1, 1, 1] and p["first"] == "first"
        assert p["prompt"].index("first") < p["prompt"].index("second") < p["prompt"].index("third")


def test_semantic_groups(spark):
    df = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.9, 0.43]), ("d", 2, [0.0, 1.0]), ("d", 3, None)], "doc_id string, n int, vec array<double>")
    assert [r["group_no"] for r in pipeline.semantic_groups(df).orderBy("n").collect()] == [0, 0, 1, 2]


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "chunks")
    assert cli.main(["ingest", f"{DATA}/document_payloads.parquet", out]) == 0
    assert cli.main(["search", out, "warfarin dose", "--top", "2"]) == 0
    assert "warfarin" in capsys.readouterr().out.lower()
