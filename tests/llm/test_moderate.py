"""Content scores: held-out accuracy, disguises, empty texts."""

import numpy as np
import pytest
from conftest import DATA

from quirelake.llm import moderate as M


@pytest.fixture(scope="module")
def data(spark):
    ex = [(r["text"], r["category"]) for r in spark.read.parquet(f"{DATA}/content_examples.parquet").orderBy("example_id").collect()]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) BETWEEN 1 AND 2000").collect()]
    return ex, docs


def test_held_out(data):
    ex, docs = data
    train, held = [x for i, x in enumerate(ex) if i % 3], [x for i, x in enumerate(ex) if i % 3 == 0]
    model = M.fit(train, docs)
    memo = {}
    for c, name in enumerate(M.CATEGORIES):
        y = np.array([k == name for _, k in held])
        p = np.array([model.scores(t, memo)[c] for t, _ in held]) > M.THRESHOLDS[name]
        assert (y & p).sum() >= 0.9 * y.sum() and (~y & p).sum() <= 0.05 * (~y).sum()


def test_disguises_and_benign(data):
    model = M.fit(*data)
    i = M.CATEGORIES.index("abusive")
    for t in ("You are a stupid 1d10t.", "You are a stupid i​d​i​o​t.", "You are a stupid i d i o t.", "You are a stupiiid idiooot", "You are a stupid i***t.", "Du bist ein dummes Arschloch."):
        assert model.scores(t, {})[i] > M.THRESHOLDS["abusive"], t
    for t in ("The rash is visible to the naked eye.", "I feel stupid for forgetting my tablets again, sorry.", "Lives with foreigners and other students in a shared house.", "Pest control removed vermin and rats from the flat.", "", "  ", None, "HbA1c 7.1 %"):
        assert all(s <= th for s, th in zip(model.scores(t, {}), M.THRESHOLDS.values())), t


def test_risk_is_non_negative():
    w, b = M.fit_category([], [[M.features(["bad", "word"])]] * 5, [M.features(["fine"])], [M.features(["fine", "day"])] * 20, prior=0.9)
    assert np.isfinite(w).all() and np.isfinite(b)
    assert M.fit_category([], [], [], [], 0.1)[1] < -20


def test_table(spark, data):
    model = M.fit(*data)
    rows = [(1, None, "x"), (2, "", "x"), (3, "You are a worthless idiot.", "x"), (4, "You are a worthless idiot.", "x"), (5, "fine " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, abusive string")
    got = {r["doc_id"]: r["abusive"] for r in M.score_documents(df, model).collect()}
    assert got[1] == got[2] == 0 and got[3] == got[4] > 0.5 > got[5]
    assert M.score_documents(df.limit(0), model).count() == 0
