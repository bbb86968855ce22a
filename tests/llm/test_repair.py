"""Broken and misread words, furniture, reflow."""

import pytest

from quirelake.llm import repair as R

CLEAN = "The patient reports shortness of breath and a persistent headache. Non-smoker, occasional alcohol, lives in a ground-floor flat. Continue warfarin for two weeks. The treatment was planned yesterday morning by the clinic."


@pytest.fixture(scope="module")
def repairer():
    texts = [CLEAN] * 60
    counts = {}
    for t in texts:
        for w in R.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    return R.Repairer(counts, R.skip_gram(texts, counts))


def found(r, text):
    return r.found(text, r.links_of([text]))


def repaired(r, text):
    return r.repaired(text, r.links_of([text]))


@pytest.mark.parametrize(
    "text, noise",
    [
        ("The patlent reports short-\nness of breath", [(0, "misread"), (0, "broken_word")]), ("lives in a ground-\nfloor flat.", []), ("Non-\nsmoker, occasional", []), ("the treatrnent was plannecl", [(0, "misread")]), ("yester­\nday morning", [(0, "broken_word")]),
        ("Page 2 of 3\nThe patient reports", [(0, "page_no")]), ("The patient reports\n60\nbreath and", []), ("The patient reports breath\n- 4 -", [(1, "page_no")]), ("The patient reports breath\niii", [(1, "page_no")]), ("Weight:\n53", []),
        ("** CLINIC RECORD (continued) **\nThe patient reports", [(0, "running_head")]), ("T A R N B E C K\nThe patient", [(0, "running_head")]), ("Diagnosis:\nThe patient", []), ("The patient was seen.\ncontinued overleaf", [(1, "running_head")]), ("", []), (" ", []), ("\n\n", []),
        ("Home Hospital - Clinic Record\n3\nThe pat1ent reports", [(0, "running_head"), (1, "page_no"), (2, "misread")]),
    ],
)
def test_found(repairer, text, noise):
    assert sorted(found(repairer, text)) == sorted(noise)


def test_repaired(repairer):
    text = "Page 1\nThe patlent reports short-\nness of breath and a persistent head-\nache. Non-\nsmoker, occasional alcohol, lives in a ground-\nfloor flat.\n** NURSING REPORT (continued) **"
    assert repaired(repairer, text) == "The patient reports shortness of breath and a persistent headache. Non-smoker, occasional alcohol, lives in a ground-floor flat."
    assert repaired(repairer, "a | b\nc | d") == "a | b\nc | d" and repaired(repairer, "") == ""
    assert repaired(repairer, "- one\n- two") == "- one\n- two"


def test_clean_text_is_clean(repairer):
    assert found(repairer, CLEAN) == [] and repaired(repairer, CLEAN) == CLEAN
    assert found(repairer, "x" * 200_000) == []


def test_table(spark):
    rows = [("f", "a", CLEAN, "x")] * 40 + [("f", f"i{k}", CLEAN, "x") for k in range(40)] + [("f", "b", "The patlent reports\n2", "x"), ("f", "c", None, "x"), ("f", "d", "", "x")]
    df = spark.createDataFrame(rows, "field string, item_id string, text string, noise string")
    r = R.fit(df)
    got = sorted((x["item_id"], x["line_no"], x["noise"]) for x in R.noisy_lines(df, r).collect())
    assert got == [("b", 0, "misread"), ("b", 1, "page_no")]
    assert R.repair(df, r).count() == 43 and R.noisy_lines(df.limit(0), R.fit(df.limit(0))).count() == 0


def test_repeats_and_differing_texts(spark):
    """Equal rows count once; differing texts under one id are each repaired."""
    rows = [("f", "a", CLEAN)] * 50 + [("f", "a", "The patlent reports breath\n- 2 -")] * 3
    df = spark.createDataFrame(rows, "field string, item_id string, text string")
    r = R.fit(df)
    assert sorted(tuple(x) for x in R.noisy_lines(df, r).collect()) == [("f", "a", 0, "misread"), ("f", "a", 1, "page_no")]
    assert sorted(x["text"] for x in R.repair(df, r).collect()) == sorted([CLEAN, "The patient reports breath"])


def test_vectors_of_all_texts(spark):
    """Long texts and many texts count; the table's vectors are those of the list of texts."""
    long = "zebra quagga " * 2_000
    rows = [("f", "long", long)] + [("f", f"i{k}", CLEAN) for k in range(40)] + [("f", f"s{k}", "solitary") for k in range(10)]
    df = spark.createDataFrame(rows, "field string, item_id string, text string")
    r = R.fit(df)
    known = {w for w, i in r.vectors.index.items() if r.vectors.vec[i].any()}
    assert {"zebra", "quagga", "patient"} <= known and "solitary" not in known
    own = R.skip_gram([x[2] for x in rows], r.counts)
    assert abs(own.vec @ own.ctx.T - r.vectors.vec @ r.vectors.ctx.T).max() < 1e-3


@pytest.fixture(scope="module")
def scans():
    """Every block text of a small table, as it is."""
    import duckdb

    return [r[0] for r in duckdb.sql("SELECT b.text FROM (SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM '/root/testdata/sf0.01/document_payloads.parquet')) WHERE b.text IS NOT NULL").fetchall()]


def _counts(texts):
    counts = {}
    for t in texts:
        for w in R.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if n >= R.MIN_COUNT}


def test_the_vectors_decide(scans):
    """Without vectors nothing is linked; vectors without sense lose most; a text's links need the corpus."""
    counts = _counts(scans)
    v = R.skip_gram(scans, counts)

    def misread(vectors):
        r = R.Repairer(counts, vectors)
        k = r.links_of(scans)
        return sum(x == "misread" for t in scans for _, x in r.found(t, k))

    trained = misread(v)
    none = misread(R.Vectors(v.index, v.vec * 0, v.ctx * 0, v.total, v.grams * 0))
    g = R.np.random.default_rng(3)
    noise = [g.normal(size=m.shape).astype("f4") for m in (v.vec, v.ctx, v.grams)]
    senseless = misread(R.Vectors(v.index, noise[0], noise[1], v.total, noise[2]))
    assert trained > 50 and none == 0 and senseless < 0.6 * trained


def test_in_context():
    """Misread words are put right by the words around."""
    texts = ["The treatment was planned early"] * 90 + ["Eat more cereal and brown bread daily"] * 400 + ["Seen after dinner with nobody"] * 300 + ["Eat more ccreal and brown bread daily"] * 5
    r = R.Repairer(counts := _counts(texts), R.skip_gram(texts, counts))
    k = r.links_of(texts)
    assert r.found("Eat more ccreal and brown bread daily", k) == [(0, "misread")] and found(r, "The treatrnent was planned early") == [(0, "misread")]
    both = dict(k, ccreal=[("nobody", [0]), ("cereal", [1])])  # of several links the one that fits the words around
    assert r.correct("ccreal", ["eat", "more", "and", "brown"], both) == ("cereal", [1]) and r.correct("ccreal", ["after", "dinner"], both)[0] == "nobody"


def test_glyph_search_has_no_cap():
    """Every path of up to three edits is looked at, in words of any length."""
    r = R.Glyphs({"iiiilllliiiillll" * 3: 900, "patient": 900, "modern": 900, "rnodern": 1})
    assert r.candidates(("iiiilllliiiillll" * 3).replace("l", "1", 3))[0][2] == 3
    assert r.candidates("rnodcrn") == [("modern", [0, 4], 2)] and r.candidates("pat1ent") == [("patient", [3], 1)] and r.candidates("patient") == []
    assert r.candidates("12345") == [] and r.candidates("pa") == []
