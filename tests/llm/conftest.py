import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, k1 int, `__id` int, `a``b c` string"


@pytest.fixture(scope="session")
def documents(spark):
    """Driver documents as a list of (doc_id, text), and odd ones: null, empty, blank, copies, long, a null id."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
    odd = [None, "", " \n\t ", "!!! ???", "one", "Ein Wort zwei drei vier", rows[3][1], rows[3][1], long, "été noël 日本語 \U0001f600"]
    return rows + [(10_000 + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of (doc_id, text) with further columns, some named as the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", 1, 2, 3, "y") for i, t in rows], SCHEMA)

    return make
