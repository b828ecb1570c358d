import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names operators use inside.
CLASHING = DOCS + ", norm string, fp long, size long, kept boolean, row string, `key` string, n_words long, start long, ids string, rank long, bucket long"
PROSE = " ".join(f"word{i % 37}x{i % 11} and{i}" for i in range(60))


def edge_rows():
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a very long text and one without spaces."""
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    texts = [None, "", "  \n\t ", "one", "Two words", PROSE, PROSE.replace(" ", "\n\n"), PROSE + " tail", long, "x" * 100_000, "ünï çödé 🙂 " * 30, "<|endoftext|> mid <|endoftext|>", "a@b.co +1 (555) 123-4567 10.0.0.1"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s1", None, "s2")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # the same row again
    rows += [(None, PROSE, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(*r, "n", 1, 2, True, "r", "k", 3, 4, "i", 5, 6) for r in edge_rows()], CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    """A few hundred texts of the smallest test table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
