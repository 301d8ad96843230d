import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with every awkward case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))
    base = " ".join(f"t{i}" for i in range(400))
    near = base.replace("t200 ", "x200 ")
    block = "\n".join(f"shared line {i} of a passage" for i in range(24))
    rows = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "One", "fr", None), (4, long, "en", "b"),
        (5, base, "en", "a"), (6, base, "en", "a"), (7, near, "en", "c"), (8, "Straße  naïve café  x <|endoftext|> end", "de", "d"),
        (9, "alone\n" + block + "\ntail nine", "en", "a"), (10, "other start\n" + block + "\ntail ten", "en", "a"), (11, "it's THE End\r\nof'll\x1cit  ", "en", "b"),
        (12, "same row", "en", "a"), (12, "same row", "en", "a"), (13, "idiot moron " * 30, "en", "c"), (None, "no id", "en", "a"),
    ]
    rows += [(20 + i, " ".join(f"w{(i * 37 + j * j) % 501}" for j in range(30 + i)), "en", "abc"[i % 3]) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "length(text) as n_chars", "'clash' as fp", "1 as n_tokens", "'k' as key", "0 as range", "0 as row")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture()
def folder(tmp_path):
    return lambda name: str(tmp_path / name)
