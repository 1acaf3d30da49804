import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns named as operators name theirs."""
    long_text = "\n".join(prose(i, 400) for i in range(60))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (None, "no id here", "en", "a", 10),
        (4, long_text, "en", "a", len(long_text)), (5, long_text, "en", "a", len(long_text)), (6, "ÀÉ one\ntwo\none", "fr", "b", 13),
        (7, "same text, same row", "en", "b", 19), (7, "same text, same row", "en", "b", 19), (None, None, None, None, None),
        (8, prose(99, 80), "en", "b", 1), (9, "𝒳 emoji 😀 and <|endoftext|> inside", "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = (
        "score predicted n_words n_hit items spans contaminated n_lines n_dropped kept base_failed anomaly size text_crc32 shard slot position"
        " row_number ids n_tokens raw fp root class_id key tokens h at page line host"
    )
    return docs.selectExpr("*", *[f"'mine' AS `{c}`" for c in clashing.split()])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (4, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
