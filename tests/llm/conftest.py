import pytest

from barloom.session import local_session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string, component_id string, piece string"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "12345 !!"), (5, "a"), (6, "Same text here\nand there."), (7, "Same  text here and there."),
    (7, "Same  text here and there."), (8, "<|endoftext|> x<|endoftext|>y"), (9, "wort " * 30_000), (10, "x" * 40_000), (None, "no identifier"),
    (None, None), (11, "Été 日本語 \U0001f600 naïve ó"), (12, "Same text here\nand there."), (13, "\x1c odd\x85blank\xa0s "),
    (14, "it's we'll I'd 12,34  ...  end"), (15, "A" * 5 + " " * 300 + "b"),
]


@pytest.fixture(scope="session")
def spark():
    s = local_session("barloom-tests", "4", 4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long, tied and repeated rows, and columns that clash with the operators' own."""
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 3 else "s", None if t is None else len(t), 1, "x", "y", "z") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
