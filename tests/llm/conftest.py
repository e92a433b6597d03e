import pytest

from llm_data import SCHEMA


@pytest.fixture(scope="session")
def odd_texts():
    """Null and empty texts, copies, ties, a very long text, blanks and letters of all kinds."""
    prose = "the cat sat on the mat and looked at the moon while it rained outside all day long"
    return [
        (1, None),
        (2, ""),
        (3, prose),
        (4, prose),
        (5, prose.upper()),
        (6, "  \t\n \x0b "),
        (7, "one two"),
        (8, "one two"),
        (9, "\n".join(["A shared line.", prose + " indeed", "", "a SHARED line.  "])),
        (10, "x" * 5_000),
        (11, " ".join(f"word{i % 700}" for i in range(30_000))),
        (12, "İstanbul Straße ΑΣ 日本   é \x1c <|endoftext|>  end "),
        (13, "12345 67890 !!!"),
        (13, "12345 67890 !!!"),
        (None, "no id but a text of some words here"),
        (15, "A shared line.\n" + "spam " * 40),
    ]


@pytest.fixture
def docs(spark):
    def make(rows, extra=True):
        frame = spark.createDataFrame(
            [(i, t, "en", "web", len(t) if t else 0) for i, t in rows], SCHEMA
        ).repartition(3)
        if extra:  # names that operators might use themselves
            for name in ("c", "n", "code", "key", "id", "row", "score", "part", "size", "_lines"):
                frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make
