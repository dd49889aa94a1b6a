import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _did long, id string, h string, node long, key string, words string, row string, part string"


def doc(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), 7, "x", "y", 3, "k", "w", "r", "p")


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    base = words(1, 120)
    near = base.split()
    near[60] = "zzz"
    shared = "a line that many documents share"
    return [
        doc(1, base),
        doc(2, base),
        doc(3, " ".join(near)),
        doc(3, " ".join(near)),  # a repeated row
        doc(4, f"{shared}\n{words(4, 30)}\n{shared}"),
        doc(5, f"  {shared.upper()} \n{words(5, 30)}"),
        doc(6, ""),
        doc(7, None),
        doc(8, "\n\n"),
        doc(9, "... !!!", None),
        doc(None, words(6, 40)),
        doc(10, words(7, 30_000)),  # very long
        doc(11, "é" * 10 + "\n" + "É" * 10 + " ✓ 漢字", "fr"),
        doc(12, "one two"),
        doc(13, "one two"),
        doc(9, words(9, 20)),  # the same id, another text
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
