import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, h string, fp string, w string"
EXTRA = (None, 7, "x", None, "y")


def words(rng, n, stock=400):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwé") for _ in range(rng.randint(2, 7))) if rng.random() < 0.3 else f"w{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, copies, clashing extra columns."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 60)) for _ in range(30)]
    texts = [*base, *base[:5], None, "", "  \n\t ", "!!! ??? 123", "日本語 テキスト é́ 😀", "A" * 5000, words(rng, 30_000), "\x00\x01 a\x0bb\x0cc\x1cd e f", "İstanbul ΣΑΣ ǅ", " lead", "trail ", "x\n \n  y   z\r\n"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[0], None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA), (4, "another text of the same id", "en", "s", 27, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
