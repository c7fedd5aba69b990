import pytest

ODD = [None, "", " \t\n", "one", "two words", "A b c d e", "é ü 漢字 😀 x y z", "same same same same same same same same same same same same same same same same same same same same same", "long " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty values in every column, ties, repeated rows, very long texts, columns whose names clash with results."""
    prose = " ".join(f"w{i * 7 % 31}x{i}" for i in range(60))
    texts = [*ODD, prose, prose, prose + " tail", "\n".join(prose.split()[:9]), "\n".join(prose.split()[:9]) + "\nnew line"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i, 5, 6, "c") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, prose, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, n_removed long, component_id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
