import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def word_vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


ODD = ["", None, "a  b\t\tc d e", "<|endoftext|> hi<|startoftext|>x", "Straße ÉCOLE İstanbul ΣΑΣ éa", "don't 's it'll 123 4.5!!", "\n\n", "naïve—“quoted” 日本語 ﬁ", "x" * 3000, " lead trail ", "the the the " * 400]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, a null id, and columns whose names operators might use."""
    rows = [(i, t, "n", i, 1.0, "h") for i, t in enumerate(ODD)] + [(3, ODD[3], "n", 3, 1.0, "h")] * 2 + [(None, "a null id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n_chars long, sort_key double, h string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
