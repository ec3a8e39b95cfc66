import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and long texts, copies, repeated rows, odd characters, and columns whose names clash."""
    texts = [
        (1, "one text"), (2, "one text"), (3, ""), (4, None), (5, "One text"), (6, prose(1, 20_000)), (7, prose(1, 20_000)),
        (8, "née İ Σ 中文 😀 \x85 ​ ﬁ"), (9, "  two  spaces \n\n and\tmore  "), (10, prose(2, 300)), (11, prose(2, 299) + " x"),
        (12, "<|endoftext|> </s> [INST] <0x0A>"), (13, "a"), (14, " "), (15, "one text "),
        (None, "one text"), (None, None), (5, "One text"), (5, "One text"), (5, "another text under the same id"),
    ]
    rows = [(i, t, "en", f"src{k % 2}", len(t or ""), True, 7, "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, window string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def plain(odd_docs):
    """The rows as (doc_id, text)."""
    return [(r.doc_id, r.text) for r in odd_docs.collect()]
