import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """A clean text of n words that depends on a seed."""
    import random

    def make(seed: int, n: int = 60) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS)[:3] for _ in range(n)).capitalize() + "."

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given (doc_id, text) rows, and columns whose names clash with what operators add."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, uid string, words string, score string, kind string"
        return spark.createDataFrame([(i, t, "en", f"src{k % 5}", len(t or ""), "u", "w", "s", "k") for k, (i, t) in enumerate(rows)], schema)

    return make
