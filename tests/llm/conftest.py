import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table; extra columns clash with names that operators use."""

    def make(rows):
        rows = [(r + (None,) * 4)[:4] for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", "cast(length(text) as long) n_chars", "'x' score", "'y' fp", "1 bucket", "2 sig", "'z' words", "3 size", "4 label", "5 _t")

    return make


@pytest.fixture
def collected():
    def get(df, key="doc_id"):
        return {r[key]: r.asDict(recursive=True) for r in df.collect()}

    return get


@pytest.fixture
def prose():
    import random

    def make(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed", str(rnd.randrange(50))]) for _ in range(n))

    return make
