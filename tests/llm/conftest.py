import random

import pytest

WORDS = [a + b for a in "ka lo mi ne pu ra so ti vu we".split() for b in "bar den fil gos hut jam".split()]


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    return lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def documents(spark):
    """Documents with an extra column whose name clashes with an output's."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
    return lambda rows: spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y") for i, t, lang, src in rows], shape)
