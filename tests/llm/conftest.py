import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, size int, u int, anchor string"


def odd_rows():
    """Nulls in every column, empty and long texts, copies, near copies, ties, repeated rows; further columns clash with inner names."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ñ", "Zu"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(400), text(70)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "", "en", "b"), (4, " \n\t ", "en", None), (5, "One", "en", "a"), (6, "one", "en", "a"), (7, "ÉA", "fr", "b"), (8, "éa", "fr", "b")]
    rows += [(9, base, "en", "a"), (10, base.upper().lower(), "en", "b"), (11, base + " tail", "en", "a"), (12, "lead " + base, "en", "c"), (12, "lead " + base, "en", "c")]
    rows += [(13, text(30) + "\n" + passage + "\n" + text(60), "en", "c"), (14, passage, "en", "c"), (15, text(8) + "  " + passage.replace(" ", "\n", 3), "en", "a")]
    rows += [(16, text(20000), "en", "d"), (None, base, "en", "a"), (None, "only here", None, "a"), (17, "la " * 500, "es", "a"), (18, "la " * 130, "es", "b"), (19, "ab cd " * 90, "es", "b")]
    rows += [(20 + i, text(r.randint(1, 300)), "en", r.choice("abcd")) for i in range(60)]
    rows += [(100 + i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(base.split())), "en", "a") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*x, len(x[1] or ""), "d", "f", 1, 2, "x") for x in odd_rows()], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
