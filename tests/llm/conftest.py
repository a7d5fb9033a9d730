import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, d string, fp string, words string"


def make_text(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def base_rows(rng):
    """Ordinary documents, copies, near copies, shared passages and lines, and every kind of odd row."""
    rows = []
    passage = make_text(rng, 70)
    line = "licensed under these same terms as ever"
    for i in range(60):
        text = make_text(rng, rng.randint(60, 160))
        if i % 10 == 3:
            text = text + "\n" + line + "\n" + make_text(rng, 30)
        if i % 12 == 5:
            text = make_text(rng, 40) + " " + passage + " " + make_text(rng, 40)
        rows.append((i, text))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, rows[2][1] + " " + "end"), (103, "  " + line.upper() + "\t")]
    rows += [(200, None), (201, ""), (202, " \n\t \n"), (203, "one"), (204, "two words"), (None, rows[4][1]), (205, "x" * 50_000), (206, make_text(rng, 12_000)), (207, "ha " * 3000), (208, "é ñ ü 日本語 🙂   A\x00B")]
    rows += [(1, rows[1][1]), (201, "")]  # repeated rows
    return rows


def frame(spark, rows):
    full = [(i, t, ("en", "de", None)[k % 3], f"src{k % 2}" if k % 7 else None, None if t is None else len(t), "clash", "clash", "clash", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def docs(spark, base_rows):
    return frame(spark, base_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
