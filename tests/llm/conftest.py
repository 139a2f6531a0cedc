import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def make_text(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact copies, near copies, shared passages, nulls, blanks and a long one."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        out.append(make_text(rng, rng.choice([1, 2, 3, 5, 12, 40, 90, 160])))
    for i in range(40):
        words = out[rng.randrange(100)].split()
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = make_text(rng, 1)
        out.append(" ".join(words))
    passage = make_text(rng, 30)
    out += [make_text(rng, 20) + "\n" + passage + " " + make_text(rng, 15) for _ in range(10)]
    out += [out[60]] * 5 + [out[61] + "\n", out[61].replace(" ", "\t"), "", "", None, None, "  \n\t ", "x", "X"]
    out.append(make_text(rng, 6000))
    return list(enumerate(out))


@pytest.fixture(scope="session")
def odd_docs(spark, corpus):
    """The corpus as a table with clashing extra columns, repeated rows and a null id."""
    rows = [(i, t, "src", "en", i, 1) for i, t in corpus]
    rows += [rows[3], rows[3], (None, rows[50][1], None, None, 0, 0), (None, None, None, None, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h long, n long").repartition(5)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
