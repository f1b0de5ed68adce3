import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, start=0):
    return [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts, start)]


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes tables as a scale folder and returns its path."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).repartition(3).write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Small texts with exact and near copies, shared passages, repeats, blanks, ties and odd characters."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("etaonßéç.,日") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [text(n) for n in (50, 51, 60, 120, 49)]
    out = [None, "", " \n\t ", "one", "one two", text(50), text(50)]
    for i in range(60):
        parts = [text(rnd.randint(0, 70))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(shared), text(rnd.randint(0, 40))]
        out.append(rnd.choice([" ", "\n", " \t", "\x0b"]).join(parts))
    base = text(200)
    for i in range(25):
        w = base.split(" ")
        for _ in range(i % 6):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[20], out[20], "ab " * 400, "ab " * 300 + "x", "a" * 3000, "a" * 2000 + "b" * 60, text(4000)]
    rnd.shuffle(out)
    return out
