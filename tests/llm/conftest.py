from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 3, n: int = 120) -> list[tuple]:
    """Texts in two manners, exact and near copies, boilerplate lines, personal data, nulls, blanks and a long one."""
    rng = random.Random(seed)
    words = {0: [f"{a}{b}" for a in ("tor", "mel", "van", "sid", "pra", "kon") for b in ("ia", "eth", "ula", "or", "is", "")], 1: [f"{a}{b}" for a in ("zug", "krä", "pfö", "sch", "bau", "ge") for b in ("heit", "ung", "er", "en", "lich", "st")]}
    boiler = ["All rights reserved by the several makers.", "Licensed under the terms of nobody."]
    rows, texts = [], []
    for i in range(n):
        pick = rng.random()
        if texts and pick < 0.12:
            text = rng.choice(texts)
        elif texts and pick < 0.22:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            vocabulary = words[i % 2]
            lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(2, 25))]
            if rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines)), rng.choice(boiler))
            if rng.random() < 0.3:
                lines.append(rng.choice(["mail bob.b@mail.example.com now", "call +1 (403) 555-9312 soon", "host 10.20.30.40 or 999.1.1.1", "card 4514194443376464 5555-5555-5555-4444"]))
            text = "\n".join(lines)
        texts.append(text)
        rows.append((i, text, "xx", f"s{rng.randrange(12)}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "xx", "s1", 0), (n + 2, " \n\t ", "xx", "s1", 4), (None, texts[0], "xx", "s2", 1), (n + 3, "ab " * 20_000, "xx", "s0", 60_000), (5, texts[5], "xx", "s3", 1)]
    return rows


@pytest.fixture(scope="session")
def document_rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, document_rows):
    return spark.createDataFrame(document_rows, DOC).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)
