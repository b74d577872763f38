from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

KINDS = "doc_id long, text string, anchor string, key int, n_words string"
SYLLABLES = "the an er on that ing re ou stra wen vol ki zu ma".split()


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))


def prose(rng, n):
    out = [word(rng) for _ in range(n)]
    return "".join(w + rng.choices([" ", "\n", "  ", ". "], [20, 2, 1, 2])[0] for w in out)


def edited(rng, text, share):
    return " ".join(word(rng) if rng.random() < share else w for w in text.split(" "))


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with exact and near copies, shared passages, repeats, nulls, repeated rows and odd characters."""
    rng = random.Random(seed)
    passage, short = prose(rng, 70), prose(rng, 20)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = i % 10
        base = next((t for _, t in reversed(rows) if t), "")
        text = prose(rng, rng.choice([3, 40, 90, 200]))
        if kind == 1:
            text = base
        elif kind == 2:
            text = edited(rng, base, 0.02)
        elif kind == 3:
            text = prose(rng, 30) + passage + prose(rng, 20)
        elif kind == 4:
            text = text + passage
        elif kind == 5:
            text = short + text + short
        elif kind == 6:
            text = "ÄÖ été 漢字 " * rng.choice([2, 80]) + text
        rows.append((i * 3 % 101, text))
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, rows[3][1]), (None, None), rows[4], rows[4], (503, "a" * 700)]
    rows += [(504, ("spam " * 120).strip()), (505, passage * 3), (506, "\n".join([passage.replace("\n", " ")] * 2))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([Row(doc_id=d, text=t, anchor="x", key=1, n_words="y") for d, t in rows], KINDS)


@pytest.fixture(scope="session")
def docs(spark):
    return corpus(), frame(spark, corpus())


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


def plain(df, *names):
    out = [tuple(r[c] for c in names) for r in df.collect()]
    return sorted(out, key=repr)
