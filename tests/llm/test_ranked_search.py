"""Ranked search against a plain loop over all items and documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import corpus, frame, prose

from roundcast.llm.ranked_search import Best, contributions, length_factors, ranked_search, sharing_dag, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute_force(docs, items, top):
    own = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, c) for d, c in own if c]
    total = sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    queries: dict[object, Counter] = {}
    for i, t in {(i, t) for i, t in items if i is not None}:
        queries.setdefault(i, Counter()).update(terms(t))
    for i, q in queries.items():
        scored = []
        for d, c in full:
            m = 25 + 75 * sum(c.values()) * len(full) // total
            s = 0
            for t, times in q.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * len(full) + 2) / (2 * df[t] + 1)))
                    s += times * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=lambda r: (r[0], r[1]))


def item_rows(seed=3):
    rng = random.Random(seed)
    shared = prose(rng, 12)
    out = [(i, shared + prose(rng, rng.randint(1, 30)) + " The the THE " * (i % 4)) for i in range(25)]
    return out + [(30, None), (31, ""), (32, "?!"), (None, shared), out[3], (4, "other words of item four"), (33, "漢字 Été ÉTÉ")]


@pytest.mark.parametrize(("top", "block_terms"), [(10, 200_000), (3, 60), (4, 1)])
def test_as_brute_force(spark, top, block_terms):
    rows = corpus(6, 80)
    items = item_rows()
    table = spark.createDataFrame(items, "item_id int, text string")
    got = ranked_search(frame(spark, rows), table, top=top, block_terms=block_terms).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got]) == [
        (i, k, d, s) for i, k, d, s in brute_force(rows, items, top)
    ]


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame(item_rows(), "item_id int, text string")
    assert ranked_search(no_docs, items).collect() == []
    assert ranked_search(frame(spark, corpus(2, 10)), items.where("false")).collect() == []
    assert ranked_search(frame(spark, [(1, None), (2, " ")]), items).collect() == []


def test_sharing_gives_the_same_sums_with_fewer_additions():
    rng = random.Random(5)
    common = [f"c{k}".encode() for k in range(30)]
    items = [(i, {t: rng.randint(1, 3) for t in (*rng.sample(common, 22), *(f"{i}-{k}".encode() for k in range(3)))}) for i in range(60)]
    dag = sharing_dag(items)
    parts = np.random.default_rng(1).integers(0, 1000, (len(dag.terms), 7))
    number = {t: k for k, t in enumerate(dag.terms)}
    want = np.stack([sum(n * parts[number[t]] for t, n in own.items()) for _, own in items])
    assert (dag.scores(parts) == want).all()
    assert len(dag.left) > 0 and len(dag.item_node) < sum(len(own) for _, own in items)
    # nodes of a level need only nodes before it
    sets = len(dag.set_start) - 1
    assert all(max(dag.left[a - sets : b - sets].max(), dag.right[a - sets : b - sets].max()) < a for a, b in dag.levels)


def test_terms():
    for text in ("Ab-c_9 É1É x\u0085y z", "", "a\x00b", "[A]^`{z}"):
        assert [t.decode() for t in terms_of(text)] == terms(text)


def test_best_keeps_ties_by_id():
    best = Best(1, 2)
    best.add(np.array([[5, 5, 5, 0, 7]]), np.array([9, 3, 4, 1, 8]), np.zeros(5, bool))
    best.add(np.array([[5, 7]]), np.array([2, 0]), np.array([False, True]))
    best.settle()
    assert best.doc.tolist() == [8, 0] and best.score.tolist() == [7, 7] and best.none.tolist() == [False, True]


def test_large_numbers():
    n = np.array([10**9, 5])
    assert length_factors(n, 10**11, 10**14).tolist() == [25 + 75 * 10**9 * 10**11 // 10**14, 25]
    assert contributions(np.array([7]), np.array([9 * 10**9]), np.array([100])).tolist() == [7 * (9 * 10**18 // (9 * 10**12 + 800))]
