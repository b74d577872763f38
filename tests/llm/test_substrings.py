from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import corpus, frame, plain

from roundcast.llm.substring_dedup import SuffixAutomaton, dedup_substrings
from roundcast.llm.suffix_dedup import dedup_bytes, equal_suffixes


def words_brute(rows, size):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (float("inf") if d is None else d):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=repr)


def bytes_brute(rows, size):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + size] for _, r in raw for i in range(len(r) - size + 1))
    out = []
    for d, r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "gram", "crowd"), [(50, 25, 1000), (12, 5, 1000), (12, 5, 2)])
def test_words_as_brute_force(docs, size, gram, crowd):
    rows, df = docs
    got = plain(dedup_substrings(df, length=size, gram=gram, crowd=crowd), "doc_id", "n_words", "n_removed", "text")
    assert got == words_brute(rows, size)


@pytest.mark.parametrize(("size", "gram", "crowd"), [(200, 64, 5000), (36, 20, 5000), (36, 20, 2)])
def test_bytes_as_brute_force(docs, size, gram, crowd):
    rows, df = docs
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
        for r in dedup_bytes(df, length=size, gram=gram, crowd=crowd).collect()
    ]
    assert sorted(got, key=repr) == bytes_brute(rows, size)


def test_empty_tables(no_docs):
    assert dedup_substrings(no_docs).collect() == []
    assert dedup_bytes(no_docs).collect() == []


def test_other_seeds(spark):
    rows = corpus(7, 30)
    df = frame(spark, rows)
    assert plain(dedup_substrings(df, length=20, gram=8), "doc_id", "n_words", "n_removed", "text") == words_brute(rows, 20)


def test_automaton_knows_the_first_document():
    rng = random.Random(5)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(30)] for _ in range(6)]
    automaton = SuffixAutomaton()
    for doc, words in enumerate(texts):
        found, _ = automaton.windows(words, 5)
        want = {}
        for i in range(26):
            holders = [d for d in range(doc) if any(texts[d][j : j + 5] == words[i : i + 5] for j in range(26))]
            if holders:
                want[i] = holders[0]
        assert found == want
        automaton.add(words, doc)


def test_multikey_quicksort():
    data = np.frombuffer(b"abcdefghijKLabcdefghijMNabcdefghiXX", np.uint8)
    group = np.zeros(24, np.int64)
    assert sorted(equal_suffixes(data, np.arange(24), group, 10).tolist()) == [0, 12]
    assert sorted(equal_suffixes(data, np.arange(25), np.zeros(25, np.int64), 9).tolist()) == [0, 1, 12, 13, 24]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_made_to_collide_are_told_apart(spark):
    """Sums of letters times powers modulo 2^64 agree on these two words, whatever the base."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    before, after = " ".join(f"l{i}" for i in range(30)), " ".join(f"r{i}" for i in range(30))
    rows = [(k, f"{before} {w} {after}") for k, w in enumerate((one, two, two))]
    got = {r.doc_id: r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 61}
