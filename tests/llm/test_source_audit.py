"""The divergence audit against plain counting, with and without digests that collide."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest_llm import prose

from roundcast.llm import source_audit as module
from roundcast.llm.source_audit import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = "doc_id long, lang string, source string, text string, digest int, term string, n string"


def brute_force(rows, min_documents, top):
    cells: dict[tuple[str, str], Counter] = {}
    df: dict[str, Counter] = {}
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = TERM.findall(text.translate(LOW))
        cells.setdefault((lang, source), Counter()).update(words)
        df.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_documents]
        own = {s: c for (x, s), c in cells.items() if x == lang}
        every = sum(own.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(every)
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def rows(seed, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["a", "a", "a", "b", "É", "", None, "z"])
        text = rng.choice([prose(rng, rng.randint(1, 40)), prose(rng, 5) + " Ärger ÄRGER 漢字 x1y", "", None, "12 34"])
        out.append((lang, source, text))
    return out + [("fr", "a", None), ("fr", "b", ""), ("fr", "c", "7"), ("it", "only", "uno due"), out[0], out[0]]


def table(spark, data):
    return spark.createDataFrame([(k, *r, 1, "x", "y") for k, r in enumerate(data)], KINDS)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("bits", "share_cells", "held"), [(64, 200_000, 500_000), (5, 7, 40)])
def test_as_brute_force(spark, monkeypatch, bits, share_cells, held):
    monkeypatch.setattr(module, "HELD_TERMS", held)
    data = rows(1)
    got = collected(source_audit(table(spark, data), min_documents=4, top=6, bits=bits, share_cells=share_cells))
    assert got == brute_force(data, 4, 6)
    # ties at the last place are settled by the strings
    assert any(r[2] == "term" and r[5] == 6 for r in got)


def test_no_kept_terms_and_no_rows(spark):
    data = rows(2, 20)
    assert collected(source_audit(table(spark, data), min_documents=1000)) == brute_force(data, 1000, 50)
    assert source_audit(table(spark, []).limit(0)).collect() == []


def test_shares_beyond_64_bits(spark):
    big = spark.createDataFrame([(9 * 10**15, 10**16, 7)], "n long, total long, kept long")
    assert big.select(module._share("n", "total")).first()[0] == 1 + 10**9 * (9 * 10**15 + 5) // (10**16 + 35)
