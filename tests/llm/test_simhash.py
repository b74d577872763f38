from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import corpus, frame, plain, prose

from roundcast.llm.simhash import (
    TREE_NODES, BKForest, ShingleSets, alike_links, block_keys, components, grouped, links, near_duplicates, without_near_duplicates,
)


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius):
    """Least member of each print's component."""
    left, out = sorted(set(prints)), {}
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            at = todo.pop()
            group.append(at)
            near = [x for x in left if (x ^ at).bit_count() <= radius]
            left = [x for x in left if x not in near]
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_as_brute_force(docs):
    rows, df = docs
    prints = [fingerprint(t, 4) for _, t in rows]
    root = roots(prints, 4)
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = sorted(((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)), key=repr)
    assert plain(near_duplicates(df, shingle=4), "doc_id", "fingerprint", "component_id") == want


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).collect() == []
    assert without_near_duplicates(no_docs).collect() == []


def crowd(rng, n):
    """Prints around few centres, some apart."""
    centres = [rng.getrandbits(64) for _ in range(8)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_forest_connects_what_is_connected(seed):
    rng = random.Random(seed)
    shards = [crowd(rng, n) for n in (1, 2, 400, 3, 150)]
    prints = np.array([p for s in shards for p in s], np.uint64).reshape(-1, 1)
    of = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    a, b = BKForest(prints, of).links(4)
    assert (of[a] == of[b]).all()
    assert (np.bitwise_count(prints[a, 0] ^ prints[b, 0]) <= 4).all()
    assert len(a) <= len(prints) - len(shards)
    at = 0
    for shard in shards:
        label = {i: i for i in range(at, at + len(shard))}

        def top(i, label=label):
            while label[i] != i:
                i = label[i]
            return i

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if at <= x < at + len(shard):
                label[max(top(x), top(y))] = min(top(x), top(y))
        root = roots(shard, 4)
        assert len({top(i) for i in label}) == len(set(root.values()))
        at += len(shard)


def test_close_prints_share_a_block_key():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        keys = block_keys(np.array([x, y], np.uint64), 4)
        assert set(keys[0]) & set(keys[1])


def test_crowded_shards_are_dealt(spark):
    prints = crowd(random.Random(3), 300)
    rows = [(bytearray(p.to_bytes(8, "big")), block_keys(np.array([p], np.uint64), 4)[0].tolist()) for p in prints]
    df = spark.createDataFrame(rows, "print binary, keys array<long>")
    got = {bytes(r.node): bytes(r.least) for r in components(links(df, 4, tree_nodes=20)).collect()}
    root = roots(prints, 4)
    want = {p.to_bytes(8, "big"): r.to_bytes(8, "big") for p, r in root.items() if p != r}
    assert got == want


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {(r.node, r.least) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_keeps_one_of_similar_texts(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(40):
        text = prose(rng, 300)
        words = text.split()
        for j in rng.sample(range(300), 3):
            words[j] = "changed"
        rows += [(i, text), (100 + i, " ".join(words))]
        pairs.append(jaccard(text, " ".join(words)))
    assert min(pairs) >= 0.85
    rows += [(200, prose(rng, 300)), (201, None), (202, ""), (3, rows[6][1])]
    kept = without_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "anchor", "key", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 200, 201]


def test_repeated_rows_leave_one(spark):
    rows = corpus(2, 20)
    kept = without_near_duplicates(frame(spark, rows + rows)).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)


def test_stage_goes_by_exact_similarity(spark):
    rng = random.Random(5)
    rows, stay, go = [], [], []
    at = 0
    while len(stay) < 40 or len(go) < 40:
        text = prose(rng, 300)
        words = text.split()
        for j in rng.sample(range(300), rng.randint(5, 12)):
            words[j] = "changed"
        like = jaccard(text, " ".join(words))
        kind = stay if 0.70 <= like < 0.80 else go if 0.80 <= like < 0.85 else None
        if kind is None or len(kind) == 40:
            continue
        rows += [(at, text), (at + 1, " ".join(words))]
        kind.append(at)
        at += 2
    kept = sorted(r.doc_id for r in without_near_duplicates(frame(spark, rows)).collect())
    assert kept == sorted([x for i in stay for x in (i, i + 1)] + go)


def test_recall_against_all_pairs(spark):
    """Pairs at 0.80 to 0.86, the hardest there are, of short and long texts; every pair of all texts is compared."""
    rng = random.Random(21)
    rows, at = [], 0
    for goal in (14, 25, 60, 150, 400):
        made = 0
        while made < 60:
            words = prose(rng, goal).split()
            other = list(words)
            if goal < 60:  # a cut end costs a shingle a word, a changed word five
                other = other[: goal - rng.randint(1, max(1, goal // 6))]
            else:
                for j in rng.sample(range(goal), max(1, goal // rng.randint(45, 60))):
                    other[j] = "changed"
            if 0.80 <= jaccard(" ".join(words), " ".join(other)) <= 0.86:
                rows += [(at, " ".join(words)), (at + 1, " ".join(other))]
                at, made = at + 2, made + 1
    held = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    true = {(i, j) for i in range(len(held)) for j in range(i) if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])}
    assert len(true) >= 300
    found = grouped(frame(spark, rows), "doc_id", "text", 5, 120, 8, 6, TREE_NODES, 0.8)
    root = {r.doc_id: bytes(r.root) for r in found.select("doc_id", "root").collect()}
    got = {(i, j) for i in range(len(held)) for j in range(i) if root[i] == root[j]}
    recall = len(true & got) / len(true)
    print(f"recall {recall:.4f} of {len(true)} pairs")
    assert recall >= 0.97
    assert got <= true  # no chains here: what shares a root is alike by itself


def test_stage_compares_texts_of_one_print(spark):
    refrain = "la " * 400
    rows = [(i, refrain + prose(random.Random(i), 60)) for i in range(6)]
    assert len({r.doc_id for r in without_near_duplicates(frame(spark, rows)).collect()}) == 6


def crowded_sets(rng, n):
    """Sets around one centre, their prints, and which of them hang together at 0.8."""
    sets = sorted({tuple(sorted(rng.sample(range(26), rng.randint(18, 25)))) for _ in range(n)} | {()})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return sets, root


def parted(n, a, b):
    root = list(range(n))
    for i, j in zip(a, b, strict=True):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


@pytest.mark.parametrize("seed", range(3))
def test_links_are_checked_before_they_join(seed):
    sets, root = crowded_sets(random.Random(seed), 90)
    prints = np.array([random.Random(seed * 1000 + i).getrandbits(64) for i in range(len(sets))], np.uint64).reshape(-1, 1)
    held = ShingleSets(pa.array([list(s) for s in sets], pa.list_(pa.int64())), 0.8)
    a, b = BKForest(prints, np.zeros(len(sets), int)).links(64, held)
    assert held.alike(a, b).all()
    assert parted(len(sets), a.tolist(), b.tolist()) == root


def test_crowded_sets_are_dealt(spark):
    sets, root = crowded_sets(random.Random(8), 60)
    rows = [(1, bytearray(i.to_bytes(16, "big")), list(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, print binary, set array<long>")
    for limits in ({"tree_nodes": 12}, {"tree_shingles": 200}, {}):
        got = [(int.from_bytes(r.a), int.from_bytes(r.b)) for r in alike_links(df, 64, 0.8, 1, **limits).collect()]
        assert parted(len(sets), [x for x, _ in got], [y for _, y in got]) == root
