from __future__ import annotations

import random

import numpy as np
import pytest
from conftest_llm import frame, plain, prose
from pyspark.sql import functions as F

from roundcast.llm.common import parted
from roundcast.llm.decontaminate import _shards, decontaminate, find_hits, normalised
from roundcast.llm.line_crf import MEASURES, chains, fit, line_measures, marginals, score_documents, train
from roundcast.llm.line_runs import dedup_lines, repeated_runs
from roundcast.llm.quality_rules import quality_rules
from roundcast.llm.warc import read_archive, write_archive

# --- decontamination


def items_of(rng, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    out = [(str(i), " ".join(t.upper().split()[4:22])) for i, t in enumerate(texts[:6])]
    return out + [("short", "spam, SPAM"), ("none", "?!"), ("null", None), (None, texts[0]), ("twice", texts[1]), ("twice", "漢字 the the")]


def hits_brute(rows, items, size):
    windows = {}
    for item, text in items:
        w = normalised(text)
        if item is not None:
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, text in rows:
        w = normalised(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                own = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_words", [50_000, 60])
def test_hits_as_brute_force(spark, docs, shard_words):
    rows, df = docs
    items = items_of(random.Random(2), rows)
    table = spark.createDataFrame(items, "item_id string, text string")
    hits = find_hits(df, table, shard_words=shard_words, keep_text=True, carry=("key",))
    got = [(r.doc_id, r.n_words, sum(s.last - s.first + 1 for s in r.spans), r["items"]) for r in hits.collect()]
    assert sorted(got, key=repr) == hits_brute(rows, items, 10)
    for r in hits.collect():
        assert r.c0 == 1
        for s in r.spans:
            part = normalised(r.text.encode()[s.start : s.end].decode())
            assert part == normalised(r.text)[s.first : s.last + 1]


def test_clean_texts_have_no_hits(spark, docs):
    rows, df = docs
    table = spark.createDataFrame([("a", prose(random.Random(9), 40)), ("b", rows[5][1])], "item_id string, text string")
    clean = decontaminate(df, table, max_coverage=1.0).drop("n_hit")
    assert clean.count() == len(rows)
    in_shards = decontaminate(df, table, max_coverage=1.0, shard_words=60).drop("n_hit")
    assert plain(in_shards, "doc_id", "text") == plain(clean, "doc_id", "text")
    assert find_hits(clean, table).where(F.size("spans") > 0).where("n_words > 40").count() == 0
    assert decontaminate(df, table.limit(0)).count() == len(rows)
    assert decontaminate(df.limit(0), table).count() == 0


# --- lines


def lines_brute(rows, min_words=5):
    """Every run of lines, of whatever length, with so many words; a later place of one goes."""
    split = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")] for _, t in rows]
    first = {}
    order = [(d is None, d or 0) for d, _ in rows]

    def runs(own):
        for at in range(len(own)):
            words = 0
            for end in range(at + 1, len(own) + 1):
                words += len(own[end - 1][1].encode().split())
                if words >= min_words:
                    yield at, end, tuple(x for _, x in own[at:end])

    for key, own in zip(order, split, strict=True):
        for at, _, run in runs(own):
            first[run] = min(first.get(run, (key, at)), (key, at))
    out = []
    for (d, t), key, own in zip(rows, order, split, strict=True):
        gone = set()
        for at, end, run in runs(own):
            if first[run] < (key, at):
                gone.update(i for i, _ in own[at:end])
        text = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((d, len(own), len(gone), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_words", [1, 5, 7])
def test_lines_as_brute_force(spark, docs, min_words):
    rng = random.Random(3)
    pool = [prose(rng, n).replace("\n", " ") for n in (3, 4, 5, 60, 6, 1, 1, 2)] + ["", "  "]
    rows = [*docs[0], *((600 + i, "\n".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(40))]
    got = plain(dedup_lines(frame(spark, rows), min_words=min_words), "doc_id", "n_lines", "n_removed", "text")
    assert got == lines_brute(rows, min_words)


def test_runs_count_by_words(spark):
    """A repeated line of ten words goes, two repeated lines of a word stay, five of them go."""
    rights = "all rights to this text are with those who wrote"
    rows = [(1, f"one text\n{rights}\nyes\nno"), (2, f"two text\n{rights}\nother\nyes\nno\nend"), (3, "a\nb\nc\nd\ne\nf"), (4, "x\na\nb\nc\nd\ne\ny")]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "two text\nother\nyes\nno\nend", 3: rows[2][1], 4: "x\ny"}


def test_maximal_runs(spark):
    long = {c: " ".join([c] * 3) for c in "abcdeqxyz"}
    texts = {1: "abcde", 2: "xab|cdyde", 3: "bcqxabcz", 4: None}
    rows = [(d, t and "\n".join("" if c == "|" else long[c] for c in t)) for d, t in texts.items()]
    got = plain(repeated_runs(frame(spark, rows)), "doc_id", "first", "lines", "of_doc", "of_first")
    assert got == sorted(
        [(2, 1, 4, 1, 0), (2, 6, 2, 1, 3), (3, 0, 2, 1, 1), (3, 3, 2, 2, 0), (3, 4, 3, 1, 0)], key=repr
    )


def test_only_rows_that_may_have_a_key_meet_the_keys(spark):
    rows = [(i if i % 5 else None, i % 7, f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, check int, text string")
    keys = df.where("text like '%3'").select("doc_id", "check")
    named = set(map(tuple, keys.collect()))
    may, not_in = (x.collect() for x in parted(df, keys, ["doc_id", "check"]))
    assert sorted(map(tuple, [*may, *not_in]), key=repr) == sorted(rows, key=repr)
    assert not {(r["doc_id"], r["check"]) for r in not_in} & named
    # two keys share a bit of 2 ^ 25 now and then
    assert sum((r["doc_id"], r["check"]) not in named for r in may) <= 2
    none, every = (x.count() for x in parted(df, keys.limit(0), ["doc_id", "check"]))
    assert (none, every) == (0, 2000)


def test_texts_that_lose_no_line_are_not_shuffled(docs):
    plan = dedup_lines(docs[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "bitmap_construct_agg" in plan


def test_line_dedup_carries_columns(docs, no_docs):
    done = dedup_lines(docs[1], carry=("n_words", "text"))
    assert done.columns == ["doc_id", "n_lines", "n_removed", "text", "c0", "c1"]
    assert {r.c0 for r in done.collect()} == {"y"}
    assert dedup_lines(no_docs).collect() == []


# --- rules


def test_rules(docs, no_docs):
    rows, df = docs
    got = {}
    for r in quality_rules(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for d, t in rows:
        words = (t or "").encode().split()
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = {p for i, x in enumerate(runs) if runs.count(x) > 1 for p in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (
            len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
            len(many), len(words) < 50 or 100 * len(many) > 50 * len(words),
        )
        assert want in got[d]
    assert quality_rules(no_docs).collect() == []


def test_rules_reject_what_is_noise(spark):
    good = "the cat sat on the mat and " * 2 + " ".join(f"word{i} of the{i} tale" for i in range(30))
    rows = [(1, good), (2, good.upper()), (3, good.replace(" ", " | ")), (4, "the cat sat " * 40), (5, "too short"), (6, None)]
    assert {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


# --- the field


def test_marginals_as_all_labellings():
    rng = np.random.default_rng(1)
    of = np.array([0, 3, 3, 4, 8])
    gain, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, total = marginals(gain, moves, chains(of))
    want, sums, logs = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(of[:-1], of[1:], strict=True):
        n = b - a
        if not n:
            continue
        weights, labellings = [], []
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights.append(np.exp(sum(gain[a + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))))
            labellings.append(y)
        z = sum(weights)
        logs += np.log(z)
        for w, y in zip(weights, labellings, strict=True):
            want[a:b] += w / z * np.array(y)
            for i in range(n - 1):
                sums[y[i], y[i + 1]] += w / z
    assert np.allclose(good, want) and np.allclose(expected, sums) and np.isclose(total, logs)


def test_measures_do_not_depend_on_neighbours_in_the_batch():
    texts = [b"One line here.\nANOTHER!! LINE!!", b"", b"a a a a\n\n  \nb | c"]
    joined = line_measures(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        own = line_measures(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(own.x, joined.x[joined.of[i] : joined.of[i + 1]])
    assert joined.x.shape == (4, MEASURES)


def noise(rng):
    words = prose(rng, rng.choice([20, 80, 200])).replace(" ", rng.choice([" | ", "!! ", "### "]))
    return words if rng.random() < 0.7 else words.upper()


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([20, 80, 200])) if i % 4 else noise(rng)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (1002, " \n "), (None, rows[0][1]), rows[1]]
    got = score_documents(frame(spark, rows + extra), labels, carry=("text",)).collect()
    assert len(got) == len(rows) + 5
    own = {r.doc_id: r.score for r in got}
    right = [(own[i] >= 0.3) == (i % 4 > 0) for i, _ in rows]
    assert np.mean(right) > 0.95
    assert len({own[1000], own[1001], own[1002]}) == 1 and 0 <= own[1000] <= 1
    again = {r.doc_id: r.score for r in score_documents(frame(spark, rows + extra), labels).collect()}
    assert again == own
    assert {r.score for r in score_documents(frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.5}
    assert score_documents(frame(spark, []), labels).collect() == []


def test_training_sample_is_bounded_in_lines(spark):
    rows = [(i, f"some text\nof two lines {i}") for i in range(30)] + [(1, "again\nthe same id")] * 3 + [(50, "x\n" * 5000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    fields = [train(frame(spark, rows), labels, "doc_id", "text", "quality", 4000, n) for n in (20_000, 60, 10)]
    assert all(np.isfinite(f.scores(line_measures(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))))[0] for f in fields)


def test_shards_are_bounded(spark):
    long = " ".join(f"w{i}" for i in range(500))
    items = spark.createDataFrame([("a", long), ("a", long), ("b", "w1 w2 w3"), ("c", None), (None, "x")] * 40, "item_id string, text string")
    shards = [[(r.item, r.text) for r in s.collect()] for s in _shards(items, "item_id", "text", 100, 10)]
    assert len(shards) > 1 and all(sum(len(t.split()) for _, t in s) <= 100 for s in shards)
    words = long.split()
    pieces = [t for s in shards for i, t in s if i == "a"]
    assert all(sum(" ".join(words[i : i + 10]) in p for p in pieces) == 1 for i in range(491))
    hits = find_hits(spark.createDataFrame([(1, long), (2, "w1 w2 w3")], "doc_id long, text string"), items, shard_words=100).collect()
    assert {r.doc_id: (r.n_words, [(s["first"], s["last"]) for s in r.spans], r["items"]) for r in hits} == {
        1: (500, [(0, 499)], ["a", "b"]), 2: (3, [(0, 2)], ["b"])
    }


def test_fit_of_one_label():
    lines = line_measures(np.frombuffer(b"some text here", np.uint8), np.array([0, 14]))
    for label in (True, False):
        assert (fit(lines.x, lines.of, np.array([label])).scores(lines)[0] > 0.5) == label


# --- archive


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\n</p>" * 120
    rows = [(1, "http://a\r\nx: y", big), (2, None, big), (7, "u", big), (7, "again", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "", big + "!")]
    pages = spark.createDataFrame([(*r, 0, b"") for r in rows], "page_id long, url string, html string, digest int, header binary")
    path = f"file://{tmp_path}/archive"
    write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = read_archive(spark, path).collect()
    assert sorted((r.page_id or 0, bytes(r.payload)) for r in got) == sorted((p or 0, (h or "").encode()) for p, _, h in rows)
    for r in got:
        revisit = "WARC-Type: revisit" in r.header
        assert revisit == (r.page_id in (1, 2, None))
        assert ("WARC-Refers-To: <urn:page:7>" in r.header) == revisit
        body = b"" if revisit else bytes(r.payload)
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n"
        assert f"Content-Length: {len(body)}\r\n" in r.header and r.header.count("\r\n\r\n") == 1
    write_archive(pages.limit(0), f"file://{tmp_path}/none")
    assert read_archive(spark, f"file://{tmp_path}/none").collect() == []
