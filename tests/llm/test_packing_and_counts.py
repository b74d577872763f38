from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest_llm import SYLLABLES, frame, prose

from roundcast.llm.packing import WordTokenizer, pack, vocabulary
from roundcast.llm.token_counts import LEAF, TokenTree, apply_edits, counter_of, mask_edits, token_trees
from roundcast.llm.token_counts import vocabulary as byte_vocabulary

ODD = [
    "", " ", "a<|endoftext|>b", "It's they're DON'T ''s!!s'S", "x\x1cy a\x85b a\xa0b", "ﬁne Σίσυφος ΑΣ", "ÉCOLE école naïve",
    "123 4½ ²³ ª ßẞ İstanbul", "“curly” it’s 漢字 🙂 a​b", "a\x00b\x7f\x80\x9f", "soft\xadhyphen µ ÷×¿ ¡hola!", "é ́x",
]


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(vocabulary())


def test_word_ids_as_the_library(words, docs):
    for text in ODD + [t or "" for _, t in docs[0]]:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_make_up_the_documents(docs, words, length):
    rows, df = docs
    pieces = [r.asDict() for r in pack(df, length=length).collect()]
    seen = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(ids) == p["length"] > 0
        seen.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for n, parts in seen.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or n == max(seen)
    got = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        if p["start"] == 0:
            got.setdefault(p["doc_id"], []).append(b"")
        got[p["doc_id"]][-1] += bytes(p["ids"])
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(words.encode(t or "") + (2).to_bytes(4, "little"))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


def test_no_rows(no_docs):
    assert pack(no_docs).collect() == []
    assert token_trees(no_docs).collect() == []


def whole(text):
    return len(counter_of(byte_vocabulary()).encoding.encode_ordinary(text))


@pytest.mark.parametrize("seed", range(6))
def test_edits_as_counted_anew(seed):
    rng = random.Random(seed)
    counter = counter_of(byte_vocabulary())
    text = prose(rng, rng.choice([0, 1, 30, 6 * LEAF])) + rng.choice(["", "   ", "\n\n"])
    tree = TokenTree(text, counter)
    for _ in range(150):
        n = len(tree.text)
        a = rng.randint(0, n)
        b = min(n, a + rng.choice([0, 0, 1, 2, 5, 40, 400]))
        new = rng.choice(["", " ", "  ", "\n", "x", "'s", "'", "9", "é漢", "<EMAIL>", " ".join(rng.choices(SYLLABLES, k=5)), "   b"])
        before = len(tree.flat()[0])
        again = tree.edit(a, b, new)
        sizes, counts = tree.flat()
        assert [len(p) for p in counter.split(tree.text)] == sizes
        assert tree.tokens[1] == sum(counts) == whole(tree.text)
        assert tree.chars[1] == len(tree.text)
        assert again <= before + 10 + len(new)


def test_an_edit_encodes_little():
    text = prose(random.Random(1), 5000)
    tree = TokenTree(text, counter_of(byte_vocabulary()))
    assert tree.edit(len(text) // 2, len(text) // 2 + 3, "new words") < 12


def test_edits_of_a_table(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 200) + f" mail me.{i}@some-host.org or 10.0.0.{i} " + prose(rng, 50)) for i in range(20)]
    rows += [(90, None), (91, ""), (None, "no 1 to mask"), rows[0]]
    trees = token_trees(frame(spark, rows))
    done = [r.asDict() for r in apply_edits(mask_edits(trees)).collect()]
    assert len(done) == len(rows)
    for r in done:
        assert r["n_tokens"] == whole(r["text"]) == sum(r["counts"])
        assert sum(r["sizes"]) == len(r["text"])
        if r["doc_id"] is not None and r["doc_id"] < 90:
            assert r["n_edits"] == 2 and r["n_encoded"] < 30 and "<EMAIL>" in r["text"]
        else:
            assert r["n_edits"] == 0 and r["n_before"] == r["n_tokens"]


def test_overlapping_matches_are_masked_whole(spark):
    rows = [(1, "to 123456789@x.com now"), (2, "has 1234567890abcdefgh in"), (3, "1234567890 me@some.org")]
    got = {r.doc_id: (r.text, r.n_edits) for r in apply_edits(mask_edits(token_trees(frame(spark, rows)))).collect()}
    assert got == {1: ("to <EMAIL> now", 1), 2: ("has <KEY> in", 1), 3: ("<NUMBER> <EMAIL>", 2)}


def test_edits_that_do_not_fit_are_left_out(spark):
    kind = "doc_id long, text string, sizes array<int>, counts array<int>, n_tokens long, edits array<struct<start:int,end:int,new:string>>"
    text = "one two three"
    tree = TokenTree(text, counter_of(byte_vocabulary()))
    edits = [(4, 7, "2"), (5, 9, "overlaps"), (50, 60, "outside"), (0, 0, None)]
    rows = [(1, text, *tree.flat(), tree.tokens[1], edits), (2, text, *tree.flat(), tree.tokens[1], None)]
    got = {r.doc_id: (r.text, r.n_edits) for r in apply_edits(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("one 2 three", 2), 2: (text, 0)}


def test_checksums_of_pieces(docs, words):
    from pyspark.sql import functions as F

    for r in pack(docs[1]).select("ids", F.crc32("ids").alias("crc")).limit(20).collect():
        assert zlib.crc32(bytes(r.ids)) == r.crc


def test_addresses_as_the_pattern_in_linear_time():
    import re

    from roundcast.llm.token_counts import addresses

    pattern, rng = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+\w"), random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices("ab@.-_ 1+", k=rng.randint(3, 25)))
        assert [m[:2] for m in addresses(text)] == [m.span() for m in pattern.finditer(text)], text
    assert list(addresses("a" * 5_000_000)) == []
    assert len(list(addresses("a" * 2_000_000 + "@b.cd"))) == 1
