"""Substring dedup with suffix automata.

Every window of ``length`` words meets its copies by its anchor (see ``anchors``). The surroundings of an anchor are
a reference shard: in the order of the documents that have them first, each is streamed through the suffix automaton
of those before it, which gives its matching statistics, and is then added. Where the matching length reaches a
window, the state of the window's words names the first document that has it. Maximal spans of such windows go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.llm.anchors import Repeats, by_anchor, merged, repeated_spans, with_spans, word_units
from roundcast.llm.common import table

LENGTH = 50
GRAM = 25
#: An automaton holds at most so many surroundings, of fewer than two windows' words each.
CROWD = 1000


class SuffixAutomaton:
    """Of words; each state knows the document that had its strings first, as documents come in order."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link, self.first = [0], [-1], [None]

    def add(self, words: list[bytes], doc) -> None:
        nexts, length, link, first = self.next, self.length, self.link, self.first
        last = 0
        for w in words:
            known = nexts[last].get(w)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, known, w)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(doc)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A state of its own for the shorter strings of q that p reaches by w."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.first.append(self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def windows(self, words: list[bytes], size: int) -> tuple[dict[int, int | None], bool]:
        """First document of each window that is known, by the window's first word; whether all words are."""
        nexts, length, link = self.next, self.length, self.link
        found = {}
        state = n = 0
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                n = length[state]
            state = nexts[state].get(w, 0)
            n = n + 1 if state else 0
            if n >= size:
                while length[link[state]] >= size:
                    state = link[state]
                    n = length[state]
                found[i - size + 1] = self.first[state]
        return found, len(found) == len(words) - size + 1


def matcher(size: int):
    def match(part: pa.Table) -> Iterator[tuple[int, list[dict]]]:
        firsts, counts, bodies = (part[c].to_pylist() for c in ("first", "n", "body"))
        for rows in by_anchor(part):
            automaton = SuffixAutomaton()
            for row in rows:
                words = bodies[row].split()
                found, whole = automaton.windows(words, size)
                if found or counts[row] > 1:
                    own = [found.get(i, firsts[row]) for i in range(len(words) - size + 1)]
                    runs, at = [], 0
                    for doc, same in groupby(own):
                        n = sum(1 for _ in same)
                        runs.append({"low": at, "high": at + n - 1, "first": doc})
                        at += n
                    yield row, runs
                if not whole and row != rows[-1]:
                    automaton.add(words, firsts[row])

    return match


def repeats(length: int, gram: int, crowd: int = CROWD) -> Repeats:
    return Repeats(word_units, length, gram, matcher(length), True, crowd, lambda texts: texts.repartition("anchor"))


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> DataFrame:
    """Documents without word windows that a document with a smaller id has too.

    Words are runs outside ASCII white space. Returns, for each row of ``docs``, ``doc_id`` (long), ``n_words``,
    ``n_removed``, ``spans`` (removed runs of words) and ``text``, the words that stay, joined by one space. Windows
    are judged on the input. A null or empty text has no words, and one below ``length`` words no window. Rows that
    share an id are one document: none counts as smaller than the other. A null id counts as larger than all.
    Other columns are not read; no rows give no rows.
    """
    joined = with_spans(*repeated_spans(docs, repeats(length, gram, crowd), doc_id, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, texts = [], [], [], []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                words, runs = text.as_py().encode().split(), merged(own)
                sizes.append(len(words))
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"first": a, "end": b} for a, b in runs])
                for a, b in reversed(runs):
                    del words[a:b]
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "text"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first:long,end:long>>, text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents against each other."""
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from w where len(w) >= 50)),
hit as (select win.doc_id, i from win join (select h, min(doc_id) top from win group by 1) t on t.h = win.h where win.doc_id > top),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i + 50)) p from hit) group by 1)
select w.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(ps), 0) as bigint) n_removed,
    sha256(array_to_string(case when ps is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end, ' ')) kept_sha256
from w left join gone on gone.doc_id = w.doc_id
"""
