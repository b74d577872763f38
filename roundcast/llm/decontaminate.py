"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words become one automaton for each shard of at most ``shard_words`` words; that bound
holds for what is collected and broadcast. Documents are streamed through it: the state and the length of the
longest suffix that some item contains are followed word by word, and where the length reaches a window, the
window is a hit. Only stretches in which every word belongs to the items can reach a window, so the others are
passed over. With several shards each makes a pass, and the hits of a document are put together by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import (
    ALNUM,
    BYTE_CODE,
    LOWER,
    chunks,
    prefix_sums,
    slice_hash,
    stored,
    table,
    text_key,
    words_of,
)

WINDOW = 10
SHARD_WORDS = 50_000
_HITS = "n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def normalised(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lowered."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    first, last, _ = words_of(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]


class ItemAutomaton:
    """Suffix automaton of several items over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in normalised(text)]
            if words:
                coded.append((item, words))
                self._add(words)
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        #: State of a window's words -> items that contain the window.
        self.holders: dict[int, set[str]] = {}
        #: State -> length and item of each item shorter than a window that ends there.
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in coded:
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.holders.setdefault(self.suffix(state, window), set()).add(item)
            if len(words) < window:
                self.short.setdefault(self.suffix(state, len(words)), []).append((len(words), item))
        self.hashes = np.sort(
            np.array([_hash(w) for w in self.number], np.uint64) if self.number else np.zeros(0, np.uint64)
        )

    def _add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _split(self, p: int, q: int, w: int) -> int:
        """A state of its own for the shorter strings of q that p reaches by w."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest suffix, with the word w, that an item contains."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """First and last word of each item window in a stretch, with the items."""
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length >= self.window:
                yield i - self.window + 1, i, self.holders[self.suffix(state, self.window)]
            if self.short:
                at = state
                while at > 0:
                    for n, item in self.short.get(at, ()):
                        if n <= length:
                            yield i - n + 1, i, {item}
                    at = self.link[at]


def _hash(word: bytes) -> int:
    sums = prefix_sums(BYTE_CODE[np.frombuffer(word, np.uint8)])
    return int(slice_hash(sums, np.array([0]), np.array([len(word)]))[0])


def _spans(hits: list[tuple[int, int, set[str]]]) -> tuple[list[list[int]], list[str]]:
    """Overlapping hits as maximal runs of words, and all items."""
    runs: list[list[int]] = []
    items: set[str] = set()
    for first, last, names in sorted(hits, key=lambda h: h[0]):
        items |= names
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return runs, sorted(items)


def document_hits(texts: pa.Array, automaton: ItemAutomaton) -> Iterator[tuple[int, list[dict], list[str]]]:
    """For each text: number of words, hit runs in words and bytes, items."""
    number = automaton.number
    for _, _, data, starts in chunks(texts):
        data = LOWER[data]
        first, last, of = words_of(data, starts, ALNUM)
        found: dict[int, list[tuple[int, int, set[str]]]] = {}
        if len(first) and len(automaton.hashes):
            codes = slice_hash(prefix_sums(BYTE_CODE[data]), first, last)
            at = np.minimum(np.searchsorted(automaton.hashes, codes), len(automaton.hashes) - 1)
            known = automaton.hashes[at] == codes
            cut = np.flatnonzero(np.diff(known)) + 1
            edges = np.union1d(np.concatenate(([0], cut, [len(known)])), of)
            long = np.flatnonzero(np.diff(edges) >= automaton.shortest)
            raw = data.tobytes()
            for a, b in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
                if not known[a]:
                    continue
                stretch = [number.get(raw[x:y], -1) for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)]
                for i, j, names in automaton.hits(stretch):
                    doc = int(np.searchsorted(of, a, "right")) - 1
                    found.setdefault(doc, []).append((a + i, a + j, names))
        for doc, (w0, w1) in enumerate(pairwise(of.tolist())):
            runs, items = _spans(found.get(doc, []))
            byte0 = int(starts[doc])
            spans = [
                {"first": a - w0, "last": b - w0, "start": int(first[a]) - byte0, "end": int(last[b]) - byte0}
                for a, b in runs
            ]
            yield w1 - w0, spans, items


def cut_bytes(text: str, spans: list[dict]) -> str:
    """The text without the spans, given by their bytes in UTF-8."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode()


def cleaned(texts: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """Texts without their spans; a null stays null."""
    return pa.array([cut_bytes(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)], pa.string())


def _shards(items: DataFrame, item_id: str, text_col: str, shard_words: int, window: int) -> list[DataFrame]:
    """Items in shards of at most ``shard_words`` words: nothing larger is ever collected.

    Repeated items count once. A long item is cut into pieces that overlap by a window less a word, so that each of its
    windows lies in one; a piece has at most half a shard, and a shard is filled up to the other half.
    """
    most = max(shard_words // 2, 2 * window)
    slim = items.select(F.col(item_id).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = normalised(text)
                for at in range(0, max(len(words) - window + 1, 1), most - window + 1):
                    piece = words[at : at + most]
                    if piece:
                        row = [pa.array([item]), pa.array([b" ".join(piece).decode()]), pa.array([len(piece)], pa.int64())]
                        yield pa.RecordBatch.from_arrays(row, names=["item", "text", "n"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n"].to_numpy()
            before = held + np.cumsum(n) - n
            held += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(before)], names=["item", "text", "n", "part", "before"])

    pieces = slim.where("item is not null and text is not null").distinct().mapInArrow(cut, "item string, text string, n long")
    pieces = stored(pieces.mapInArrow(running, "item string, text string, n long, part int, before long"), "items")
    # a row for each partition of the first pass
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    shard = F.floor((F.col("base") + F.col("before")) / max(shard_words - most, 1))
    pieces = stored(pieces.join(bases, "part").select("item", "text", shard.alias("shard")), "shards")
    names = [r.shard for r in pieces.select("shard").distinct().orderBy("shard").collect()]
    return [pieces.where(F.col("shard") == k).select("item", "text") for k in names] or [pieces.select("item", "text")]


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    keep_text: bool = False,
    carry: tuple[str, ...] = (),
    cut: bool = False,
) -> DataFrame:
    """Word windows of the items in every document.

    Returns a row for each row of ``docs``: the id, ``n_words``, ``spans`` (maximal hit runs: first and last word,
    first byte and end byte), ``items`` (ids as strings, sorted; those with a window in the document), and the text
    if ``keep_text``, without the spans if ``cut``. An item of fewer words than a window is one window; an item without words is none. A null text
    has no words, an item without an id is left out, repeated rows are judged alike. The columns named in ``carry``
    come along as c0, c1 ...; others, whatever their names, are not read. No items: no hits.
    """
    spark = docs.sparkSession
    along = [f"c{i}" for i in range(len(carry))]
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(a) for a, c in zip(along, carry, strict=True)]
    )
    shown = ["doc_id", *along, *(["text"] if keep_text else [])]

    def one_pass(shard: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(ItemAutomaton([(r.item, r.text) for r in shard.collect()], window))
        names = ["doc_id", *along, "text"] if keep_text else ["doc_id", *along]
        kinds = "".join(f"{c} {slim.schema[c].dataType.simpleString()}, " for c in names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held.value
            for batch in batches:
                counts, spans, found = [], [], []
                for n, s, i in document_hits(batch["text"], automaton):
                    counts.append(n)
                    spans.append(s)
                    found.append(i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(cleaned(batch["text"], spans) if cut and c == "text" else batch[c] for c in names),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "last", "start", "end")]))),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    names=[*names, "n_words", "spans", "items"],
                )

        return slim.mapInArrow(run, kinds + _HITS)

    shards = _shards(items, item_id, item_text, shard_words, window)
    if len(shards) == 1:
        return one_pass(shards[0])
    keep_text, later, cut = True, cut, False
    found = None
    for shard in shards:
        own = stored(
            one_pass(shard).where(F.size("spans") > 0).select("doc_id", text_key(F.col("text")).alias("key"), "spans", "items").distinct(),
            "shard_hits",
        )
        found = own if found is None else found.unionByName(own)
    joined = found.groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = one_pass(shards[0]).select("doc_id", *along, "text", "n_words", text_key(F.col("text")).alias("key"))
    out = counted.alias("d").join(
        joined.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.key = h.key"), "left"
    )
    merged = F.expr(
        """aggregate(array_sort(coalesce(h.spans, array())), cast(array() as array<struct<first:long,last:long,start:long,end:long>>),
           (a, s) -> if(size(a) > 0 and s.first <= element_at(a, -1).last + 1,
                        concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first,
                          'last', greatest(element_at(a, -1).last, s.last), 'start', element_at(a, -1).start,
                          'end', greatest(element_at(a, -1).end, s.end)))),
                        concat(a, array(s))))"""
    )
    hits = out.select(*[f"d.{c}" for c in shown], "d.n_words", merged.alias("spans"), F.expr("coalesce(h.items, cast(array() as array<string>))").alias("items"))
    if not later:
        return hits
    named = hits.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [cleaned(batch["text"], batch["spans"].to_pylist()) if c == "text" else batch[c] for c in named]
            yield pa.RecordBatch.from_arrays(columns, names=named)

    return hits.mapInArrow(clean, hits.schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    max_coverage: float = 0.5,
    carry: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Documents without benchmark passages: hit runs are cut out of the text, and a document of whose words more
    than ``max_coverage`` are hit goes as a whole. Returns for the documents that stay the id, ``text``, ``n_hit`` and
    the columns of ``carry`` as c0, c1 ..."""
    along = [f"c{i}" for i in range(len(carry))]
    hits = find_hits(docs, items, doc_id, text_col, keep_text=True, carry=carry, cut=True, **options).withColumn("n_hit", hit_words())
    return hits.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")).select("doc_id", *along, "text", "n_hit")


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Digest of the hits in every document against every item."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
with dw as (
    select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
bw as (
    select cast(item_id as varchar) item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
win as (
    select distinct item, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') s
    from (select item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from bw where len(w) > 0)),
sizes as (select distinct n from win),
dwin as (
    select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select doc_id, i, dwin.n, item from dwin join win on dwin.n = win.n and dwin.s = win.s),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from hits) group by 1)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
    sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join cov on cov.doc_id = dw.doc_id left join its on its.doc_id = dw.doc_id
"""
