"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens, the pieces that the tokenizer never merges across: leaves are
runs of pre-tokens with their characters and tokens, inner nodes the sums of two. An edit finds its leaf by going down
the characters' sums. Only the pre-tokens that it touches are split and encoded again, with those beside it whose
split may look at it, and then on until a boundary meets an old one; the sums on the way to the root are renewed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.llm.common import table

#: Entries of a worker's cache, some 30 MB; workers live on after a task.
CACHED = 250_000
LEAF = 64


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PieceCounter:
    """Tokens of each pre-token."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pattern = regex.compile(public_tokenizers.PATTERN)
        self.split, self.match = pattern.findall, pattern.match
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = [known.get(p) for p in pieces]
        if None in out:
            if len(known) >= CACHED:
                known.clear()
            for i, n in enumerate(out):
                if n is None:
                    n = known.get(pieces[i])
                    if n is None:
                        n = known[pieces[i]] = len(self.encoding.encode_ordinary(pieces[i]))
                    out[i] = n
        return out


@cache
def counter_of(path: str) -> PieceCounter:
    """One for each Python worker, whatever tasks it runs."""
    return PieceCounter(path)


class TokenTree:
    """Segment tree of one text: chars[k] and tokens[k] sum up nodes 2k and 2k + 1; leaves hold up to LEAF pieces at
    first and any number after edits."""

    def __init__(self, text: str, counter: PieceCounter, sizes: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.counter = counter
        self.text = text
        if sizes is None:
            pieces = counter.split(text)
            sizes, counts = list(map(len, pieces)), counter.counts(pieces)
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (s, c) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(s), sum(c)
        for k in range(self.width - 1, 0, -1):
            self._add_up(k)

    def _add_up(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (sizes, counts)
        k = self.width + leaf
        self.chars[k], self.tokens[k] = sum(sizes), sum(counts)
        while k > 1:
            k //= 2
            self._add_up(k)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character ``at``, or the last one, and the leaf's first character."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; the number of pre-tokens encoded for it."""
        old = self.text
        self.text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        # a piece looks one character past its end: begin two pieces before the edit
        low, begin = self.find(max(start - 1, 0))
        while True:
            sizes, _ = self.leaves[low]
            ends, at = [], begin
            for n in sizes:
                at += n
                ends.append(at)
            keep = bisect_right(ends, start - 1) - 1
            if keep >= 0 or low == 0:
                break
            low -= 1
            while low and not self.leaves[low][0]:
                low -= 1
            begin -= self.chars[self.width + low]
        keep = max(keep, 0)
        at = ends[keep - 1] if keep else begin
        high, after = low, begin + self.chars[self.width + low]
        olds = iter(ends[keep:])
        boundary = next(olds, None)
        pieces, whole = [], len(self.text)

        def old_boundary(place: int) -> bool:
            """Whether a piece of the old text, after the edit, ends at this place of the new one."""
            nonlocal boundary, olds, high, after
            place -= shift
            if place < end:
                return False
            while True:
                while boundary is not None and boundary < place:
                    boundary = next(olds, None)
                if boundary is not None:
                    return boundary == place
                if high + 1 >= len(self.leaves):
                    return False
                high += 1
                base, cut = after, []
                for n in self.leaves[high][0]:
                    base += n
                    cut.append(base)
                after = base
                olds = iter(cut)
                boundary = next(olds, None)

        at0, met = at, False
        while at < whole:
            at = self.counter.match(self.text, at).end()
            pieces.append(at)
            if old_boundary(at):
                met = True
                break
        cuts = [at0, *pieces]
        new_pieces = [self.text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        new_counts = self.counter.counts(new_pieces)
        if not met:
            high = len(self.leaves) - 1
            rest_sizes, rest_counts = [], []
        else:
            # what is left of the leaf in which the boundary lies
            sizes, counts = self.leaves[high]
            begin_high = after - sum(sizes)
            n, done = begin_high, 0
            while n < at - shift:
                n += sizes[done]
                done += 1
            rest_sizes, rest_counts = sizes[done:], counts[done:]
        first_sizes, first_counts = self.leaves[low]
        self._set(low, first_sizes[:keep] + list(map(len, new_pieces)) + rest_sizes, first_counts[:keep] + new_counts + rest_counts)
        for k in range(low + 1, high + 1):
            if self.leaves[k][0]:
                self._set(k, [], [])
        return len(new_pieces)

    def flat(self) -> tuple[list[int], list[int]]:
        return [n for s, _ in self.leaves for n in s], [n for _, c in self.leaves for n in c]


_TREE = "text string, sizes array<int>, counts array<int>, n_tokens long"


def token_trees(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each document with the leaves of its tree: ``sizes`` (characters) and ``counts`` (tokens) of its pre-tokens, and
    ``n_tokens``. A null text counts as empty: no leaves, no tokens. Every row counts by itself, repeated ones and null
    ids too; other columns are not read; no rows give no rows."""
    place = path or vocabulary()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(place)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                own = batch.slice(low, 200)
                sizes, counts, totals = [], [], []
                for text in own["text"].to_pylist():
                    pieces = counter.split(text)
                    n = counter.counts(pieces)
                    sizes.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                    counts.append(np.array(n, np.int32))
                    totals.append(sum(n))
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], own["text"], _lists(sizes), _lists(counts), pa.array(totals, pa.int64())],
                    names=["doc_id", "text", "sizes", "counts", "n_tokens"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {_TREE}")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))


def apply_edits(trees: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """Trees after their ``edits``, an array of (start, end, new): characters of the text that the row holds, in any
    order; an edit that overlaps one before it, or doesn't lie in the text, is left out, and null edits are none.

    Returns doc_id, ``n_before``, ``n_tokens``, ``n_edits`` (applied) and ``n_encoded`` (pre-tokens encoded for them), and
    ``with_text`` the tree's columns as in ``token_trees``, so that the next edits can follow.
    """
    place = path or vocabulary()
    kind = trees.schema["doc_id"].dataType.simpleString()
    figures = "n_before long, n_tokens long, n_edits long, n_encoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(place)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                own = batch.slice(low, 200)
                before = own["n_tokens"].to_pylist()
                after, edited, encoded, texts, sizes, counts = [], [], [], [], [], []
                for row, edits in enumerate(own["edits"].to_pylist()):
                    n = again = 0
                    tree = None
                    if edits:
                        text = own["text"][row].as_py()
                        tree = TokenTree(text, counter, own["sizes"][row].as_py(), own["counts"][row].as_py())
                        todo, last = [], 0
                        for e in sorted(edits, key=lambda e: (e["start"], e["end"])):
                            if last <= e["start"] <= e["end"] <= len(text):
                                todo.append(e)
                                last = e["end"]
                        for e in reversed(todo):  # from the end, so that the places before stay
                            again += tree.edit(e["start"], e["end"], e["new"] or "")
                        n = len(todo)
                    after.append(tree.tokens[1] if tree else before[row])
                    edited.append(n)
                    encoded.append(again)
                    if with_text:
                        texts.append(tree.text if tree else own["text"][row].as_py())
                        s, c = tree.flat() if tree else (own["sizes"][row].as_py(), own["counts"][row].as_py())
                        sizes.append(s)
                        counts.append(c)
                tail = [pa.array(texts, pa.string()), pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], *(pa.array(x, pa.int64()) for x in (before, after, edited, encoded)), *(tail if with_text else [])],
                    names=["doc_id", "n_before", "n_tokens", "n_edits", "n_encoded", *(["text", "sizes", "counts"] if with_text else [])],
                )

    return trees.mapInArrow(run, f"doc_id {kind}, {figures}" + (", text string, sizes array<int>, counts array<int>" if with_text else ""))


#: Personal data and secrets, and what stands for them. Mail addresses are looked for from their @.
MASKS = (
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\+?\d[\d ()-]{7,}\d", "<NUMBER>"),
    (r"\b(?=\w*\d)(?=\w*[A-Za-z])\w{16,}\b", "<KEY>"),
)
_HOST = re.compile(r"[\w-]+\.[\w.-]+\w")
_NAME = re.compile(r"[\w.+-]")


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Mail addresses, left to right. The name before an @ is read once and backwards: a pattern that begins with it would
    be tried again from each of its letters."""
    last, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        start = at
        while host and start > last and _NAME.match(text, start - 1):
            start -= 1
        if start < at:
            last = host.end()
            yield start, last, "<EMAIL>"
        at = text.find("@", max(last, at + 1))


def united(matches: list[tuple[int, int, str]]) -> list[dict]:
    """Edits for matches (start, end, new), those that overlap united to one: it has the new text of the longest of them,
    of equally long ones of the first."""
    out, most = [], 0
    for start, end, new in sorted(matches, key=lambda m: m[:2]):
        if out and start < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
            if end - start > most:
                most, out[-1]["new"] = end - start, new
        else:
            most = end - start
            out.append({"start": start, "end": end, "new": new})
    return out


def mask_edits(trees: DataFrame) -> DataFrame:
    """``trees`` with the edits that mask personal data and secrets; matches that overlap are masked as one."""
    names = trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(re.compile(p), new) for p, new in MASKS]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        for batch in batches:
            edits = [
                united([*addresses(text), *((*m.span(), new) for p, new in masks for m in p.finditer(text))]) if _DIGIT_OR_AT.search(text) else []
                for text in batch["text"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], names=[*names, "edits"])

    _DIGIT_OR_AT = re.compile(r"[\d@]")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trees.schema)
    return trees.mapInArrow(run, f"{kinds}, edits array<struct<start:int,end:int,new:string>>")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after personal data and secrets in it are masked."""
    return apply_edits(mask_edits(token_trees(table(spark, sf_dir, "documents"))), with_text=False)
