"""SentencePiece encoding and decoding: exact merges by backtracking.

A model of the merge type joins the best-scored pair of neighbours until none is left. Its result is the one sequence of
pieces in which every piece is what its own text merges to and no two neighbours would have merged across their border
earlier. So a text is read from left to right: one pass of an Aho-Corasick automaton names the longest piece at every
position; a piece is taken if it is compatible with the one before, which is decided by taking both merges apart again,
otherwise the next shorter one is tried; a position from which nothing leads on is marked in a bitfield and never tried
again, so that each position fails at most once.

Texts are cut where no piece reaches across: before spaces, and between characters that no piece holds side by side; a
character that no piece has becomes bytes. What lies between is encoded once and remembered. Each row is encoded by itself, so that no rows have to meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.llm.common import table

SPACE = "▁"
#: Texts of a half of a worker's two caches, the longest of them in characters, and pairs looked at.
CACHED_STRETCHES = 150_000
CACHED_LENGTH = 40
CACHED_PAIRS = 500_000
#: Characters of one text that are looked at together.
SLICE = 1 << 18
_NEVER = 1 << 62


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges:
    """The pieces of a model by rank: 0 merges first; single characters have no rank and are there from the start.

    pieces: texts; scores: higher merges first. Pieces of equal score have to be the last ones and runs of spaces, for
    then they merge from the left once everything else is done. A piece whose text merges to something else is left out.
    """

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        import ahocorasick

        many: dict[float, int] = {}
        for p, s in zip(pieces, scores, strict=True):
            if len(p) > 1:
                many[s] = many.get(s, 0) + 1
        self.runs = {len(p) for p, s in zip(pieces, scores, strict=True) if len(p) > 1 and many[s] > 1}
        tied = {p for p, s in zip(pieces, scores, strict=True) if len(p) > 1 and many[s] > 1}
        ranked = sorted(((s, p) for p, s in zip(pieces, scores, strict=True) if len(p) > 1 and p not in tied), reverse=True)
        least = min((s for s, _ in ranked), default=0.0)
        if any(p.strip(SPACE) for p in tied) or any(many[s] > 1 and s >= least for s in many):
            raise ValueError("pieces of equal score have to be runs of spaces that merge last")
        if tied and any(SPACE * 2 in p for _, p in ranked):
            raise ValueError("a piece holds a run of spaces, whose pieces have equal scores")

        self.texts = sorted({c for p in pieces for c in p} | {p for p in pieces if len(p) == 1})
        self.rank = [-1] * len(self.texts)
        self.left, self.right = [-1] * len(self.texts), [-1] * len(self.texts)
        known = {t: k for k, t in enumerate(self.texts)}
        self.joined: dict[tuple[int, int], int] = {}
        self._pairs: dict[int, bool] = {}
        # by rank: a piece merges from two pieces of lower ranks that don't merge across their border before
        for rank, (_, p) in enumerate(ranked):
            splits = [(a, b) for i in range(1, len(p)) if (a := known.get(p[:i])) is not None and (b := known.get(p[i:])) is not None]
            new = len(self.texts)
            parts = next(((a, b) for a, b in splits if self._apart(a, b, rank)), None)
            if parts is None:
                continue
            known[p] = new
            self.texts.append(p)
            self.rank.append(rank)
            self.left.append(parts[0])
            self.right.append(parts[1])
            self.joined.update(dict.fromkeys(splits, new))
        # pairs of which one piece came later
        for p, k in known.items():
            for i in range(1, len(p)):
                a, b = known.get(p[:i]), known.get(p[i:])
                if a is not None and b is not None:
                    self.joined[a, b] = k
        if any(self.rank[k] <= max(self.rank[a], self.rank[b]) for k, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0):
            raise ValueError("a piece merges before its parts")
        self.known = known
        self.space = known.get(SPACE, -1)
        self.size = [len(t) for t in self.texts]
        # the longest other piece that a piece begins with
        self.shorter = [next((known[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in known), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for t, k in known.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        # neighbours that some piece holds side by side; between others no piece reaches across
        self.inside = {a + b for p in (*known, *tied) for a, b in zip(p, p[1:], strict=False)}

    def parts(self, text: str) -> list[str]:
        """The text cut wherever no piece reaches across."""
        inside = self.inside
        if inside.issuperset(map(add, text, text[1:])):
            return [text]
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inside]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _apart(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether a and b, side by side, stay two pieces: their merges are undone, the latest first, and no pair that
        lies at the border at some time may have a merge that comes before those that end it."""
        rank, joined = self.rank, self.joined
        end_a = end_b = limit  # rank of the merge that takes in what is at the border now
        while True:
            whole = joined.get((a, b))
            # of equal merges the one on the left is first
            if whole is not None and rank[whole] < end_a and rank[whole] <= end_b:
                return False
            if rank[a] > rank[b]:
                end_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                end_b, b = rank[b], self.left[b]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def tokens(self, text: str) -> list[int]:
        """Pieces of a text all of whose characters are known."""
        size, shorter, apart = self.size, self.shorter, self.apart
        n = len(text)
        longest = [0] * n
        for end, k in self.automaton.iter(text):
            at = end - size[k] + 1
            if size[k] >= size[longest[at]]:
                longest[at] = k
        failed = bytearray((n + 8) // 8)
        out: list[int] = []
        at, piece = 0, longest[0]
        while True:
            end = at + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or apart(out[-1], piece)):
                out.append(piece)
                if end == n:
                    return self._spaces(out) if self.runs and SPACE * 2 in text else out
                at, piece = end, longest[end]
                continue
            piece = shorter[piece]
            while piece < 0:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
                piece = shorter[piece]

    def _spaces(self, tokens: list[int]) -> list[int]:
        """Single spaces merged, from the left; a run of n > 1 of them is -n."""
        out: list[int] = []
        for k in tokens:
            if k != self.space:
                out.append(k)
                continue
            n = 1
            while out and out[-1] < 0 and n - out[-1] in self.runs:
                n -= out.pop()
            out.append(-n)
        return [self.space if k == -1 else k for k in out]


class Remembered:
    """Ids of short texts: up to CACHED_STRETCHES asked for of late, and as many from before."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        ids = self.new.get(text)
        return self.again(text) if ids is None else ids

    def again(self, text: str) -> bytes | None:
        """For a text that may be among the old ones."""
        ids = self.old.get(text)
        if ids is None:
            return self.new.get(text)
        self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) <= CACHED_LENGTH:
            if len(self.new) >= CACHED_STRETCHES:
                self.old, self.new = self.new, {}
            self.new[text] = ids


class PieceEncoder:
    """Ids of texts as the library gives them, begin and end ids aside."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(map(model.is_unused, range(model.get_piece_size()))):
            raise ValueError("the model has unused pieces")
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        pieces = list(map(model.id_to_piece, plain))
        # what no piece reaches across
        self.cut = not any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.merges = merges = Merges(pieces, list(map(model.get_score, plain)))
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        unknown = model.unk_id()
        ids = {p: k for k, p in zip(plain, pieces, strict=True)}
        self.ids = [_packed([ids[t]]) if t in ids else self._as_bytes(t, unknown) for t in merges.texts]
        self.run_ids = {n: _packed([ids[SPACE * n]]) for n in merges.runs}
        self.unknown = unknown
        self.begin, self.end = _packed([model.bos_id()]), _packed([model.eos_id()])
        self.known, self.part_ids = Remembered(), Remembered()

    def _as_bytes(self, text: str, unknown: int) -> bytes:
        if any(k == unknown for k in self.bytes):
            return _packed([unknown])
        return _packed([self.bytes[b] for b in text.encode()])

    def stretch(self, text: str) -> bytes:
        merges, held = self.merges, self.part_ids
        out = []
        for part in merges.parts(text):
            ids = held.get(part)
            if ids is None:
                if len(part) == 1:
                    at = merges.known.get(part, -1)
                    ids = self.ids[at] if at >= 0 else self._as_bytes(part, self.unknown)
                else:
                    ids = b"".join([self.ids[t] if t >= 0 else self.run_ids[-t] for t in merges.tokens(part)])
                held.keep(part, ids)
            out.append(ids)
        return b"".join(out)

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """Stretches of a normal text: each begins with all spaces of a run; slice by slice."""
        if not self.cut:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = at + SLICE
            while 0 <= (end := text.find(SPACE, end)) and text[end - 1] == SPACE:
                end += 1
            part = text[at:end] if end >= 0 else text[at:]
            at += len(part)
            words = part.split(SPACE)
            head = words.pop(0)
            if "" in words:
                out, spaces = [], ""
                for w in words:
                    spaces += SPACE
                    if w:
                        out.append(spaces + w)
                        spaces = ""
                yield [*([head] if head else []), *out, *([spaces] if spaces else [])]
            else:
                yield [*([head] if head else []), *[SPACE + w for w in words]]

    def encode(self, text: str) -> bytes:
        """Ids, begin and end ids too, as little-endian unsigned 32-bit numbers."""
        out = [self.begin]
        for stretches in self._stretches(self.model.normalize(text)):
            found = list(map(self.known.new.get, stretches))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        ids = self.known.again(stretches[i])
                        if ids is None:
                            ids = self.stretch(stretches[i])
                            self.known.keep(stretches[i], ids)
                        found[i] = ids
            out += found
        out.append(self.end)
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


@cache
def encoder_of(path: str) -> PieceEncoder:
    """One for each Python worker, whatever tasks it runs."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every text, with begin and end ids, and the text that the library decodes them to.

    Returns, for each row of ``docs``, ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.
    A null text counts as empty: the begin and the end id, and an empty text. Repeated rows and null ids give a row each;
    other columns are not read; no rows give no rows. A text is held whole, with its ids; its stretches go slice by slice.
    """
    place = path or vocabulary()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = encoder_of(place)
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                own = batch.slice(low, 100)
                ids = list(map(encoder.encode, own["text"].to_pylist()))
                decoded = [encoder.model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; ids and text as their digests."""
    done = encode_pieces(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
