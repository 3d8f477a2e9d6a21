"""Encoding and decoding with a merge-type sentencepiece vocabulary (operator 7).

The encoding is exact and needs no merge queue over the text: an Aho-Corasick
automaton lists the pieces that start at each place, the longest is tried first, a
piece is accepted after its predecessor only if merging the two pieces' joint text
again gives just these two, and a bit field remembers the places from which no
encoding was found.  Neighbours that fit pairwise form the encoding that merging by
rank would give.

No piece crosses from a word into the space sign after it or over a line end, so a
text falls into units that are encoded alone; a worker remembers the units it met
(a bounded number).  One pass over the rows, no shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
#: Places of a unit whose pieces are looked up at a time.
BLOCK = 1024
#: Units and pairs that a worker remembers; when full, it starts anew.
KEPT = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SCHEMA = "doc_id bigint, ids array<int>, decoded string"


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        """pieces: (text, score, type) by id."""
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.score = [s for _, s, _ in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.unknown = next(i for i, k in enumerate(self.kind) if k == UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unit = re.compile(self.unit_pattern())
        self.fits: dict[tuple[int, int], bool] = {}
        #: Pieces that merging can produce at all, and the two parts of the last merge of each.
        self.parts: dict[int, tuple[str, str]] = {}
        self.reached = {p: i for p, i in self.id.items() if self.merge(p, self.parts) == [i]}
        #: Pieces with a part that ranks after the whole (runs of spaces); the others merge in order of rank.
        late = {i for i, two in self.parts.items() for x in two if (k := self.id.get(x)) in self.parts and self.score[k] <= self.score[i]}
        while more := {i for i, two in self.parts.items() if i not in late and any(self.id.get(x) in late for x in two)}:
            late |= more
        self.late = late
        self.right = {i: self.edge(i, 1) for i in self.reached.values()}
        self.left = {i: self.edge(i, 0) for i in self.reached.values()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.reached.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.reached), default=1)
        self.units = Units(self)

    def unit_pattern(self) -> str:
        """A pattern of pieces of text that no vocabulary piece connects: cuts are made where
        a space sign, a line end or one of a set of signs follows another kind of character."""
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE and a != SPACE or "\n" in (a, b) for a, b in pairs):
            return "(?s).+"
        def wordy(c: str) -> bool:
            return c.isalpha() or c.isdecimal()

        signs = {c for p in self.id for c in p if c.isascii() and not wordy(c)} - {"\n", SPACE}
        while open_pairs := {(a, b) for a, b in pairs if b in signs and a not in signs and a != SPACE}:
            signs = (signs - {b for a, b in open_pairs if wordy(a)}) | {a for a, _ in open_pairs if not wordy(a)}
        n = re.escape("".join(sorted(signs)))
        if not n:
            return f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+"
        return f"{SPACE}+[{n}]*[^{SPACE}\n{n}]*|[{n}]+[^{SPACE}\n{n}]*|[^{SPACE}\n{n}]+|\n+"

    def edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """What stands at one edge of a piece while it is merged, with the score of the merge
        that ends it; the single character first, the piece itself last."""
        out, now, ends = [], piece, float("-inf")
        while True:
            text = self.text[now] if isinstance(now, int) else now
            out.append((text, ends))
            if now not in self.parts:
                return out[::-1]
            ends, part = self.score[now], self.parts[now][side]
            now = self.id.get(part, part)

    def merge(self, text: str, last: dict[int, tuple[str, str]] | None = None) -> list[int | str]:
        """Merging by rank: ids of pieces; characters without a piece stay as they are.  last gets the final two parts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            if last is not None and len(parts) == 2:
                last[self.id[text]] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id.get(p, p) for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            known = self.fits[left, right] = self.remerged(left, right)
        return known

    def remerged(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces gives these two: replays both pieces'
        merges at the common edge and looks for an earlier merge across it."""
        if left in self.late or right in self.late:
            return self.merge(self.text[left] + self.text[right]) == [left, right]
        ls, rs, get = self.right[left], self.left[right], self.id.get
        i = k = 0
        while True:
            (a, ends_a), (b, ends_b) = ls[i], rs[k]
            across = get(a + b)
            if across is not None and self.score[across] > ends_a and self.score[across] >= ends_b:
                return False
            if i + 1 == len(ls) and k + 1 == len(rs):
                return True
            if ends_a >= ends_b and i + 1 < len(ls):
                i += 1
            else:
                k += 1

    def candidates(self, unit: str) -> Callable[[int], list[tuple[int, int]]]:
        """The pieces (length, id) that start at a place of unit, by rising length; found BLOCK places at a time, so that a long unit needs no table of its size."""
        n = len(unit)
        if n <= BLOCK:
            starts: list[list[tuple[int, int]]] = [[] for _ in unit]
            for end, found in self.automaton.iter(unit):
                starts[end - found[0] + 1].append(found)
            return starts.__getitem__
        blocks: dict[int, list[list[tuple[int, int]]]] = {}

        def at(place: int) -> list[tuple[int, int]]:
            block = place // BLOCK
            own = blocks.get(block)
            if own is None:
                if len(blocks) > 8:
                    blocks.pop(next(iter(blocks)))
                first = block * BLOCK
                own = blocks[block] = [[] for _ in range(min(BLOCK, n - first))]
                for end, found in self.automaton.iter(unit[first : first + BLOCK + self.longest]):
                    start = end - found[0] + 1
                    if start < len(own):
                        own[start].append(found)
            return own[place - block * BLOCK]

        return at

    def backtrack(self, unit: str) -> list[int | str]:
        """The encoding of one unit; characters without a piece are returned as such."""
        n, starts = len(unit), self.candidates(unit)
        failed = bytearray(n // 8 + 1)  # a bit for each place from which nothing fits
        chosen: list[tuple[int | str, int, int]] = []  # piece, its place, shorter candidates left
        place, last, fits = 0, None, self.fits
        found = starts(0)
        left = len(found) or 1
        while place < n:
            picked = None
            if not found and left:  # no piece starts here: the character stands alone and fits any neighbour
                left = 0
                if not failed[place + 1 >> 3] >> (place + 1 & 7) & 1:
                    picked, length = unit[place], 1
            while found and left:
                left -= 1
                length, i = found[left]
                end = place + length
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = True if last.__class__ is not int else fits.get((last, i))
                    if fit or fit is None and self.compatible(last, i):
                        picked = i
                        break
            if picked is not None:
                chosen.append((picked, place, left))
                place, last = place + length, picked
                if place < n:
                    found = starts(place)
                    left = len(found) or 1
            else:
                failed[place >> 3] |= 1 << (place & 7)
                if not chosen:
                    raise ValueError(f"no encoding of {unit!r}")
                _, place, left = chosen.pop()
                found = starts(place)
                last = chosen[-1][0] if chosen else None
        return [x for x, _, _ in chosen]

    def encode_unit(self, unit: str) -> list[int]:
        out, end, last = [], -1, None
        for at, (length, i) in self.automaton.iter_long(unit):  # the longest matches fit as they are in most units
            if at - length != end or last is not None and not self.compatible(last, i):
                break
            out.append(i)
            end, last = at, i
        else:
            if end == len(unit) - 1:
                return out
        out = []
        for x in self.backtrack(unit):
            if isinstance(x, int):
                out.append(x)
            elif self.byte:
                out += [self.byte[b] for b in x.encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers end to end; the text gets one space sign in front."""
        if not text:
            return b""
        return b"".join(map(self.units.__getitem__, self.unit.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces as UTF-8 (a wrong byte gives U+FFFD), space signs as spaces, less the first."""
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append("" if self.kind[i] == CONTROL else " ⁇ " if self.kind[i] == UNKNOWN else self.text[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


class Units(dict):
    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> bytes:
        ids = array("i", self.vocabulary.encode_unit(unit)).tobytes()
        if len(unit) < 64:
            if len(self) >= KEPT:
                self.clear()
            self[unit] = ids
        return ids


class Decoder:
    """decode() for many ids at once: a table of the pieces' bytes, joined and split by row."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        def shown(i: int) -> bytes:
            kind, text = vocabulary.kind[i], vocabulary.text[i]
            if kind == BYTE:
                return bytes([int(text[3:5], 16)])
            return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

        self.shown = [shown(i) for i in range(len(vocabulary.text))]

    def __call__(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


_LOADED: dict[str, tuple[Vocabulary, Decoder]] = {}


def pieces_of(path: str) -> list[tuple[str, float, int]]:
    """(text, score, type) of each piece in a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a merge-type vocabulary without text normalisation is needed")
    return [(p.piece, p.score, p.type) for p in model.pieces]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, decoded for each row of docs (doc_id, text).

    The vocabulary file is read on the driver and its pieces are broadcast (some 32,000).
    Null and empty texts have no ids and decode to an empty text; repeated rows are encoded
    one by one; a text of any length is encoded whole, in time proportional to it; an empty
    table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    C.tune(spark)
    pieces = spark.sparkContext.broadcast(pieces_of(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _LOADED:
            vocabulary = Vocabulary(pieces.value)
            _LOADED[model_path] = (vocabulary, Decoder(vocabulary))
        vocabulary, decoder = _LOADED[model_path]
        for batch in batches:
            for part in C.chunks(batch):
                ids = [np.frombuffer(vocabulary.encode(t or ""), dtype=np.int32) for t in part.column("text").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([decoder(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
