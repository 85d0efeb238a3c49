"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Spaces become marks, and a text is cut before every mark.  The distinct marked words of
a batch are sorted, which lists the paths of their trie depth-first; the forward state
of a path is kept on a stack, so a prefix that words share is solved once.

The model is of the byte-pair kind, whose encoding is not the path of the highest sum of
scores, so the forward pass uses transition scores instead: zero where the merge rules
leave two neighbouring pieces apart, minus infinity where they would have merged across
them.  Exactly one path has a finite score for every prefix, and it is the merge encoding.
Two pieces stay apart if no merge across their border comes before the merges that
build the pieces themselves, which is read off the two merge trees and remembered.

Characters that the model does not know become byte pieces.  The mark itself, if a text
has it, is encoded as bytes too, so that decoding gives back every text exactly (the
public library turns it into a space).

Defined results: null and empty texts have no pieces; any other text decodes to itself,
white space included; equal texts have equal pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import fresh
from holdfast.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_BYTES = 2 << 20
# A task keeps the pieces of the words it has met, up to this many.
KEPT_WORDS = 200_000


@dataclass
class Vocabulary:
    """Pieces by id; ``rank`` orders merges (smaller first); ``parts`` are the two
    pieces that a piece is merged from, if it is merged."""

    pieces: list[str]
    ids: dict[str, int]
    rank: list[float]
    parts: list[tuple[int, int] | None]
    byte_ids: list[int]
    longest: int


def merge(text: str, ids: dict[str, int], rank: list[float]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge encoding of a short string step by step, and its last merge."""
    parts, last = list(text), None
    while True:
        best = None
        for at, (a, b) in enumerate(pairwise(parts)):
            found = ids.get(a + b)
            if found is not None and (best is None or rank[found] < best[0]):
                best = (rank[found], at)
        if best is None:
            return parts, last
        at = best[1]
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    ids = {p: i for i, p in enumerate(pieces) if not special[i]}
    if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in ids):
        raise ValueError("the model has pieces that cross a word border")
    rank = [-model.get_score(i) for i in range(n)]
    parts: list[tuple[int, int] | None] = [None] * n
    for piece, i in ids.items():
        whole, last = merge(piece, ids, rank)
        if len(whole) == 1 and last:
            parts[i] = (ids[last[0]], ids[last[1]])
        elif len(whole) > 1:
            parts[i] = (-1, -1)  # no merge ever gives this piece
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(pieces, ids, rank, parts, byte_ids, max(map(len, ids)))


class Encoder:
    """Words to piece ids; keeps what it has learned about pairs and words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.apart: dict[int, bool] = {}  # by both pieces in one number
        self.spines: dict[tuple[int, bool], list[int]] = {}
        known = "".join(re.escape(p) for p in vocabulary.ids if len(p) == 1 and p != MARK)
        self.runs = re.compile(f"[{known}]+|[^{known}]", re.DOTALL)
        self.plain = re.compile(f"[{known}]*", re.DOTALL)
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.endings = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            if vocabulary.parts[i] != (-1, -1):
                self.endings.add_word(piece, i)
        self.endings.make_automaton()
        self.words: dict[str, int] = {}  # word to its place in the arrays below
        self.blank()

    def blank(self) -> None:
        self.words, self.flat, self.bounds = {}, array("i"), array("q", [0])

    def spine(self, piece: int, right: bool) -> list[int]:
        """The pieces along one edge of the merge tree, in the order they are built."""
        found = self.spines.get((piece, right))
        if found is None:
            found, at = [piece], piece
            while self.v.parts[at] is not None:
                at = self.v.parts[at][right]
                found.append(at)
            found.reverse()
            self.spines[piece, right] = found
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        v, left, right = self.v, self.spine(a, True), self.spine(b, False)
        i = j = 0
        while True:
            across = v.ids.get(v.pieces[left[i]] + v.pieces[right[j]])
            next_left = v.rank[left[i + 1]] if i + 1 < len(left) else np.inf
            next_right = v.rank[right[j + 1]] if j + 1 < len(right) else np.inf
            # of equal merges the left one comes first
            if across is not None and v.rank[across] < next_left and v.rank[across] <= next_right:
                return False
            if next_left == np.inf and next_right == np.inf:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def solve(self, strings: list[str]) -> Iterator[list[int]]:
        """Piece ids of sorted strings of known characters."""
        longest, apart, stay, sizes = self.v.longest, self.apart, self._stay_apart, self.sizes
        n, ending = len(self.v.pieces), self.endings.iter
        before, state = "", [-1]  # state[i]: last piece of the path that spells the first i characters
        for text in strings:
            shared = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            # all pieces that end after the shared prefix, at each end the longest first
            known = shared
            for at, piece in ending(text, max(0, shared + 1 - longest)):
                if at < known:
                    continue  # this end is settled
                if at > known:
                    break
                last = state[at + 1 - sizes[piece]]
                if last >= 0:
                    pair = last * n + piece
                    fine = apart.get(pair)
                    if fine is None:
                        fine = apart[pair] = stay(last, piece)
                    if not fine:
                        continue
                state.append(piece)
                known += 1
            if known < len(text):
                raise AssertionError(f"no path spells {text[: known + 1]!r}")
            before = text
            out, at = [], len(text)
            while at:
                out.append(state[at])
                at -= sizes[state[at]]
            yield out[::-1]

    def spaces(self, n: int) -> list[int]:
        """A run of marks between words; such merges rank equal, the left one first."""
        ids, top = self.v.ids, self.v.longest
        out: list[int] = []
        while n:
            # runs merge from the left, so a run is settled in stretches of four pieces
            stretch = min(n, 4 * top)
            parts, _ = merge(MARK * stretch, ids, self.v.rank)
            take = parts if stretch == n else parts[:1]
            out += [ids[p] for p in take]
            n -= sum(map(len, take))
        return out

    def learn(self, words: set[str]) -> None:
        """Solves the words that are not known yet."""
        if len(self.words) > KEPT_WORDS:
            self.blank()
        new = words - self.words.keys()
        plain = {w for w in new if self.plain.fullmatch(w)}
        odd = {w: self.pieces_of(w) for w in new - plain}
        inner = {s for parts in odd.values() for s in parts if isinstance(s, str)}
        solved = {}
        strings = sorted({MARK + w for w in plain} | inner)
        for text, ids in zip(strings, self.solve(strings), strict=True):
            if text in inner:
                solved[text] = ids
            if text[0] == MARK and text[1:] in plain:
                self._store(text[1:], ids)
        for word, parts in odd.items():
            self._store(word, [i for part in parts for i in (solved[part] if isinstance(part, str) else part)])

    def pieces_of(self, word: str) -> list:
        """Runs of known characters, and the byte pieces of the others."""
        runs = self.runs.findall(word)
        out: list = []
        if not runs or not self.plain.fullmatch(runs[0]):
            out.append(MARK)
        for at, run in enumerate(runs):
            if self.plain.fullmatch(run):
                out.append(MARK + run if at == 0 else run)
            else:
                out.append([self.v.byte_ids[b] for b in run.encode("utf-8", "surrogatepass")])
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text ends."""
        cut = [t.split(" ") if t else [] for t in texts]
        self.learn({w for words in cut for w in words if w})
        places: list[int] = []
        counts = []
        for words in cut:
            start = len(places)
            if "" in words:
                places += self._with_runs(words)
            else:
                places += [self.words[w] for w in words]
            counts.append(len(places) - start)
        flat, bounds = np.array(self.flat, np.int32), np.array(self.bounds, np.int64)
        at = np.array(places, np.int64)
        sizes = bounds[at + 1] - bounds[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(bounds[at] - ends[:-1], sizes) + np.arange(ends[-1])
        return flat[take], ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def _with_runs(self, words: list[str]) -> list[int]:
        """Places of the words of a text that has runs of spaces."""
        places, gap = [], 0
        for word in words:
            if word == "":
                gap += 1
                continue
            place = self.words[word]
            if gap:
                first = self.flat[self.bounds[place]]
                if self.v.pieces[first] == MARK:  # the word's own mark belongs to the run
                    places.append(self._run(gap + 1))
                    places.append(self._rest(word, place))
                else:
                    places.append(self._run(gap))
                    places.append(place)
                gap = 0
            else:
                places.append(place)
        if gap:
            places.append(self._run(gap))
        return places

    def _store(self, key: str, ids: list[int]) -> int:
        if key not in self.words:
            self.words[key] = len(self.bounds) - 1
            self.flat.extend(ids)
            self.bounds.append(len(self.flat))
        return self.words[key]

    def _run(self, n: int) -> int:
        key = " " * n  # no word holds a space
        return self.words[key] if key in self.words else self._store(key, self.spaces(n))

    def _rest(self, word: str, place: int) -> int:
        return self._store(f" {word}", self.flat[self.bounds[place] + 1 : self.bounds[place + 1]])


def _decoder(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, and their bounds."""
    plain = [p.replace(MARK, " ").encode() if p in v.ids else b"" for p in v.pieces]
    for b, i in enumerate(v.byte_ids):
        plain[i] = bytes([b])
    return np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])])


def decode_all(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of runs of ids."""
    data, bounds = table
    sizes = bounds[ids + 1] - bounds[ids]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(bounds[ids] - at[:-1], sizes) + np.arange(at[-1])].tobytes()
    cuts = at[ends]
    return [out[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in pairwise(cuts.tolist())]


def encode(
    docs: DataFrame, text_col: str = "text", model_path: str = MODEL, verify: bool = False
) -> DataFrame:
    """The rows with ``ids``, and with ``round_trip`` if ``verify`` (the ids decode to the
    text; null counts as empty).  A name that is taken already gets a trailing underscore."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(load_vocabulary(model_path)))
    names = [fresh(docs, "ids"), *([fresh(docs, "round_trip")] if verify else [])]
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kinds = f"`{names[0]}` array<int>" + (f", `{names[1]}` boolean" if verify else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**shared.value)
        encoder, table = Encoder(vocabulary), _decoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                ids, ends = encoder.encode_all(texts)
                added = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if verify:
                    back = decode_all(table, ids, ends)
                    added.append(pa.array([a == b for a, b in zip(texts, back, strict=True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{plain}, {kinds}")


def decode(rows: DataFrame, ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text of their ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(load_vocabulary(model_path)))
    name = fresh(rows, "decoded")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _decoder(Vocabulary(**shared.value))
        for batch in batches:
            lists = [x or [] for x in batch.column(ids_col).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.int64, ends[-1])
            texts = decode_all(table, ids, ends)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
            )

    return rows.mapInArrow(run, f"{plain}, `{name}` string")


def with_count(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    return rows.withColumn(fresh(rows, "n_tokens"), F.size(ids_col).cast("long"))
