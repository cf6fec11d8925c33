"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens.  It starts as one state
in which every byte loops; each merge (u, v), in order, adds a gadget: the arcs on u now lead to
a copy of their old target without its arc on v, and an arc on uv leads where v led.  A text is
accepted along exactly one path, and that path is its encoding.

The copies are stored as differences: a gadget is an entry (u, v) -> merge number in `cut`,
and a token knows the merge that made it and its two parts.  Whether a state has an arc is read
off those tables (`arc`) and kept in the transition table once it is known, so the automaton
stays linear in the number of merges.  A pre-split word is encoded by walking that table over
the longest vocabulary entries first; the walk marks positions from which no path leads on.
Decoding emits the arc labels (the bytes of each token).
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Fixed value: the pattern that splits text before byte-level merges.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# White space on both sides of a space: there a cut before the space could fall inside a piece.
INNER_SPACE = re.compile(r"\s \s")
# Distinct pieces whose codes a Python worker keeps; beyond that it starts afresh (memory bound).
CACHE = 800_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """Deterministic automaton compiled from a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.label = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.token = {b: i for i, b in self.label.items()}
        self.born = {i: -1 for i in self.label}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for n, (u, v) in enumerate(spec["model"]["merges"]):
            self._gadget(n, vocab[u], vocab[v], vocab[u + v])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.trie: dict = {}                        # labels by successive bytes; -1: the token that ends here
        for label, i in self.token.items():
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.arcs: dict[tuple[int, int], bool] = {}

    def _gadget(self, n: int, u: int, v: int, uv: int) -> None:
        """Merge number n: arcs on u lose the arc on v behind them; uv leads where v led."""
        self.cut.setdefault((u, v), n)
        if uv not in self.parts:
            self.parts[uv] = (u, v)
            self.born[uv] = n

    def arc(self, u: int, v: int) -> bool:
        """Whether the state that u leads to has an arc on v in the finished automaton."""
        known = self.arcs.get((u, v))
        if known is None:
            known = self.arcs[(u, v)] = self.reached(v) and self._arc(u, v, len(self.cut) + 1)
        return known

    def reached(self, t: int) -> bool:
        """Whether any arc carries t: its two parts could follow each other when it was made."""
        known = self.arcs.get((-1, t))
        if known is None:
            u, v = self.parts.get(t, (-1, -1))
            known = self.arcs[(-1, t)] = u < 0 or (self.reached(u) and self.reached(v) and self._arc(u, v, self.born[t]))
        return known

    def _arc(self, a: int, b: int, before: int) -> bool:
        """The same question after the merges with a number under ``before``."""
        cut, born, parts = self.cut, self.born, self.parts
        while cut.get((a, b), before) >= before:
            if born[b] < 0 and born[a] < 0:
                return True
            if born[b] >= born[a]:      # an arc on b = (u, v) stands beside each arc on u; of u = v, beside those left
                u, v = parts[b]
                before, b = born[b] + (u == v), u
            else:                       # a leads where its second part led when a was made
                before, a = born[a], parts[a][1]
        return False

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted path over ``word``: token ids."""
        whole = self.token.get(word)
        if whole is not None and self.reached(whole):
            return [whole]
        arcs, trie, n = self.arcs, self.trie, len(word)
        path: list[tuple[int, list[tuple[int, int]], int]] = []     # position, arcs not yet tried, token before
        at, last, dead = 0, -1, set()
        todo: list[tuple[int, int]] | None = None
        while True:
            if todo is None:                        # labels that start here, the longest last
                todo, node, i = [], trie, at
                while i < n:
                    node = node.get(word[i])
                    if node is None:
                        break
                    i += 1
                    t = node.get(-1)
                    if t is not None:
                        todo.append((i, t))
            step = None
            while todo:
                end, t = todo.pop()
                if end in dead:
                    continue
                known = arcs.get((last, t))
                if known is None:
                    known = self.reached(t) if last < 0 else self.arc(last, t)
                if known:
                    step = t
                    break
            if step is not None:
                path.append((at, todo, last))
                if end == n:
                    return [x[2] for x in path[1:]] + [step]
                at, last, todo = end, step, None
            else:                                   # no arc leads on from here: back to the state before
                if not path:
                    raise ValueError("no path: the vocabulary lacks a byte")
                dead.add(at)
                at, todo, last = path.pop()

    def pieces(self, text: str) -> list[str]:
        """Cut ``text`` into strings whose encodings are independent of each other."""
        if "  " in text or INNER_SPACE.search(text):
            return SPLIT.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def segments(self, text: str) -> list[str]:
        """Text between special tokens, and the special tokens themselves, in order."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [text] if text else []
        return [x for x in self.special_split.split(text) if x]


class Emitter:
    """Concatenates one byte string per id: the labels of arcs, or the ids in decimal."""

    def __init__(self, strings: dict[int, bytes]):
        size = np.zeros(max(strings) + 1, np.int64)
        for i, x in strings.items():
            size[i] = len(x)
        self.size, self.start = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.blob[at].tobytes()


_WORKER: dict[str, tuple[TokenAutomaton, dict[str, bytes], Emitter, Emitter]] = {}


def worker_automaton(path: str):
    """The automaton, codes of known pieces and emitters of this Python worker, made once."""
    if path not in _WORKER:
        auto = TokenAutomaton(path)
        _WORKER[path] = (auto, {}, Emitter(auto.label), Emitter({i: b"%d," % i for i in auto.label}))
        gc.collect()
        gc.freeze()
    return _WORKER[path]


def piece_codes(auto: TokenAutomaton, codes: dict[str, bytes], pieces: list[str]) -> None:
    """Add the ids (int32) of all ``pieces`` to ``codes``."""
    for p in set(pieces).difference(codes):
        words = SPLIT.findall(p)
        for w in words:
            if w not in codes:
                codes[w] = array("i", auto.encode_word(w.encode())).tobytes()
        if len(words) != 1:
            codes[p] = b"".join([codes[w] for w in words])


def encode_ids(path: str, text: str) -> np.ndarray:
    auto, codes, _, _ = worker_automaton(path)
    if len(codes) > CACHE:
        codes.clear()
    out = []
    for seg in auto.segments(text):
        if seg in auto.special:
            out.append(array("i", [auto.special[seg]]).tobytes())
        else:
            pieces = auto.pieces(seg)
            piece_codes(auto, codes, pieces)
            out += [codes[p] for p in pieces]
    return np.frombuffer(b"".join(out), np.int32)


def decode_ids(path: str, ids: np.ndarray) -> str:
    return worker_automaton(path)[2](ids).decode("utf-8", "replace")


def _digests(path: str, text: str) -> tuple[int, str, str]:
    ids = encode_ids(path, text)
    listed = worker_automaton(path)[3](ids)[:-1]
    return (len(ids), hashlib.sha256(listed).hexdigest(),
            hashlib.sha256(decode_ids(path, ids).encode()).hexdigest())


def encode_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (the text that the ids decode to).  Null text counts as empty (no ids);
    texts of any length are encoded whole.  Narrow: no shuffle."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_digests(vocabulary, t) for t in b.column(1).to_pylist()]
            n, ids, dec = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids themselves."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_ids(vocabulary, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): labels of the ids in order; bytes that are not UTF-8 become U+FFFD."""
    id_type = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(vocabulary, np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return (encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
            .mapInArrow(run, f"id {id_type.simpleString()}, text string").withColumnRenamed("id", id_col))
