"""Byte-level BPE as a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merge table produces. It
starts as one state with a loop for every byte. Merges are compiled in order of priority,
each by one gadget for its pair (u, v):

* the state behind u is split: from now on, what follows u directly can't be v;
* wherever u could be read (and v behind it), a new arc labelled uv is added, which leads
  to the state that v led to before the split.

A state is thus the last token read; it inherits what was forbidden behind v when uv was
born, and so on down the right parts of uv. An arc x exists from a state if none of its
left parts was forbidden there when the next larger part was born. Both chains are short,
so the arcs are kept as the table ``cut`` of the splits and resolved along the chains
instead of being written out (states times tokens would be billions).

Every prefix of a byte string has exactly one accepted tokenization, so a word is encoded
in one pass over its positions: each position gets its only token and state from the
transitions of earlier positions. Decoding emits the arcs' labels.

Texts are split into words by the pattern of byte-level BPE; the tokenizer's own special
strings become their ids, as the reference library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Recent, small_batches, texts

# fixed values: the split pattern and the byte alphabet of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 60
# words remembered by a Python worker, twice this at most
CACHE_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class MergeAutomaton:
    """Compiled from byte strings of tokens (by id) and merges (pairs of ids, by priority)."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: t for t, i in tokens.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {i: -1 for t, i in tokens.items() if len(t) == 1}
        self.cut: dict[tuple[int, int], int] = {}
        self._open: dict[tuple[int, int], bool] = {}
        for time, (u, v) in enumerate(merges):
            self._gadget(time, tokens[u], tokens[v], tokens[u + v])
        self._open.clear()
        # every prefix of a label that an arc can have; -1: not a label itself
        self.arcs: dict[bytes, int] = {}
        for i in self.born:
            label = self.labels[i]
            for n in range(1, len(label)):
                self.arcs.setdefault(label[:n], -1)
            self.arcs[label] = i

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if u not in self.born or v not in self.born or uv in self.born:
            return
        if not self._arc(u, v):  # never reached: an earlier merge forbids this pair
            return
        self.cut[u, v] = time
        self.left[uv], self.right[uv], self.born[uv] = u, v, time

    def _arc(self, state: int, arc: int) -> bool:
        """Is there an arc ``arc`` out of the state behind token ``state``?"""
        cut, born, left, right = self.cut, self.born, self.left, self.right
        until = _NEVER  # splits of this part that the state has inherited
        while True:
            x, by = arc, _NEVER
            while True:
                at = cut.get((state, x))
                # a part's split counts before the larger arc is made; for a merge of
                # equal parts both have the same time, and the split comes first
                if at is not None and at < until and at <= by:
                    return False
                if x not in left:
                    break
                by, x = born[x], left[x]
            if state not in right:
                return True
            until, state = born[state], right[state]

    def encode(self, word: bytes) -> list[int]:
        arcs, known, step = self.arcs, self._open, self._arc
        end = len(word)
        token, back = [-1] * (end + 1), [0] * (end + 1)
        for i in range(end):
            state = token[i]
            for j in range(i + 1, end + 1):
                arc = arcs.get(word[i:j])
                if arc is None:
                    break
                if arc < 0 or token[j] >= 0:
                    continue
                if i:
                    pair = (state, arc)
                    is_open = known.get(pair)
                    if is_open is None:
                        if len(known) > 2_000_000:
                            known.clear()
                        is_open = known[pair] = step(state, arc)
                    if not is_open:
                        continue
                token[j], back[j] = arc, i
        out = []
        while end:
            out.append(token[end])
            end = back[end]
        return out[::-1]


class Tokenizer:
    """Encode and decode whole texts with the automaton of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        raw = functools.cache(lambda s: bytes(alphabet[c] for c in s))
        model = spec["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.automaton = MergeAutomaton(tokens, [(raw(a), raw(b)) for a, b in pairs])
        self.labels = self.automaton.labels | {i: s.encode() for s, i in self.special.items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self._words = regex.compile(PATTERN)
        self._word = Recent(lambda w: self._ids(w.encode()), CACHE_WORDS)
        # text between single blanks, which the pattern never reads across
        self._first = Recent(self._chunk, CACHE_WORDS // 8)
        self._rest = Recent(lambda c: self._chunk(" " + c), CACHE_WORDS)

    def _ids(self, word: bytes) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.automaton.encode(word))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word.__getitem__, self._words.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        if _WIDE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._rest.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part)
            for part in self._split.split(text)
        )

    def decode(self, ids: bytes) -> str:
        arcs = np.frombuffer(ids, dtype="<u4").tolist()
        emitted = b"".join(map(self.labels.__getitem__, arcs))
        return emitted.decode("utf-8", errors="replace")


# a blank next to other white space: then words depend on what stands around the blank
_WIDE = re.compile(r" \s|\s ")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One compiled tokenizer per Python worker and file."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, decoded: bool = True, digests: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids BINARY (little-endian unsigned 32-bit) and,
    with ``decoded``, the text that decoding the ids gives.

    ``digests`` replaces ids and text by their SHA-256 (ids_sha256, decoded_sha256), so that
    they needn't leave the worker. ``path`` must exist on every executor. A null text is
    empty; an empty text has no ids; rows are independent, so repeated ids or texts stay;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    ids_type = "ids_sha256 string" if digests else "ids binary"
    text_type = "decoded_sha256 string" if digests else "decoded string"
    schema = f"doc_id long, n_tokens long, {ids_type}" + (f", {text_type}" if decoded else "")

    kept = (lambda b: hashlib.sha256(b).hexdigest()) if digests else (lambda b: b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            counts, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                coded = own.encode(text)
                counts.append(len(coded) // 4)
                ids.append(kept(coded))
                if decoded:
                    emitted = kept(own.decode(coded).encode())
                    back.append(emitted if digests else emitted.decode())
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(ids, pa.string() if digests else pa.binary()),
            ] + ([pa.array(back, pa.string())] if decoded else [])
            names = [f.split(" ")[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(run, schema)
