"""Byte-level BPE by backtracking over longest matches.

An Aho-Corasick automaton finds all vocabulary tokens in a piece of text. The encoder takes the longest
match at each position, checks it against the token before it in a table of compatible pairs (two
tokens are compatible if no merge reaches across their border), and otherwise tries shorter prefixes or
takes a token back. Each position is given up at most once, so the time is linear, and the result is
exactly that of applying merges in order (Antonov and van Antwerpen, "So many tokens, so little time",
2024). Decoding copies bytes by a table of offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pulsegrid.llm.store import spread

#: The published pattern of byte-level BPE pre-tokenizers, with white space as Unicode defines it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Long texts are encoded in parts of about so many characters, cut where a token must end.
PART = 1 << 18
#: Pieces and pairs remembered by a worker.
MEMORY = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Encoder(dict):
    """Pieces of text (as the pattern splits it) to their token ids, worked out when first asked for."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        made = {a + b: (a, b) for a, b in reversed(merges)}
        ordered = [*self.letters, *dict.fromkeys(a + b for a, b in merges)]
        rank = {t: i for i, t in enumerate(ordered)}
        self.ids = [vocabulary[t] for t in ordered]
        self.sizes = [len(t) for t in ordered]
        self.halves = [(rank[made[t][0]], rank[made[t][1]]) if t in made else (i, i) for i, t in enumerate(ordered)]
        self.merged = {(a, b): i for i, (a, b) in enumerate(self.halves) if a != i}
        self.shorter: list[int] = []
        for t in ordered:
            self.shorter.append(next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1))
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(ordered):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(SPLIT)
        self.border = regex.compile(r"(?<=[\p{L}\p{N}]) (?=\p{L})")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        of_letter = {c: b for b, c in enumerate(self.letters)}
        pieces = {i: bytes(of_letter[c] for c in t) for t, i in vocabulary.items() if all(c in of_letter for c in t)}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        self.offsets = np.zeros(max(pieces) + 2, np.int64)
        np.cumsum([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(max(pieces) + 1)), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging in order would leave a border between two neighbouring tokens."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= MEMORY:
                self.compatible.clear()
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        limit = len(self.halves)  # a merge across the border only counts if it comes before this one
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in (0, 1) if left > right else (1, 0):  # undo the later of the two tokens' last merges
                if side == 0 and self.halves[left][1] != left:
                    limit, left = left, self.halves[left][1]
                    break
                if side == 1 and self.halves[right][0] != right:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        letters = self.letters
        text = "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        longest = [-1] * len(text)
        sizes = self.sizes
        for end, token in self.automaton.iter(text):
            start = end - sizes[token] + 1
            if longest[start] < 0 or sizes[longest[start]] < sizes[token]:
                longest[start] = token
        open_ = [True] * (len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0 and not (open_[at + sizes[token]] and (not out or self.fits(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                if at == len(text):
                    return tuple([self.ids[t] for t in out])
                token = longest[at]
            else:  # no token starts here: the one before must be shorter
                open_[at] = False
                token = out.pop()
                at -= sizes[token]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        found = self[piece] = self.encode_piece(piece)
        return found

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * PART:
            cut = self.border.search(text, at + PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        """Token ids; special tokens' strings in the text become their ids."""
        out = []
        for k, span in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append(np.array([self.special[span]], np.int32))
                continue
            for part in self.parts(span):
                out.append(np.array(list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(part)))), np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for lo in range(0, len(ids), PART):
            own = ids[lo : lo + PART]
            first, size = self.offsets[own], self.offsets[own + 1] - self.offsets[own]
            before = np.cumsum(size) - size
            parts.append(self.bytes[np.repeat(first - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids) of whole texts, one row per row; null and empty texts have no tokens.

    Texts may be as long as a row can be. Repeated rows give equal rows, rows without doc_id keep their null, other
    columns are not read whatever their names, and an empty table gives an empty one.
    ``vocabulary`` is the path of a byte-level BPE tokenizer file that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], ["doc_id", "token_ids"])

    return spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string"))).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, token_ids) with ``decoded``: the tokens' bytes as UTF-8, broken sequences replaced; null ids give a null.

    Repeated rows give equal rows, other columns are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [own.decode(values[a:b]).decode("utf-8", "replace") if known else None for a, b, known in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "token_ids", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, token_ids array<int>, decoded string")

