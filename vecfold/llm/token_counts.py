"""Token counts of a byte-level BPE vocabulary with a short cut for whole tokens.

Offline, once per vocabulary: a vocabulary string is *whole* when the pattern leaves it in one piece
and its merges end in that one token. Counting then splits a text with the pattern; pieces that are
whole count 1 without merging, each other distinct piece of a batch is merged once and remembered.
Special strings inside a text are one token each, as the library's default has it.

A null or empty text has no tokens. Whole texts are counted, in slices of bounded size.
"""

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecfold.llm import batches

# Fixed value: the pattern that byte-level BPE splits texts with before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    letters.update((b, chr(256 + i)) for i, b in enumerate(rest))
    return [letters[b] for b in range(256)]


class Merger:
    """Merges of one piece: always the adjacent pair of least rank, the leftmost first."""

    def __init__(self, description: str):
        model = json.loads(description)
        kinds = model["model"].get("type", "BPE"), (model.get("pre_tokenizer") or {}).get("type")
        if kinds != ("BPE", "ByteLevel") or model.get("normalizer") or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a byte-level BPE vocabulary without normalizer and prefix space")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.vocabulary = model["model"]["vocab"]
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model.get("added_tokens", [])):
            raise ValueError("special tokens that take in blanks are not supported")
        self.letters = byte_letters()

    def count(self, piece: str) -> int:
        parts = [self.letters[b] for b in piece.encode()]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, 1 << 60))
            if best not in ranks:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == best[0] and parts[i + 1] == best[1]:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return len(parts)


def whole_tokens(description: str) -> set[str]:
    """Vocabulary strings that are proven to encode alone as one token."""
    merger, pattern = Merger(description), regex.compile(PATTERN)
    byte_of = {letter: b for b, letter in enumerate(merger.letters)}
    found = set()
    for token in merger.vocabulary:
        if token in merger.special:
            continue
        try:
            piece = bytes(byte_of[letter] for letter in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        match = pattern.fullmatch(piece)
        if match and pattern.match(piece).end() == len(piece) and merger.count(piece) == 1:
            found.add(piece)
    return found


class Counts:
    """Counts texts; remembers merged pieces up to a bounded number."""

    def __init__(self, description: str, whole: set[str]):
        self.merger, self.whole, self.seen = Merger(description), whole, {}
        self.find = regex.compile(PATTERN).findall
        special = self.merger.special
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def of_piece(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = 1 if piece in self.whole else self.merger.count(piece)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[piece] = n
        return n

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special is not None and any(s in text for s in self.merger.special):
            total = len(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            seen, of_piece = self.seen, self.of_piece
            for piece, times in Counter(self.find(part)).items():
                total += times * (seen.get(piece) or of_piece(piece))
        return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; ``vocabulary`` is the path of a tokenizer file.

    The driver reads the file (a few MB, the same for any number of texts) and sends it to the tasks.
    """
    with open(vocabulary, encoding="utf-8") as file:
        description = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((description, whole_tokens(description)))

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        for batch in batch_iter:
            text = batch.column("text")
            for first, end, _, offsets in batches.text_slices(text):
                part = text.slice(first, end - first).to_pylist()
                tokens = np.fromiter((counts.of_text(t) for t in part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
