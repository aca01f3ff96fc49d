"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text, the encoding of that prefix ends in exactly one token. The
table of these last tokens is filled from left to right: a candidate token ending at the prefix's
end is the right one if it may stand after the last token of the prefix before it. Whether two
tokens may stand side by side is decided by undoing their merges. The table is enough to append
text (only new entries are filled) and to re-encode after an edit (entries before it stay).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex

#: Pieces of text whose encoding a worker keeps; when full, the store starts anew.
CACHE_PIECES = 1_200_000
#: Pairs of tokens whose fitness a worker keeps.
CACHE_PAIRS = 1_000_000
#: Pieces of more bytes than this are encoded but not kept.
CACHE_BYTES = 64
#: Marks that end many words.
ENDS = ".,;:!?|"


class Encoder:
    """Encoder and decoder for one vocabulary of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = CACHE_PIECES):
        self.pieces = pieces
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.single = [ranks[bytes([b])] for b in range(256)]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            parts = self._merged(token)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.merge[parts[0], parts[1]] = rank
        #: Tokens that merging can reach, by their bytes.
        self.reached = {self.bytes[i]: i for i in self.halves}
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, str] = {}
        self.spelled = {str(i): b for i, b in self.bytes.items()}

    def _merged(self, token: bytes) -> list[int]:
        """Parts of a token before its own merge, by the merges known so far."""
        parts = [self.single[b] for b in token]
        while len(parts) > 2:
            best = min((r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.merge.get(p)) is not None) if any(p in self.merge for p in zip(parts, parts[1:])) else None
            if best is None:
                break
            rank, i = best
            parts[i : i + 2] = [rank]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens."""
        key = left << 24 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, a, b, good = 1 << 60, left, right, True
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and joined < limit:
                good = False
                break
            # undo the later of the two merges; at a single byte, undo the other
            if a > b:
                limit = a
                a = self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        break
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[key] = good
        return good

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill the table of last tokens up to the end of data; last[i] ends the prefix of i + 1 bytes.

        At most one candidate fits, so the order of trying them is free; the shortest is tried first.
        """
        reached, fits, fit, longest = self.reached.get, self.fits.get, self.fit, self.longest
        add = last.append
        for end in range(len(last) + 1, len(data) + 1):
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                token = reached(data[begin:end])
                if token is not None:
                    if not begin:
                        add(token)
                        break
                    good = fits(last[begin - 1] << 24 | token)
                    if good or good is None and fit(last[begin - 1], token):
                        add(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens, read back from the table."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def edit(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """Data and table after an edit; the entries before it are used again."""
        new = data[:at] + added + data[at + removed :]
        return new, self.extend(new, last[:at])

    def piece(self, data: bytes) -> list[int]:
        """Encode one match of the pattern; one that is itself in the vocabulary is one token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, []))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.piece(m.group().encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _entry(self, chunk: str) -> str:
        if len(chunk) > 2 and chunk[-1] in ENDS and chunk[-2].isalnum():
            # a match of letters or digits ends here; the mark is a match of its own
            ids = f"{self.kept.get(chunk[:-1]) or self._entry(chunk[:-1])},{self.kept.get(chunk[-1]) or self._entry(chunk[-1])}"
        elif chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():
            ids = ",".join(map(str, self.piece(chunk.encode())))
        else:
            ids = ",".join(map(str, self.encode(chunk)))
        if len(chunk) <= CACHE_BYTES:
            if len(self.kept) >= self.pieces:
                self.kept.clear()
            self.kept[chunk] = ids
        return ids

    def decimal(self, text: str) -> str:
        """The decimal ids of a text joined by commas.

        No match spans a single space between two other characters that are not white space, so
        the text is cut before each such space and equal stretches are encoded once.
        """
        kept, entry, out = self.kept.get, self._entry, []
        words = text.split(" ")
        chunk = words[0]
        for word in words[1:]:
            if word and chunk and not word[0].isspace() and not chunk[-1].isspace():
                out.append(kept(chunk) or entry(chunk))
                chunk = " " + word
            else:
                chunk = f"{chunk} {word}"
        if chunk:
            out.append(kept(chunk) or entry(chunk))
        return ",".join(out)

    def spell(self, ids: str) -> bytes:
        """The bytes of decimal ids joined by commas."""
        return b"".join(map(self.spelled.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def load(path: str, pattern: str, pieces: int = CACHE_PIECES) -> Encoder:
    """The encoder for a file of base64 tokens and ranks; kept for the worker's life."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern, pieces)


def digest_batches(path: str, pattern: str, pieces: int = CACHE_PIECES):
    """For mapInArrow: batches of (key, text) to (key, n_tokens, ids_sha256, decoded_sha256, decoded_same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern, pieces)
        for batch in batches:
            n, ids, decoded, same = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = encoder.decimal(text)
                back = encoder.spell(found)
                n.append(found.count(",") + 1 if found else 0)
                ids.append(hashlib.sha256(found.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                same.append(back == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def token_batches(path: str, pattern: str):
    """For mapInArrow: batches of (key, text) to (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            ids = [[int(i) for i in encoder.decimal(t.as_py() or "").split(",") if i] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return run


def encode_digests(docs, key: str, text: str, path: str, pattern: str, pieces: int = CACHE_PIECES):
    """Encode every whole text and decode it again; one row per row of docs.

    Columns: key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256,
    round_trip (whether the decoded bytes are the text's). A null text is encoded as empty; null
    keys and repeated rows are kept as they are; an empty table gives no rows; only the two named
    columns are read. A worker keeps the encodings of at most ``pieces`` stretches of text.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(digest_batches(path, pattern, pieces), f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("key", key)


def encode(docs, key: str, text: str, path: str, pattern: str):
    """The ids of every whole text: columns key, ids. Nulls and repeats as in encode_digests."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(token_batches(path, pattern), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens, key: str, ids: str, path: str, pattern: str):
    """The text of every row of ids: columns key, text (null ids give null; bytes that are no UTF-8 are replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            out = [None if (v := row.as_py()) is None else encoder.decode(v).decode("utf-8", "replace") for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
