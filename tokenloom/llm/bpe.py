"""Byte-level BPE by prefix dynamic programming, for rank files, and its inverse.

For every prefix of a byte string there is exactly one token that ends the prefix's encoding.  So the
encoding of a string is a table with that last token for each prefix, filled from left to right: a token
that ends at i is the one sought if it may follow the last token of the prefix before it.  Bytes appended
later only add entries, and after an edit only entries up to where the tables agree again change."""
from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import kept, release, texts_of

#: Matches that a worker remembers (those of late, and as many from before), and pairs of tokens.
MATCHES, PAIRS = 350_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.edges: dict[tuple[int, bool], list[int]] = {}
        self.may: dict[int, bool] = {}

    def half(self, token: int) -> tuple[int, int]:
        """The two tokens of which the merges make this one."""
        if token not in self.halves:
            text = self.bytes_of[token]
            for cut in range(1, len(text)):
                a, b = self.ranks.get(text[:cut]), self.ranks.get(text[cut:])
                if a is not None and b is not None and max(self.made(a), self.made(b)) < token and self.follows(a, b, token):
                    self.halves[token] = (a, b)
                    break
            else:
                raise ValueError(f"token {token} can't be reached by merges")
        return self.halves[token]

    def made(self, token: int) -> int:
        """When a token comes into being: single bytes before all merges, others at their rank."""
        return -1 if len(self.bytes_of[token]) == 1 else token

    def edge(self, token: int, right: bool) -> list[int]:
        """What stands at a token's right (or left) end while it is being merged: from one byte to the token."""
        if (token, right) not in self.edges:
            inner = [] if len(self.bytes_of[token]) == 1 else self.edge(self.half(token)[right], right)
            self.edges[token, right] = [*inner, token]
        return self.edges[token, right]

    def follows(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether a then b stay two tokens: no merge across their border comes before those inside them.
        Merges of rank until and later don't count.  Of equal merges the left one comes first."""
        left, right = self.edge(a, True), self.edge(b, False)
        i = j = 0
        while True:
            over = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]])
            next_left = left[i + 1] if i + 1 < len(left) else None
            next_right = right[j + 1] if j + 1 < len(right) else None
            if over is not None and (until is None or over < until) and (next_left is None or over < next_left) and (next_right is None or over <= next_right):
                return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or (next_left is not None and next_left <= next_right):
                i += 1
            else:
                j += 1

    def can_follow(self, a: int, b: int) -> bool:
        found = self.may.get(a << 32 | b)
        if found is None:
            if len(self.may) >= PAIRS:
                self.may.clear()
            found = self.may[a << 32 | b] = self.follows(a, b)
        return found

    def last_token(self, text: bytes, end: int, last: list[int]) -> int:
        """The last token of text[:end], given those of all shorter prefixes (last[i]: of text[:i])."""
        ranks, bytes_of, can_follow = self.ranks, self.bytes_of, self.can_follow
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(text[start:end])
            if token is not None and (start == 0 or can_follow(last[start], token)):
                return token
        raise ValueError(f"no token ends with byte {text[end - 1]}; known: {len(bytes_of)}")


class PrefixTable:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, bpe: Bpe, text: bytes = b""):
        self.bpe, self.text, self.last = bpe, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """last_token() for each new prefix, with everything at hand."""
        first = len(self.text) + 1
        text = self.text = self.text + more
        last, rank, longest, may, follows = self.last, self.bpe.ranks.get, self.bpe.longest, self.bpe.may, self.bpe.can_follow
        for end in range(first, len(text) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank(text[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start]
                    ok = may.get(before << 32 | token)
                    if ok or ok is None and follows(before, token):
                        break
            else:
                raise ValueError(f"no token ends with byte {text[end - 1]}")
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of text[start:end]; returns how many entries had to be found anew.

        Behind the edit the old entries hold again once as many in a row as the longest token has bytes
        are found to be the old ones: what follows depends on no more."""
        old, old_last = self.text, self.last
        self.text = old[:start] + new + old[end:]
        self.last = old_last[: start + 1]
        shift, same, found = len(new) - (end - start), 0, 0
        for i in range(start + 1, len(self.text) + 1):
            if same >= self.bpe.longest:
                self.last += old_last[i - shift :]
                break
            token = self.bpe.last_token(self.text, i, self.last)
            found += 1
            same = same + 1 if i > start + len(new) and old_last[i - shift] == token else 0
            self.last.append(token)
        return found

    def ids(self) -> list[int]:
        out, i = [], len(self.text)
        while i:
            out.append(self.last[i])
            i -= len(self.bpe.bytes_of[self.last[i]])
        return out[::-1]


class Codec:
    """Whole texts to ids and back: each match of the pattern is encoded separately."""

    def __init__(self, ranks_path: str, pattern: str):
        import numpy as np
        import regex

        self.np, self.find = np, regex.compile(pattern).findall
        self.bpe = Bpe(read_ranks(ranks_path))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def match_ids(self, match: str) -> bytes:
        """The ids of one match of the pattern."""
        text = match.encode()
        whole = self.bpe.ranks.get(text)
        ids = [whole] if whole is not None else PrefixTable(self.bpe, text).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a match is encoded once while it is remembered."""
        matches, known = self.find(text), self.known
        found = list(map(known.get, matches))
        if None in found:
            if len(known) >= MATCHES:
                self.before, known = known, {}
                self.known = known
            before = self.before
            for i, ids in enumerate(found):
                if ids is None:
                    match = matches[i]
                    ids = known.get(match) or before.get(match) or self.match_ids(match)
                    if len(match) <= 200:
                        known[match] = ids
                    found[i] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, self.np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}
kept.append(_codecs)


def codec(ranks_path: str, pattern: str) -> Codec:
    release(_codecs)
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) per document, without a shuffle.

    A null or empty text has no ids.  Repeated rows are encoded each; an empty table gives no rows; other
    columns are not looked at.  Workers load the ranks from ranks_path."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((made.encode(t) for t in texts_of(batch.column(1))), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) with the decoded bytes as text_bytes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((made.decode(x.as_py()) for x in batch.column(1)), pa.binary())], ["doc_id", "ids", "text_bytes"])

    return map_arrow(encoded, run, f"doc_id {encoded.schema[0].dataType.simpleString()}, ids binary, text_bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), then decode() of the ids, in one worker and a few rows at a time."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [made.encode(t) for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(made.decode, ids), pa.binary())], ["doc_id", "ids", "text_bytes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids binary, text_bytes binary")


def round_trip_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    made = round_trip(docs, ranks_path, pattern)
    return made.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256"))
