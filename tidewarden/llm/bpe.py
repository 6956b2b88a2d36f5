"""Byte-level BPE by a segment tree.

Leaf i of the tree holds the rank of the pair that starts at byte i, joined with i, so the root is
the leftmost pair of the smallest rank. A merge changes the leaves of three live neighbours, each
in a logarithmic number of steps, so a match of n bytes takes O(n log n) whatever it holds. Short
matches are merged many at a time: the same trees side by side, one merge in each per step.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tidewarden.llm.common import ship, small_batches

ship(__name__)

NONE = 1 << 62
SHIFT = 32  # positions are below 2**32
LOW = (1 << SHIFT) - 1
SHORT = 64  # bytes of a match that is merged side by side with others
BLOCK = 256  # texts whose ids are held at a time
CHARS = 500_000  # of texts, about, whose matches are held at a time
CACHED = 150_000  # short matches that a task remembers
# Latin letters and ASCII only: the classes of the pattern written out, for the faster engine.
LETTERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\t-\r \x85\xa0"
OTHER = r"[^\x00-\x1b\x20-\x7e\x85ªµºÀ-ÖØ-öø-ɏ]"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """A rank table with its pattern."""

    def __init__(self, lines: list[bytes], pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pieces = np.empty(max(self.ranks.values()) + 1, object)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plain, self.other = latin(pattern), re.compile(OTHER)
        self.seen: dict[str, bytes] = {}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one match."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts here
        get = ranks.get
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << SHIFT | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while tree[1] != NONE:
            left = tree[1] & LOW
            right = ends[left]
            ends[left] = middle = ends[right]
            if middle < n:
                before[middle] = left
            for i in (right, left, before[left]):  # the pair that is gone, and the two that changed
                value = NONE
                if i < 0:
                    continue
                if i != right and ends[i] < n:
                    rank = get(data[i : ends[ends[i]]])
                    if rank is not None:
                        value = rank << SHIFT | i
                i += width
                if tree[i] == value:
                    continue
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    if other < value:
                        value = other
                    i >>= 1
                    if tree[i] == value:
                        break
                    tree[i] = value
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return ids

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (left, right) at these positions; ids below 0 make no pair."""
        key = left << SHIFT | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.values[i] << SHIFT | at, NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of matches of at most SHORT bytes, as little-endian 32-bit integers."""
        count = len(words)
        size = np.array([len(w) for w in words])
        width = max(2, 1 << (int(size.max()) - 1).bit_length())
        live = np.arange(width) < size[:, None]
        ids = np.full((count, width + 1), -1, np.int64)
        ids[:, :-1][live] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.tile(np.arange(1, width + 1), (count, 1))
        before = ends - 2
        tree = np.full((count, 2 * width), NONE, np.int64)
        tree[:, width:] = self.leaf(ids[:, :-1], ids[:, 1:], np.arange(width))
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2

        def store(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            at = at + width
            tree[rows, at] = value
            for _ in range(width.bit_length() - 1):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            left, rank = tree[rows, 1] & LOW, tree[rows, 1] >> SHIFT
            right = ends[rows, left]
            stop = ends[rows, right]
            ids[rows, left], ends[rows, left], live[rows, right] = rank, stop, False
            inner = stop < width
            before[rows[inner], stop[inner]] = left[inner]
            store(rows, right, NONE)
            store(rows, left, self.leaf(rank, ids[rows, stop], left))
            some = before[rows, left] >= 0
            r, at = rows[some], before[rows, left][some]
            store(r, at, self.leaf(ids[r, at], rank[some], at))
            rows = rows[tree[rows, 1] != NONE]
        flat = ids[:, :-1][live].astype("<u4").tobytes()
        cut = np.concatenate([[0], 4 * np.cumsum(live.sum(1))]).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """Match -> packed ids, for matches not seen yet; short ones are merged side by side."""
        out, todo = {}, {}
        for match in matches:
            data = match.encode()
            if len(data) > SHORT or data in self.ranks:
                out[match] = np.array(self.merge(data), "<u4").tobytes()
            else:
                todo.setdefault((len(data) - 1).bit_length(), []).append((match, data))
        for group in todo.values():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                out.update(zip((m for m, _ in part), self.merge_many([d for _, d in part]), strict=True))
        return out

    def matches(self, text: str) -> list[str]:
        plain = self.plain is not None and not self.other.search(text)
        return (self.plain if plain else self.split).findall(text)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; new matches are learnt for some texts at a time."""
        at = 0
        while at < len(texts):
            part, chars = [], 0
            while at < len(texts) and (not part or chars + len(texts[at]) < CHARS):
                part.append(self.matches(texts[at]))
                chars += len(texts[at])
                at += 1
            every = set().union(*part)
            new = self.learn(every.difference(self.seen))
            if len(self.seen) + len(new) > CACHED:  # start anew with what this part needs
                self.seen = {m: self.seen[m] for m in every if m in self.seen}
            self.seen.update(new)
            for found in part:
                yield b"".join(map(self.seen.__getitem__, found))
            for match in new:
                if len(match) > SHORT:
                    del self.seen[match]

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.pieces[np.frombuffer(packed, "<u4")])


def latin(pattern: str) -> re.Pattern | None:
    """The pattern for texts without OTHER characters; None if it has classes beside those known."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]")
    out = out.replace(r"\p{N}", "[0-9]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    return None if r"\p" in out or r"\P" in out else re.compile(out)


def rank_lines(path: str) -> list[bytes]:
    """The lines of a rank file, read once on the driver and sent with the job (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read().splitlines()


def encode(documents: DataFrame, lines: list[bytes], pattern: str, ids: bool = False) -> DataFrame:
    """One row per document: token count and digests of the ids and of the decoded bytes.

    With `ids` the token ids themselves follow as a binary column of little-endian 32-bit integers.
    A null or empty text has no tokens. Repeated rows give repeated rows, an empty table none;
    columns besides doc_id and text are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lines)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = Bpe(sent.value, pattern)
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch[i : i + BLOCK]
                packed = list(bpe.encode_batch([text or "" for text in part["text"]]))
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array})
                out["n_tokens"] = [len(p) // 4 for p in packed]
                out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
                out["decoded_sha256"] = [hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]
                if ids:
                    out["ids"] = packed
                yield out

    return documents.select("doc_id", "text").mapInPandas(work, SCHEMA + ", ids binary" * ids)
