"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

A text is cut at added tokens, then by the pre-tokeniser's pattern. A piece is
encoded from left to right: an Aho-Corasick automaton gives the longest token at
each byte; a token may follow another only if merging could not have joined them
across their border, which the table of merges decides; where no token fits, the
last one is taken back and a shorter one tried. Every byte position is given up
at most once, so the work is linear. Pieces recur, so a worker remembers a
bounded number of them.

Defined cases: null text is encoded as empty (no ids, no text); repeated rows
are encoded each; further columns of the input are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.tables import map_batches

#: Fixed value: the pre-tokeniser's pattern, with letters and numbers to be filled in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
REMEMBER = 300_000
PIECE_LIMIT = 200


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable in Latin-1, else the next free character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.added}
        raw |= {i: t.encode() for t, i in self.added.items()}
        n = max(raw) + 1
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(n)), np.uint8)
        self.digits = [str(i) for i in range(n)]
        self.offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(raw.get(i, b"")) for i in range(n)], out=self.offsets[1:])
        # ids by age: single bytes, then merges in their order
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        for rank, (a, b) in enumerate(merges):
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault((a, b), rank)
            if ab not in self.halves:
                self.halves[ab] = a, b
                self.rank[ab] = rank
        self.automaton = ahocorasick.Automaton()
        self.id_of = {}
        for i, b in raw.items():
            if i not in self.added.values() and (len(b) == 1 or i in self.halves):
                self.id_of[b] = i
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        for i in self.id_of.values():
            self._reachable(i)
        self.sound = all(self.reachable.values())
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # characters assigned after the vocabulary's own Unicode tables count as neither letter nor number
        unassigned = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
        newer = regex.findall(r"[\p{L}\p{N}]", unassigned)
        plain = PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}")
        self.pattern = self.careful = regex.compile(plain)
        self.newer = None
        if newer:
            code = np.array([ord(c) for c in newer])
            runs = np.split(code, np.flatnonzero(np.diff(code) > 1) + 1)
            some = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
            self.newer, self.newer_lead = regex.compile(f"[{some}]"), newer[0].encode()[0]
            self.careful = regex.compile(
                r"(?V1)" + PATTERN.replace("{L}", rf"[\p{{L}}--[{some}]]").replace("{N}", rf"[\p{{N}}--[{some}]]")
                .replace(r"[^\s{l}{n}]", rf"[^[[\s\p{{L}}\p{{N}}]--[{some}]]]")
            )

    def fits(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > REMEMBER:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo the younger of the two border tokens step by step.

        At each step the pair at the border must not be a merge that would have
        happened before the last one undone, on its side of the border: merges of
        equal age go from left to right.
        """
        rank, halves, merge = self.rank, self.halves, self.pair_rank
        before = (1 << 60, 1)
        while True:
            at = merge.get((left, right))
            if at is not None and (at, 0) < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # the border merge stands to the right of the left token's last merge
            # and to the left of the right token's first one
            if a > b:
                before = (a, 0)
                left = halves[left][1]
            else:
                before = (b, 1)
                right = halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Longest matches throughout if all of them may stand side by side, else with backtracking."""
        if self.sound:
            tokens = [token for _, (token, _) in self.automaton.iter_long(piece.decode("latin-1"))]
            known, last = self.compatible, -1
            for token in tokens:
                if last >= 0:
                    ok = known.get(last << 32 | token)
                    if ok is None:
                        ok = self.fits(last, token)
                    if not ok:
                        break
                last = token
            else:
                return tokens
        return self._backtrack(piece)

    def _backtrack(self, piece: bytes) -> list[int]:
        n, id_of, known = len(piece), self.id_of, self.compatible
        longest = [1] * n
        for end, (_, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = length  # longer ones come later
        dead = bytearray(n + 1)
        tokens: list[int] = []
        starts: list[int] = []
        at, last = 0, -1
        while at < n:
            length = longest[at]
            while length:
                token = id_of.get(piece[at : at + length], -1)
                if token >= 0 and not dead[at + length] and self.reachable[token]:
                    if last < 0:
                        break
                    ok = known.get(last << 32 | token)
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                length -= 1
            if length:
                longest[at] = length
                tokens.append(token)
                starts.append(at)
                at += length
                last = token
            else:
                # every way on from here failed: come back by a shorter token
                dead[at] = 1
                at = starts.pop()
                tokens.pop()
                longest[at] -= 1
                last = tokens[-1] if tokens else -1
        return tokens

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in the token."""
        if token not in self.reachable:
            half = self.halves.get(token)
            self.reachable[token] = half is None or (self._reachable(half[0]) and self._reachable(half[1]) and self._joined(token, *half))
        return self.reachable[token]

    def _joined(self, token: int, left: int, right: int) -> bool:
        """The two halves stand side by side until the token's own merge joins them."""
        hidden = self.pair_rank.pop((left, right))
        try:
            return hidden == self.rank[token] and self._fits(left, right)
        finally:
            self.pair_rank[(left, right)] = hidden

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._plain(text[at : m.start()], ids)
            ids.append(self.added[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _has_newer(self, text: str) -> bool:
        if self.newer is None or text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < self.newer_lead:
            return False
        return self.newer.search(text) is not None

    def _plain(self, text: str, ids: list[int]) -> None:
        known, extend = self.pieces, ids.extend
        pattern = self.careful if self._has_newer(text) else self.pattern
        for piece in pattern.findall(text):
            got = known.get(piece)
            if got is None:
                got = self.older.get(piece) or tuple(self.encode_piece(piece.encode()))
                if len(piece) <= PIECE_LIMIT:
                    if len(known) >= REMEMBER:
                        self.older = known
                        known = self.pieces = {}
                    known[piece] = got
            extend(got)

    def decode_bytes(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        """Bytes of ids, gathered from one blob by the offset table, a block of ids at a time."""
        out = []
        for i in range(0, len(ids), block):
            part = ids[i : i + block]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            begin = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - begin, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str, _kept: dict = {}) -> Codec:  # noqa: B006
    """One codec per worker and file."""
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of the whole text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                yield {"doc_id": [doc], "ids": [np.array(c.encode(text.as_py() or ""), np.int32)]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` (null counts as no ids)."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                yield {"doc_id": [doc], "text": [c.decode(np.array(x.as_py() or [], np.int64))]}

    return map_batches(ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, in one pass."""

    def run(batches):
        c = codec(path)
        sha, digits = hashlib.sha256, c.digits.__getitem__
        for b in batches:
            n, of_ids, of_text = [], [], []
            for text in b.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(",".join(map(digits, ids)).encode()).hexdigest())
                of_text.append(sha(c.decode(np.array(ids, np.int64)).encode()).hexdigest())
            yield {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
