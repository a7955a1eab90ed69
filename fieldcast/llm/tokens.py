"""Exact byte-level BPE ids with a cache of short pieces.

A single space between two characters that are no white space always starts a pre-token, whatever surrounds it: no
pre-token holds a space after its first character unless it is all white space. Texts are cut there, every piece is
encoded by itself and short pieces are remembered. The ids equal those of the tokenizers library for the same file.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# --- fixed values: the public byte-level pre-token pattern ---
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values ---

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
CACHE_PIECES = 300_000
CACHE_CHARS = 24
DIRECT_CHARS = 160
LONG_CHARS = 2_000


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, so that pieces are joined and check-summed without conversion."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_of_char()
        vocabulary = {bytes(alphabet[c] for c in token): at for token, at in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {token: at for token, at in vocabulary.items() if at not in special.values()}
        self.hf = Tokenizer.from_file(path)
        self.hf.no_truncation()
        self.hf.no_padding()
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.token_bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, at in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.token_bytes[at] = token
        self.token_lengths = np.array([len(t) for t in self.token_bytes])
        self.mark, self.mark_id = next(iter(special.items()), ("", -1))
        self.marks = set(special)
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        if len(text) > LONG_CHARS:  # one very long run: the library's merge loop stays fast there
            return np.array(self.hf.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special=self.marks).tobytes()

    def _fill(self, pieces: list[str], ids: list[bytes | None]) -> None:
        """Encodes what the cache did not hold. Short pieces go through the library together, parted by the special
        token, which separates pre-tokens as the end of a text does."""
        missed = [i for i, x in enumerate(ids) if x is None]
        short = [i for i in missed if len(pieces[i]) <= CACHE_CHARS and self.mark not in pieces[i]]
        if self.mark and len(short) > 1:
            joined = self.mark.join([" " + pieces[i] for i in short])
            got = self.fast.encode_to_numpy(joined, allowed_special=self.marks)
            ends = [*(4 * np.flatnonzero(got == self.mark_id)).tolist(), 4 * len(got)]
            raw, at, room = got.tobytes(), 0, len(self.cache) < CACHE_PIECES
            for i, end in zip(short, ends, strict=True):
                ids[i] = raw[at:end]
                at = end + 4
                if room:
                    self.cache[pieces[i]] = ids[i]
        for i in missed:
            if ids[i] is None:
                ids[i] = self.piece(" " + pieces[i])

    def encode(self, text: str) -> bytes:
        if len(text) < DIRECT_CHARS:
            return self.piece(text) if text else b""
        head, *rest = text.split(" ")
        get = self.cache.get
        if rest:
            last = rest.pop()
            ids = [get(p) for p in rest]
            fresh = [head[-1:], last[:1]]
            for p, x in zip(rest, ids, strict=True):
                if x is None:
                    fresh += (p[:1], p[-1:])
            # the ends of a text may hold white space; on either side of a cut there must be none (the cache has no such)
            if "" not in fresh and not any(map(str.isspace, fresh)):
                if None in ids:
                    self._fill(rest, ids)
                return b"".join([self.piece(head), *ids, self.piece(" " + last)])
        head, *rest = SAFE_SPACE.split(text)
        if not rest:
            return self.piece(head)
        last = rest.pop()
        ids = [get(p) for p in rest]
        self._fill(rest, ids)
        return b"".join([self.piece(head), *ids, self.piece(" " + last)])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        joined = b"".join([self.token_bytes[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return joined.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)
