"""Exact, fast tokenization with public BPE tokenizer files.

The tokenizers library gives the reference answer. Its per-call cost is high, so texts made of common characters take
a fast way to the same ids: pre-tokens are found by the file's own pattern and merged by the byte-pair core of
tiktoken, whose ranks are read from the file. That core merges the adjacent pair of lowest rank, which is the file's
merge order when token ids rise in merge order; this is checked on loading. A vocabulary with an end-of-word suffix
works alike: the suffix becomes a marker byte after each pre-token, and a last byte joins its marker first.

Characters whose classes, case or normal form could differ between Unicode versions, and texts that hold a special
token, go to the library. Tests compare both ways.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np

#: Characters of the fast way: ASCII without odd controls, Latin letters and signs to U+017F (their lower case stays there), common punctuation.
_FAST = re.compile("[\t\n\r -~¡-įı-ſ‐-‧‰-⁞€™]*")
_FAST_RANGES = ((0x20, 0x7F), (0xA1, 0x180), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD), (0x2122, 0x2123))
_MARK = "\x01"


def tokenizer_path(name: str) -> str:
    """A file's path, or the place of a public tokenizer of that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[str, int]:
    """The printable names that byte-level vocabularies give to bytes: printable ones stand for themselves, others follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _class(kind: str) -> str:
    """Members of a general category among the fast characters, as a character class body."""
    return "".join(re.escape(chr(c)) for a, b in _FAST_RANGES for c in range(a, b) if unicodedata.category(chr(c))[0] == kind)


class Bpe:
    """One tokenizer file: ``encode`` gives ids, ``pack`` little-endian bytes, ``decode`` the library's decoded text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        place = tokenizer_path(path)
        self.lib = Tokenizer.from_file(place)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(place, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.names = {i: t for t, i in self.lib.get_vocab(with_added_tokens=True).items()}
        self.plain_decode = told["decoder"] is None
        self.core = self._core(told)

    def _core(self, told: dict):
        """tiktoken's core over the file's merges, or None where the file is of another shape."""
        import tiktoken

        model, suffix = told["model"], told["model"]["end_of_word_suffix"] or ""
        vocab, names = model["vocab"], _byte_names()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # the result of a merge drops the suffix of a left part, which never has one
        ids = [vocab.get(m) for m in merged]
        first = 512 if suffix else 256
        kind = told["pre_tokenizer"]["type"]
        known = (kind == "ByteLevel" and told["normalizer"] is None and not suffix) or (kind == "Sequence" and suffix == "</w>")
        if not known or ids != list(range(first, first + len(ids))) or model.get("dropout") or model.get("ignore_merges"):
            return None

        def raw(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if end else token
            return bytes(names[c] for c in body) + (_MARK.encode() if end else b"")

        special = set(self.special)
        ranks = {raw(t): i for t, i in vocab.items() if t not in special}
        if suffix:
            letters, digits = _class("L"), _class("N")
            pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            if pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return None
            self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ \\t\\n\\r{letters}{digits}]+")
            return tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})
        self.words = None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> list[int]:
        """The library's own answer."""
        return self.lib.encode(text, add_special_tokens=False).ids

    def common(self, text: str) -> bool:
        """Whether a text may take the fast way."""
        return self.core is not None and _FAST.fullmatch(text) is not None and not any(s in text for s in self.special)

    def fast(self, text: str) -> list[int]:
        """Ids of a common text."""
        if self.words is None:
            return self.core.encode_ordinary(text)
        found = self.words.findall(text.lower())
        return self.core.encode_ordinary(_MARK.join(found) + _MARK) if found else []

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.fast(text) if self.common(text) else self.whole(text)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: without a decoder in the file, token names and single spaces."""
        if self.plain_decode:
            return " ".join([self.names[i] for i in ids])
        return self.lib.decode(ids, skip_special_tokens=False)


@cache
def bpe(path: str) -> Bpe:
    """One of each for a worker process."""
    return Bpe(path)
