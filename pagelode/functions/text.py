"""Text rules of the index: tokens with offsets (T1), normalization (T2), stop words (P1), and the analysis chain."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

#: A default list of English function words; pass another list, or a file with one word a line, for other needs.
DEFAULT_STOP_WORDS = frozenset(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does
    doing down during each either else ever every few for from further had has have having he her here hers him himself his how i if in into is it its
    itself just me might more most must my myself neither no nor not now of off on once only or other our ours out over own s same shall she should so some
    such t than that the their theirs them themselves then there these they this those through to too under until up upon us very was we were what when
    where whether which while who whom whose why will with within without would yet you your yours yourself""".split()
)


def load_stop_words(source: str | Path | None = None) -> frozenset[str]:
    if source is None:
        return DEFAULT_STOP_WORDS
    return frozenset(line.strip().casefold() for line in Path(source).read_text("utf-8").splitlines() if line.strip())


def normalize(text: str) -> str:
    """Compatibility-decompose, keep letters and numbers only, recompose, lower-case."""
    if text.isascii():
        return re.sub("[^0-9A-Za-z]+", "", text).lower()
    kept = [c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] in "LN"]
    return unicodedata.normalize("NFKC", "".join(kept)).lower()


# The published Penn Treebank conventions, as spacing rules in their order.
_OPENING = [(r'^"', r"``"), (r"(``)", r" \1 "), (r"([ (\[{<])(\"|'{2})", r"\1 `` ")]
_MARKS = [
    (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", r" ... "), (r"[;@#$%&]", r" \g<0> "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 "), (r"[?!]", r" \g<0> "), (r"([^'])' ", r"\1 ' "), (r"[\]\[(){}<>]", r" \g<0> "), (r"--", r" -- "),
]
_CLOSING = [(r"''", r" '' "), (r'"', r" '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 ")]
_JOINED = [
    *((rf"(?i)\b({a})({b})\b", r" \1 \2 ") for a, b in (p.split() for p in ("can not", "d 'ye", "gim me", "gon na", "got ta", "lem me", "more 'n"))),
    (r"(?i)\b(wan)(na)\s", r" \1 \2 "), (r"(?i) ('t)(is)\b", r" \1 \2 "), (r"(?i) ('t)(was)\b", r" \1 \2 "),
]
# End of fixed values.
#: The rules before and after a blank is put around the text.
BEFORE, AFTER = _OPENING + _MARKS, _CLOSING + _JOINED
_BEFORE = [(re.compile(p), r) for p, r in BEFORE]
_AFTER = [(re.compile(p), r) for p, r in AFTER]


def tokens(text: str) -> Iterator[tuple[int, str]]:
    """(offset, token) in code points. Spacing only adds boundaries, so tokens are laid over the text in order."""
    spaced = text
    for pattern, put in _BEFORE:
        spaced = pattern.sub(put, spaced)
    spaced = f" {spaced} "
    for pattern, put in _AFTER:
        spaced = pattern.sub(put, spaced)
    at = 0
    for token in spaced.split():
        while at < len(text) and text[at].isspace():
            at += 1
        n = 1 if token in ("``", "''") and text[at : at + 1] == '"' else len(token)
        yield at, text[at : at + n]
        at += n


@lru_cache(1 << 17)
def analyze_word(word: str, stop: frozenset[str] = DEFAULT_STOP_WORDS) -> str:
    """Normalized, stop-filtered, stemmed form of a word; empty if it is not indexed."""
    from .stem import stem

    plain = normalize(word)
    return "" if plain in stop else stem(plain)


def analyze(text: str, stop: frozenset[str] = DEFAULT_STOP_WORDS) -> list[tuple[int, str]]:
    """(offset, stem) of the indexed words of a text."""
    return [(at, s) for at, token in tokens(text) if (s := analyze_word(token, stop))]
