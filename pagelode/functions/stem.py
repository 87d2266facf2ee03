"""The variant Porter stemmer (T4-T7), over the vowel shape of a word, and the same rules as SQL.

The *shape* writes each letter as 1 (vowel) or 0 (consonant); y after a, e, i, o, u is a consonant, also at the start.
The shape of a beginning is the beginning of the shape, so every condition is a test on a slice of one string.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .text import normalize

# Prefixes, and suffix rules (ending, what replaces it) in the order in which they are tried.
PREFIXES = ("kilo", "micro", "milli", "intra", "ultra", "mega", "nano", "pico", "pseudo")
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("isation", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("alise", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""),
    ("sion", ""), ("tion", ""), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("ise", ""),
)
# End of fixed values.


def shape(word: str) -> str:
    marked = re.sub("(?<=[aeiou])y", "Y", "a" + word)[1:]
    return re.sub("[aeiouy]", "1", re.sub("[^aeiouy]", "0", marked))


def _syllables(s: str) -> int:
    return s.count("10")


def _short_end(word: str, s: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end; a leading y of three letters counts as a vowel."""
    return s.endswith("010") and word[-1] not in "wxy" and not (len(word) == 3 and word[0] == "y")


def _plural(w: str) -> str:
    if not w.endswith("s") or w.endswith("ss") and not w.endswith("sses"):
        return w
    return w[:-2] if w.endswith(("sses", "ies")) and w not in ("sses", "ies") else w if w.endswith("ss") else w[:-1]


def _participle(w: str) -> tuple[str, bool]:
    """The word without -eed, -ed or -ing, and whether stemming of the step ends here."""
    s = shape(w)
    if w.endswith("eed") and len(w) > 3:
        return (w[:-1] if _syllables(s[:-3]) else w), False
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or "1" not in s[:-cut]:
        return w, False
    w, s = w[:-cut], s[:-cut]
    if len(w) < 2:
        return w, True
    if w[-2:] in ("at", "bl", "iz") and len(w) > 2:
        return w + "e", False
    if w[-1] == w[-2] and w[-1] not in "lsz":
        return w[:-1], False
    return (w + "e" if _syllables(s) == 1 and _short_end(w, s) else w), False


def _suffix(w: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    s = shape(w)
    for find, put in rules:
        if w.endswith(find) and _syllables(s[: len(w) - len(find)]) >= least:
            return w[: len(w) - len(find)] + put
    return w


def _final(w: str) -> str:
    m, s = _syllables(shape(w)), shape(w)
    if w.endswith("e") and (m > 1 or m == 1 and not _short_end(w[:-1], s[:-1])):
        w = w[:-1]
    return w[:-1] if len(w) > 1 and w.endswith("ll") and _syllables(shape(w)) > 1 else w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    w = normalize(word)
    if len(w) < 3:
        return w
    w = next((w[len(p) :] for p in PREFIXES if w.startswith(p)), w)
    w = _plural(w)
    w, done = _participle(w) if w else (w, True)
    if not done and w.endswith("y") and "1" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((STEP2, 1), (STEP3, 1), (STEP4, 2)):
        w = _suffix(w, rules, least) if w else w
    return _final(w) if w else w


def stem_sql(source: str, column: str) -> str:
    """DuckDB SQL: (word, stem) for a relation of normalized words, one CTE per step."""
    sh = lambda x: f"regexp_replace(regexp_replace(substr(regexp_replace('a' || {x}, '([aeiou])y', '\\1Y', 'g'), 2), '[^aeiouy]', '0', 'g'), '[aeiouy]', '1', 'g')"
    m = lambda s: f"len(regexp_extract_all({s}, '10'))"
    cvc = lambda w, s: f"(ends_with({s}, '010') AND right({w}, 1) NOT IN ('w','x','y') AND NOT (length({w}) = 3 AND left({w}, 1) = 'y'))"

    def rules(table, least):
        cases = " ".join(f"WHEN ends_with(w, '{f}') AND {m(f'left(s, length(w) - {len(f)})')} >= {least} THEN left(w, length(w) - {len(f)}) || '{p}'" for f, p in table)
        return f"CASE {cases} ELSE w END"

    prefix = " ".join(f"WHEN starts_with(word, '{p}') THEN substr(word, {len(p) + 1})" for p in PREFIXES)
    return f"""
WITH v AS (SELECT DISTINCT {column} AS word FROM {source}),
p AS (SELECT word, CASE WHEN length(word) < 3 THEN word {prefix} ELSE word END AS w FROM v),
a AS (SELECT word, CASE WHEN length(word) < 3 OR right(w, 1) <> 's' OR w = '' THEN w WHEN (ends_with(w, 'sses') OR ends_with(w, 'ies')) AND w NOT IN ('sses', 'ies') THEN left(w, length(w) - 2)
      WHEN ends_with(w, 'ss') THEN w ELSE left(w, length(w) - 1) END AS w FROM p),
b0 AS (SELECT word, w, {sh('w')} AS s FROM a),
b1 AS (SELECT word, w, s, CASE WHEN length(word) < 3 OR ends_with(w, 'eed') AND length(w) > 3 THEN 0 WHEN ends_with(w, 'ed') AND left(s, length(w) - 2) LIKE '%1%' THEN 2
      WHEN ends_with(w, 'ing') AND left(s, length(w) - 3) LIKE '%1%' THEN 3 ELSE 0 END AS cut FROM b0),
b2 AS (SELECT word, w, s, cut, left(w, length(w) - cut) AS u, left(s, length(w) - cut) AS t FROM b1),
b AS (SELECT word, cut > 0 AND length(u) < 2 AS done, CASE WHEN length(word) < 3 THEN w WHEN ends_with(w, 'eed') AND length(w) > 3 THEN CASE WHEN {m('left(s, length(w) - 3)')} > 0 THEN left(w, length(w) - 1) ELSE w END
      WHEN cut = 0 THEN w WHEN length(u) < 2 THEN u WHEN right(u, 2) IN ('at', 'bl', 'iz') AND length(u) > 2 THEN u || 'e'
      WHEN right(u, 1) = left(right(u, 2), 1) AND right(u, 1) NOT IN ('l', 's', 'z') THEN left(u, length(u) - 1)
      WHEN {m('t')} = 1 AND {cvc('u', 't')} THEN u || 'e' ELSE u END AS w FROM b2),
c AS (SELECT word, CASE WHEN length(word) > 2 AND NOT done AND ends_with(w, 'y') AND {sh("left(w, length(w) - 1)")} LIKE '%1%' THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM b),
d0 AS (SELECT word, w, {sh('w')} AS s FROM c), d AS (SELECT word, CASE WHEN length(word) < 3 THEN w ELSE {rules(STEP2, 1)} END AS w FROM d0),
e0 AS (SELECT word, w, {sh('w')} AS s FROM d), e AS (SELECT word, CASE WHEN length(word) < 3 THEN w ELSE {rules(STEP3, 1)} END AS w FROM e0),
f0 AS (SELECT word, w, {sh('w')} AS s FROM e), f AS (SELECT word, CASE WHEN length(word) < 3 THEN w ELSE {rules(STEP4, 2)} END AS w FROM f0),
g0 AS (SELECT word, w, {sh('w')} AS s FROM f),
g AS (SELECT word, CASE WHEN length(word) > 2 AND ends_with(w, 'e') AND ({m('s')} > 1 OR {m('s')} = 1 AND NOT {cvc('left(w, length(w) - 1)', 'left(s, length(w) - 1)')}) THEN left(w, length(w) - 1) ELSE w END AS w FROM g0)
SELECT word, CASE WHEN length(word) > 2 AND length(w) > 1 AND ends_with(w, 'll') AND {m(sh('w'))} > 1 THEN left(w, length(w) - 1) ELSE w END AS stem FROM g
"""
