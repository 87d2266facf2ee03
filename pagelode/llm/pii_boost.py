"""Personal data by boosted candidates.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and telephone numbers by their exact forms; what
they find always stays. Beyond that, high-recall generators propose overlapping spans (loose phone numbers, obfuscated
addresses, social security and national identity numbers, account numbers, dates of birth). Gradient-boosted trees score
each proposal by its format and its context, one calibrated threshold per kind turns scores into decisions, and the
best-scored spans that overlap no accepted span are added.

The trees are trained here, on the driver, from ``TRAINING_ROWS`` generated and labelled sentences (a fixed bound and
seed, whatever the corpus), in which formats of several countries stand in telling, misleading or no context; a format
alone often leaves the label open, as in real text. Three fifths of the rows grow the trees, one fifth sets each kind's
threshold as the lowest score from which ``PRECISION`` is kept, and one fifth is held out to report (``evaluation``).

Defined cases: null text is the empty text; a text without a digit or an @ sign and without a spelled-out address has
no spans; equal spans of several kinds are all listed for base kinds; of proposals with one score the earlier one, then
the kind that is listed first, wins; repeated rows repeat; long texts are read whole, each generator in bounded time for
a position; an empty table gives an empty result; other input columns, also ``spans`` or ``n_email``, are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

#: Base kinds in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("phone_loose", "email_spelled", "ssn", "iban", "birth_date", "national_id")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
TRAINING_ROWS = 12000
PRECISION, MARGIN = 0.95, 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number that is not at the start of its digits cannot begin a match that its start could not, except after a match
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping, in linear time: the run of local characters before each @, then the domain."""
    out, done, at = [], 0, text.find("@")
    local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base detectors."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


#: High-recall generators: bounded patterns, so each position costs a bounded time.
_GENERATORS = (
    ("phone_loose", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{9,12}(?![0-9A-Za-z])")),
    ("email_spelled", re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}"
        r"(?:(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{2,63}){1,3}(?![A-Za-z0-9-])"
    )),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("birth_date", re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z])")),
    ("national_id", re.compile(
        r"(?<![0-9A-Za-z])(?:[A-CEGHJ-PR-TW-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D]|[XYZ]?[0-9]{7,8}-?[A-Z]|[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]"
        r"|[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}(?:\x20?[0-9]{2})?)(?![0-9A-Za-z])"
    )),
)
#: A part of every spelled address that has no @, so that no proposal is lost where a text has no digit either.
_SPELLED = re.compile(r"(?:at|AT)\x20?[\])}>]?\x20?[A-Za-z0-9-]{1,63}\x20?[\[({<]?\x20?(?:dot|DOT|\.)")

#: Words before or after a span that speak for or against it, in four languages.
_CONTEXT = (
    ("phone", "phone tel telephone telefon telefono telefonnummer call mobile mobil handy cell fax dial ring whatsapp appeler tel phones llamar anrufen"),
    ("mail", "mail email mails e write reach contact address kontakt adresse correo courriel escribir schreiben"),
    ("ssn", "ssn social security taxpayer sozialversicherung seguridad"),
    ("bank", "iban account bank transfer payee wire konto kontonummer compte cuenta banque banco virement"),
    ("birth", "born birth dob birthday birthdate geboren geburtsdatum naissance nacimiento nacido nee"),
    ("identity", "insurance nino dni nie nif nir passport identity identification identidad ausweis fiscale codice carte secu"),
    ("number", "order invoice part item serial version page pages isbn model no ref ticket case total price eur usd sum score volume issue rechnung bestellung artikel facture commande factura pedido isrc doi build patent article"),
    ("date", "published updated date on since until released copyright posted am le el vom du desde erschienen publicado deadline expires"),
)
_SETS = tuple(frozenset(words.split()) for _, words in _CONTEXT)
_PERSON = frozenset("my his her your our me him us mr mrs ms dr herr frau monsieur madame senor senora name employee patient applicant customer".split())
#: Lengths of account numbers by country, and endings of host names.
_IBAN_LENGTH = {"DE": 22, "FR": 27, "GB": 22, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PL": 28, "PT": 25, "SE": 24, "DK": 18, "IE": 22}
_ENDINGS = frozenset("com org net edu gov io de fr es it nl uk at ch pl pt eu info dev co br in se".split())
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and _mod97(s) == 1


def _checked_id(text: str) -> bool:
    """A Spanish number with its letter, or a French one with its key."""
    s = text.replace(" ", "").replace("-", "")
    if re.fullmatch("[XYZ]?[0-9]{7,8}[A-Z]", s):
        return _DNI[int(s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23] == s[-1]
    return len(s) == 15 and s.isdigit() and 97 - int(s[:13]) % 97 == int(s[13:])


def _date_parts(span: str) -> tuple[int, bool]:
    """Year of a date, and whether its day and month exist."""
    numbers = [int(x) for x in re.findall("[0-9]+", span)]
    year = next((n for n in numbers if n > 1000), 0)
    rest = [n for n in numbers if n < 1000]
    return year, len(rest) == 2 and min(rest) in range(1, 13) and max(rest) in range(1, 32)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a proposal."""
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-5:]
    after = re.findall(r"[a-z]+", text[end : end + 20].lower())[:2]
    near = text[max(0, start - 16) : start] + text[end : end + 16]
    year, real_date = _date_parts(span) if kind == "birth_date" else (0, False)
    local, _, host = re.sub(r"\x20?[\[({<]?\x20?\b(?:at|AT)\b\x20?[\])}>]?\x20?", "@", span, count=1).partition("@") if kind == "email_spelled" else ("", "", "")
    compact = span.replace(" ", "")
    return [
        float(ORDER[kind]), len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        span.count("-"), span.count(" "), span.count("."), span.count("/"), float("(" in span), float(digits[:1] == "0"),
        float(luhn(digits)) if digits else 0.0, float(kind == "iban" and _iban(span)), float(kind == "iban" and _IBAN_LENGTH.get(compact[:2]) == len(compact)),
        float(kind == "national_id" and _checked_id(span)), float(kind == "national_id" and compact[:1].isalpha()), year, float(real_date),
        float(bool(re.search(r"\b(?:dot|DOT)\b", span))), float(bool(re.search(r"[\[({<]\x20?(?:at|AT|@)", span))), float("@" in span),
        float(bool(re.search("[._0-9-]", local))), len(local), float(re.split("[^A-Za-z0-9]", host)[-1].lower() in _ENDINGS),
        float(digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:9] == "0000"),
        float(text[start - 1 : start] in ("$", "€", "#", "%", "v", "=", "£")), float(text[end : end + 1] in ("%", "€", "$")), float(text[max(0, start - 3) : start].rstrip(" ")[-1:] == ":"),
        len(_digits(near)), float(any(w in _PERSON for w in before)),
        *(float(any(w in s for w in before)) for s in _SETS), *(float(bool(before) and before[-1] in s) for s in _SETS), *(float(any(w in s for w in after)) for s in _SETS),
    ]


# ---------------------------------------------------------------- training rows

#: Common words of four languages, as filler between telling words.
_FILLER = """the of and to in for with that this from have been will after before about people time work house city report week small large open
der die und das ist nicht mit auf ein werden haben nach aber auch oder zwischen arbeit stadt woche bericht haus
le la les et des une dans pour avec sur sont nous vous mais travail ville semaine maison rapport petit
el los las que una con por para como pero entre trabajo ciudad semana casa informe grande""".split()
_NAMES = "anna peter maria jonas lucie karim olga pedro ines tom wei priya sven elena marc julia".split()
_LEADS = {
    "phone_loose": ("phone", "tel.", "call me at", "mobile", "Telefon", "fax", "ring", "tél", "llamar al", "WhatsApp", "my number is", "reach her on", "Handy", "contact"),
    "email_spelled": ("mail", "write to", "contact", "e-mail", "reach me at", "Kontakt", "courriel", "correo", "send it to", "questions:"),
    "ssn": ("SSN", "social security number", "SSN is", "taxpayer id", "his social security no"),
    "iban": ("IBAN", "account", "bank account", "transfer to", "Konto", "compte", "cuenta", "pay into"),
    "birth_date": ("born", "born on", "date of birth", "DOB", "geboren am", "née le", "birthday", "fecha de nacimiento", "Geburtsdatum"),
    "national_id": ("national insurance number", "NINO", "DNI", "NIE", "codice fiscale", "NIR", "passport", "identity card", "Ausweis", "numéro de sécu"),
}
_AGAINST = (
    "order", "invoice no", "part number", "item", "serial", "version", "pages", "ISBN", "ref.", "ticket", "case", "total", "price", "score", "vol.", "issue",
    "Rechnung", "Artikel", "facture", "pedido", "build", "patent", "DOI", "article", "model", "size", "lot", "tracking", "room", "grid",
)
_DATES = ("published", "updated on", "since", "released", "posted", "deadline", "am", "le", "el", "expires", "meeting on", "valid until", "vom", "copyright")


def _digits_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _iban_of(rng: random.Random, valid: bool) -> str:
    country = rng.choice(sorted(_IBAN_LENGTH))
    body = _digits_of(rng, _IBAN_LENGTH[country] - 4 - (4 if country in ("GB", "NL", "IE") else 0))
    if country in ("GB", "NL", "IE"):
        body = "".join(rng.choice("ABCDEFGHKLMNPRST") for _ in range(4)) + body
    check = 98 - _mod97(country + "00" + body)
    out = f"{country}{check if valid else (check + rng.randint(1, 60)) % 97:02d}{body}"
    return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if rng.random() < 0.5 else out


def _made(rng: random.Random, kind: str, real: bool) -> str:
    """A span of a kind's format; look-alikes share most formats with real ones."""
    d = lambda n: _digits_of(rng, n)
    sep = rng.choice("- .")
    if kind == "phone_loose":
        real_forms = (
            f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)}/{d(3)}{d(4)}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"0{rng.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)} {d(6)}", f"0{d(9)}", f"{d(5)} {d(5)}", f"0{d(4)}-{d(5)}", f"020 {d(4)} {d(4)}",
        )
        look = (
            f"{d(2)} {d(3)}", f"{d(4)}-{d(4)}", f"{d(2)}.{d(2)}", f"{d(9)}", f"{d(3)}-{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(10)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)}.{d(3)}.{d(3)}",
            f"978-{d(2)}-{d(4)}-{d(3)}", f"{d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", f"{d(4)}/{d(2)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"{d(5)}-{d(4)}", f"{d(2)}-{d(2)}-{d(2)}", f"19{d(2)}-20{d(2)}", f"{d(12)}",
        )
        return rng.choice(real_forms if real or rng.random() < 0.15 else look)
    if kind == "email_spelled":
        a = rng.choice(_NAMES) + rng.choice(["", d(2), "." + rng.choice(_NAMES), "_" + rng.choice(_NAMES), "-" + d(1)])
        b, c = rng.choice([*_FILLER, "example", "mail", "firm", "uni-test", "posteo"]), rng.choice(sorted(_ENDINGS))
        if real:
            return rng.choice([
                f"{a} at {b} dot {c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a} {{at}} {b} {{dot}} {c}", f"{a} @ {b}.{c}",
                f"{a} at {b}.{c}", f"{a} AT {b} DOT {c}", f"{a} [at] {b}.{c}", f"{a}<at>{b}<dot>{c}", f"{a} (at) {b} dot co dot uk", f"{a}[@]{b}.{c}",
            ])
        word = rng.choice(_FILLER)
        return rng.choice([f"{word} at {b}.{rng.choice(_FILLER)}", f"{word} at {b}.{c}", f"{word} @ {b}.{rng.choice(_FILLER)}", f"{word} at {b} dot {rng.choice(_FILLER)}", f"look at {b}.{c}", f"{d(2)} at {b}.{rng.choice(_FILLER)}"])
    if kind == "ssn":
        span = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        span = span if rng.random() < 0.8 else span.replace("-", " ")
        return span if real or rng.random() < 0.5 else rng.choice([f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-0000"])
    if kind == "iban":
        if real or rng.random() < 0.6:
            return _iban_of(rng, real)
        return rng.choice([f"{rng.choice(['AB', 'XX', 'SN', 'PN'])}{d(2)}{d(4)}{d(4)}{d(rng.choice([4, 8]))}", f"{rng.choice(['DE', 'US'])}{d(2)} {d(4)} AB{d(2)} {d(4)}"])
    if kind == "birth_date":
        day, month = rng.randint(1, 28), rng.randint(1, 12)
        year = rng.randint(1930, 2012) if real or rng.random() < 0.4 else rng.randint(1990, 2029)
        if not real and rng.random() < 0.1:
            month = rng.randint(13, 28)
        return rng.choice([f"{day:02d}/{month:02d}/{year}", f"{day}.{month}.{year}", f"{year}-{month:02d}-{day:02d}", f"{day:02d}-{month:02d}-{year}", f"{month}/{day}/{year}"])
    if real:
        n, pre = rng.randint(1_000_000, 99_999_999), rng.choice(["", "", "X", "Y"])
        n = n % 10_000_000 if pre else n
        text = f"{n:07d}" if pre else f"{n:08d}"
        letter = _DNI[int({"": "", "X": "0", "Y": "1"}[pre] + text) % 23]
        nir = f"{rng.choice('12')}{d(2)}{rng.randint(1, 12):02d}{rng.randint(1, 95):02d}{d(3)}{d(3)}"
        caps = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPRSTWZ") for _ in range(k))
        return rng.choice([
            f"{pre}{text}{letter}", f"{pre}{text}-{letter}", f"{rng.choice('ABCEGHJKLMNPRSTWXYZ')}{rng.choice('ABCEGHJKLMNPRSTWXYZ')}{rng.choice(['', ' '])}{d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}",
            f"{nir[:1]} {nir[1:3]} {nir[3:5]} {nir[5:7]} {nir[7:10]} {nir[10:]} {97 - int(nir) % 97:02d}", f"{nir}{97 - int(nir) % 97:02d}", f"{caps(6)}{d(2)}{rng.choice('ABCDEHLMPRST')}{d(2)}{rng.choice('ABCDEFGHIL')}{d(3)}{rng.choice('ABCDEFGHJKLMNPQRSTUVWXYZ')}",
        ])
    return rng.choice([f"{d(8)}{rng.choice('ABCDEFGHIJ')}", f"{d(7)}-{rng.choice('ABXYZ')}", f"{rng.choice('12')}{d(12)}", f"{rng.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{rng.choice('XYZ')}{d(8)}{rng.choice('KLMN')}", f"AB{d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}"])


def _sentence(rng: random.Random) -> list[tuple[str, int, int, str, bool]]:
    """The proposals over the span of one generated sentence, with labels: only the span's own kind can be right.

    About a third of the sentences stand without a telling word, some with a misleading one.
    """
    kind, real, luck = rng.choice(MORE_KINDS), rng.random() < 0.5, rng.random()
    against = _DATES if kind == "birth_date" else _AGAINST
    telling = luck >= 0.35
    if kind in ("birth_date", "ssn") and real:
        telling = luck >= 0.12  # without a word for it such a format is hardly ever said of a person
    lead = rng.choice(_LEADS[kind] if real else against) if telling else rng.choice(against if real else [*_DATES, *_AGAINST]) if luck < 0.06 else ""
    filler = lambda n: " ".join(rng.choice(_FILLER) for _ in range(n))
    gap = rng.choice([": ", " ", " is ", " - ", " no. "]) if lead else ""
    who = rng.choice(["", "", f"{rng.choice(_NAMES).title()} ", "my ", "Mr "]) if real else rng.choice(["", "", "", "the ", f"{rng.choice(_NAMES).title()} "])
    text = f"{filler(rng.randint(1, 7))}{rng.choice(['. ', ' ', ', '])}{who}{lead}{gap}"
    at = len(text)
    span = _made(rng, kind, real)
    text += span + rng.choice([". ", ", ", " ", "\n", "; "]) + filler(rng.randint(1, 6))
    end = at + len(span)
    whole = lambda m: m.start() <= at + 2 and m.end() >= end - 2
    return [(text, *m.span(), k, real and k == kind and whole(m)) for k, g in _GENERATORS for m in g.finditer(text) if m.start() < end and m.end() > at]


def training_rows(n: int = TRAINING_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    rows, labels = [], []
    while len(rows) < n:
        for text, a, b, kind, real in _sentence(rng):
            rows.append(features(text, a, b, kind))
            labels.append(real)
    return np.array(rows[:n]), np.array(labels[:n], float)


# ---------------------------------------------------------------- boosted trees


@dataclass
class BoostedTrees:
    """Logistic gradient boosting over complete trees of fixed depth: node tables and leaf values per tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24) -> BoostedTrees:
        p = y.mean()
        base = float(np.log(p / (1 - p)))
        score = np.full(len(y), base)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        slots = np.stack([np.searchsorted(cuts, x[:, j], side="left") for j, cuts in enumerate(edges)])
        inner, leaves = 2**depth - 1, 2**depth
        feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob) + 1e-6
            at = np.zeros(len(y), int)
            for node in range(inner):
                here = np.flatnonzero(at == node)
                if len(here) < 20:
                    at[here] = 2 * node + 1
                    continue
                best = (1e-3, 0, np.inf)
                gh, hh = g[here], h[here]
                g_all, h_all = gh.sum(), hh.sum()
                whole = g_all**2 / (h_all + 1)
                for j, cuts in enumerate(edges):
                    if not len(cuts):
                        continue
                    gs, hs = (np.bincount(slots[j, here], v, len(cuts) + 1).cumsum()[:-1] for v in (gh, hh))
                    gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - whole
                    if gain[k := int(gain.argmax())] > best[0]:
                        best = (float(gain[k]), j, float(cuts[k]))
                _, feature[t, node], cut[t, node] = best
                at[here] = 2 * node + 1 + (x[here, feature[t, node]] > cut[t, node])
            place = at - inner
            for k in range(leaves):
                here = place == k
                leaf[t, k] = rate * g[here].sum() / (h[here].sum() + 1)
            score += leaf[t, place]
        return cls(base, feature, cut, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            while (at < inner).any():
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            score += v[at - inner]
        return 1 / (1 + np.exp(-score))


@cache
def model(rows: int = TRAINING_ROWS, precision: float = PRECISION) -> tuple[BoostedTrees, dict[str, float], dict[str, tuple[float, float]]]:
    """Trees, threshold of each kind, and precision and recall of each kind on held-out rows."""
    x, y = training_rows(rows)
    fold = np.arange(len(y)) % 5
    trees = BoostedTrees.fit(x[fold < 3], y[fold < 3])
    p, true, kind = trees.predict(x), y > 0, x[:, 0]
    limits, told = {}, {}
    for k in MORE_KINDS:
        mine = (kind == ORDER[k]) & (fold == 3)
        order = np.argsort(-p[mine], kind="stable")
        right = true[mine][order]
        good = np.cumsum(right) / np.arange(1, len(right) + 1)
        # the lowest scores taken must be right more often than not themselves
        last = np.convolve(right, np.ones(MARGIN), "full")[: len(right)] / np.minimum(np.arange(1, len(right) + 1), MARGIN)
        fit = np.flatnonzero((good >= precision) & (last > 0.5))
        limits[k] = float(p[mine][order][fit[-1]]) if len(fit) else 1.1
        test = (kind == ORDER[k]) & (fold == 4)
        chosen = test & (p >= limits[k])
        told[k] = (float(true[chosen].mean()) if chosen.any() else 1.0, float(chosen[test & true].mean()))
    return trees, limits, told


def evaluation() -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on the fifth of the rows that neither grew trees nor set thresholds."""
    return model()[2]


def more_spans(text: str, base: list[tuple[int, int, str]], trained) -> list[tuple[int, int, str]]:
    """Spans that the trees select, without those that touch a base span or a better one."""
    found = [(*m.span(), kind) for kind, g in _GENERATORS for m in g.finditer(text)]
    if not found:
        return []
    trees, limits, _ = trained
    p = trees.predict(np.array([features(text, *f) for f in found]))
    taken = [(a, b) for a, b, _ in base]
    out = []
    for score, (a, b, kind) in sorted(zip(p.tolist(), found, strict=True), key=lambda r: (-r[0], r[1][0], ORDER[r[1][2]])):
        if score >= limits[kind] and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))
    return out


def find(text: str | None, trained) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start and kind."""
    text = text or ""
    if not (re.search("[0-9@]", text) or _SPELLED.search(text)):
        return [], []
    base = base_spans(text)
    return base, sorted(base + more_spans(text, base, trained), key=lambda s: (s[0], ORDER[s[2]]))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str:
    """The text with each accepted span replaced by its kind in brackets."""
    text, out, at = text or "", [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op4_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    trained = model()

    def run(cols):
        out: list[list] = [[] for _ in range(6)]
        for text in cols["text"].to_pylist():
            base, spans = find(text, trained)
            for i, k in enumerate(BASE_KINDS):
                out[i].append(sum(s[2] == k for s in base))
            out[4].append(hashlib.sha256(_listed(base).encode()).hexdigest())
            out[5].append(_listed(spans))
        return [cols["doc_id"], *out]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
