"""What a page says: title, text nodes, links (I3-I6, S4), HTTP headers."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

_SILENT = frozenset(["script", "style", "template"])
#: Content types that are indexed.
ACCEPTED = frozenset(["text/html", "application/xhtml+xml", "application/xml"])


#: An ampersand that begins no character reference; a reference ends in a semicolon.
_BARE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
#: Stands for it while a page is parsed: no reference has a dot in its name.
_AMP = "bare.ampersand"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.title: list[str] = []
        self.titles = self.in_title = self.silent = 0
        self.nodes: list[list[str]] = []
        self.hrefs: list[str] = []
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        self.fresh = True
        if tag == "title":
            self.in_title = 1
            self.titles += 1
        elif tag in _SILENT:
            self.silent += 1
        elif tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.hrefs.append(href.replace(f"&{_AMP};", "&"))

    def handle_endtag(self, tag):
        self.fresh = True
        if tag == "title":
            self.in_title = 0
        elif tag in _SILENT:
            self.silent = 0

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        if self.in_title:
            if self.titles == 1:
                self.title.append(data)
        elif not self.silent:
            if self.fresh:
                self.nodes.append([])
                self.fresh = False
            self.nodes[-1].append(data)

    def handle_entityref(self, name):
        if name == _AMP:
            self.handle_data("&")
        elif self.in_title and name in ("amp", "lt", "gt"):
            self.handle_data(f"&{name};")
        else:
            self.handle_data(html5.get(f"{name};", f"&{name};"))

    def handle_charref(self, name):
        char = unescape(f"&#{name};")
        self.handle_data(escape(char, quote=False) if self.in_title else char)


def read_page(html: str | None) -> tuple[str, str, list[str]]:
    """(title, plaintext, hrefs): the title as markup, text nodes joined by line feeds, hrefs in order.

    In the title, references to markup characters stay as they are. What looks like a reference but lacks its semicolon is text.
    """
    reader = _Reader()
    reader.feed(_BARE.sub(f"&{_AMP};", html or ""))
    reader.close()
    return "".join(reader.title), "\n".join("".join(n) for n in reader.nodes), reader.hrefs


def resolve(base: str, href: str) -> str | None:
    """Absolute http(s) address of a link, else None."""
    try:
        url = urljoin(base, href.strip())
        return url if urlsplit(url).scheme.lower() in ("http", "https") else None
    except ValueError:
        return None


def page_links(url: str, hrefs: list[str]) -> list[str]:
    """Distinct targets in order, without the page itself."""
    found = dict.fromkeys(t for h in hrefs if (t := resolve(url, h)) is not None)
    found.pop(url, None)
    return list(found)


def http_datetime(value: str) -> datetime:
    """An HTTP date; the day name is not checked. ValueError if it is none."""
    rest = value[5:].replace("GMT", "+0000")
    return datetime.strptime(rest, "%d %b %Y %H:%M:%S %z").astimezone(UTC)


def modified(headers: dict[str, str], now: datetime) -> datetime:
    """Last-Modified, or Date where that header is absent, or now; a header that cannot be read means now."""
    try:
        return http_datetime(headers.get("Last-Modified") or headers["Date"])
    except (KeyError, ValueError):
        return now.replace(microsecond=0)


def length(headers: dict[str, str], default: int) -> int:
    """Content-Length as a number, or ``default`` where there is none that can be read."""
    try:
        return int(headers["Content-Length"])
    except (KeyError, TypeError, ValueError):
        return default


def content_type(value: str) -> tuple[str, dict[str, str]]:
    """Media type and parameters; quoted values are unquoted."""
    kind, *rest = re.findall(r'(?:[^;"]|"(?:[^"\\]|\\.)*")+', value) or [""]
    params = {}
    for part in rest:
        name, eq, text = part.strip().partition("=")
        if eq:
            text = text.strip()
            params[name.strip().lower()] = re.sub(r"\\(.)", r"\1", text[1:-1]) if text[:1] == '"' and text[-1:] == '"' else text
    return kind.strip().lower(), params


def decode(body: bytes, header: str = "") -> str:
    """Bytes to text: header charset, then a meta declaration in the first 1024 bytes, then UTF-8; bad bytes replaced (S3)."""
    charset = content_type(header)[1].get("charset") if header else None
    if charset is None:
        head = body[:1024].decode("ascii", "replace")
        m = re.search(r"<meta[^>]*\bcharset\s*=\s*[\"']?\s*([\w:.-]+)", head, re.I)
        charset = m[1] if m else "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")
