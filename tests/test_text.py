from datetime import UTC, datetime

import pytest

from pagelode.functions.page import content_type, decode, http_datetime, modified, page_links, read_page
from pagelode.functions.stem import stem
from pagelode.functions.text import analyze, load_stop_words, normalize, tokens


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("apple", "appl"), ("cherry", "cherri"), ("pie", "pie"), ("ultra", ""), ("micro", ""), ("intranet", "net"), ("adoption", "adop"),
        ("machine-readable", "machineread"), ("postgraduate", "postgradu"), ("admission", "admis"), ("university", "univers"), ("gas", "ga"), ("news", "new"), ("yes", "ye"), ("s", "s"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_tokens_keep_offsets():
    assert list(tokens("Chuck's\nfoo")) == [(0, "Chuck's"), (8, "foo")]
    assert [t for _, t in tokens("3,000 3:30 isn't it. cannot 6^7 end.")] == ["3,000", "3:30", "is", "n't", "it.", "can", "not", "6^7", "end", "."]
    assert list(tokens('say "hi"')) == [(0, "say"), (4, '"'), (5, "hi"), (7, '"')]
    assert list(tokens("")) == []


def test_normalize():
    assert normalize("Beyoncé") == normalize("Beyoncé") == "beyonce"
    assert normalize("\U0001d400-²") == "a2" and normalize("!?") == ""


def test_analyze_drops_stop_words():
    assert analyze("The machine-readable Chuck's apples") == [(4, "machineread"), (21, "chuck"), (29, "appl")]
    assert "the" in load_stop_words()


def test_page():
    title, text, hrefs = read_page("<title>A &amp; B</title><p>x<b>y</b> &lt;z<script>q</script></p><a href='/r'>L</a>")
    assert (title, text, hrefs) == ("A &amp; B", "x\ny\n <z\nL", ["/r"])
    assert read_page(None) == ("", "", [])
    assert page_links("http://h/a", ["/a", "b", "b", "/a#x", "mailto:x"]) == ["http://h/b", "http://h/a#x"]


def test_headers():
    now = datetime(2020, 1, 1, tzinfo=UTC)
    good = "Sun, 06 Nov 1994 08:49:37 GMT"
    assert http_datetime(good) == datetime(1994, 11, 6, 8, 49, 37, tzinfo=UTC)
    assert modified({"Date": good}, now).year == 1994
    assert modified({"Last-Modified": "bad", "Date": good}, now) == now
    with pytest.raises(ValueError):
        http_datetime("Thu, 31 Sep 2020 00:00:00 GMT")
    assert content_type('text/html; charset="utf-8"') == ("text/html", {"charset": "utf-8"})
    assert decode(b'<meta charset="latin-1">\xe9').endswith("é") and decode("é".encode(), "text/html") == "é"


def test_http_dates_equal_the_standard_parser():
    """Every form that the standard library writes is read back; strings that are no HTTP date are refused."""
    import random
    from email.utils import format_datetime

    own = random.Random(1)
    for _ in range(300):
        when = datetime.fromtimestamp(own.randrange(0, 4_000_000_000), UTC)
        assert http_datetime(format_datetime(when, usegmt=True)) == when
    bad = (
        "", "GMT", "Sun", "Sun, 06 Nov 1994", "06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "Sun, 32 Nov 1994 08:49:37 GMT",
        "Sun, 06 Foo 1994 08:49:37 GMT", "Sun, 06 Nov 1994 24:00:00 GMT", "Sun, 06 Nov 1994 08:60:37 GMT", "Sun, 06 Nov 1994 08:49:62 GMT", "Sat, 29 Feb 2021 00:00:00 GMT", "1994-11-06T08:49:37Z",
    )
    for text in bad:
        with pytest.raises(ValueError):
            http_datetime(text)
        assert modified({"Last-Modified": text or "-"}, datetime(2020, 1, 1, tzinfo=UTC)).year == 2020


@pytest.mark.parametrize(
    ("header", "kind", "params"),
    [
        ("text/html", "text/html", {}), ("TEXT/HTML", "text/html", {}), ("text/html;charset=utf-8", "text/html", {"charset": "utf-8"}), (" text/html ; Charset = UTF-8 ", "text/html", {"charset": "UTF-8"}),
        ('text/html; charset="utf-8"', "text/html", {"charset": "utf-8"}), ('a/b; x="1;2"; y=3', "a/b", {"x": "1;2", "y": "3"}), ('a/b; x="q\\"r"', "a/b", {"x": 'q"r'}), ("a/b; x", "a/b", {}),
        ("a/b; x=", "a/b", {"x": ""}), ("a/b;;x=1;", "a/b", {"x": "1"}), ("", "", {}), ("application/xhtml+xml; q=0.9", "application/xhtml+xml", {"q": "0.9"}), ("a/b; x=1; X=2", "a/b", {"x": "2"}),
    ],
)
def test_content_types(header, kind, params):
    assert content_type(header) == (kind, params)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Good muffins cost $3.88 in New York.", "Good muffins cost $ 3.88 in New York ."), ("They'll save and invest more.", "They 'll save and invest more ."),
        ("hi, my name can't hello,", "hi , my name ca n't hello ,"), ('He said, "Stop!"', 'He said , " Stop ! "'), ("a (b) [c] {d} <e>", "a ( b ) [ c ] { d } < e >"),
        ("It's 5:30 -- late; go...", "It 's 5:30 -- late ; go ..."), ("I'm gonna wanna cannot", "I 'm gon na wan na can not"), ("50% of #1 @ home & away", "50 % of # 1 @ home & away"),
        ("the dogs' bones", "the dogs ' bones"), ("line one.\nline two.", "line one.\nline two ."), ("''quoted''", "'' quoted ''"), ("U.S. and e.g. this", "U.S. and e.g. this"),
    ],
)
def test_treebank_tokens(text, want):
    """Published examples of the conventions; every token stands in the text where its offset says."""
    found = list(tokens(text))
    assert [t for _, t in found] == want.split()
    assert all(text[at : at + len(t)] == t for at, t in found) and [at for at, _ in found] == sorted(at for at, _ in found)


def test_normalize_keeps_letters_and_numbers_of_every_latin_character():
    import unicodedata

    for code in range(256):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] in "LN")
        assert normalize(c) == unicodedata.normalize("NFKC", plain).lower() and normalize(f"a{c}b") == f"a{normalize(c)}b"
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert normalize(unicodedata.normalize(form, "Zoë Ångström ﬁn ½")) == "zoeangstromfin12"


def test_references_without_semicolon_are_text():
    html = "<title>A &amp; B &copy; &am &amp</title><p>&amp;&amp</p>&lt;b&#62; &nosuch; &bare.ampersand;<a href='/x?a=1&copy=2&amp;b'>L</a> & &#x26"
    title, text, hrefs = read_page(html)
    assert title == "A &amp; B © &am &amp"
    assert text == "&&amp\n<b> &nosuch; &bare.ampersand;\nL\n & &#x26" and hrefs == ["/x?a=1&copy=2&b"]
    assert read_page("<title>a &#60;b&#62; &quot;</title>")[0] == 'a &lt;b&gt; "'
