"""Trees of markup as the HTML standard has them, and character sets as browsers find them."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditmill.sources import charset, html
from auditmill.sources.tree import Node, build, shown

CASES = {
    "": "",
    "x": "'x'",
    "<p>a<p>b": "p('a') p('b')",
    "<a href=x><p>one<p>two</a>three": "a(p('one')) p(a('two') 'three')",
    "<b>1<p>2</b>3</p>": "b('1') p(b('2') '3')",
    "<i><b>x</i>y</b>": "i(b('x')) b('y')",
    "<b><table><td></b><i></table>X": "b(table(tbody(tr(td(i)))) 'X')",
    "<p>1<b>2<i>3</b>4</i>5</p>": "p('1' b('2' i('3')) i('4') '5')",
    "<a>1<div>2<div>3</a>4": "a('1') div(a('2') div(a('3') '4'))",
    "<b><b><b><b><p>x</b></b></b></b>y": "b(b(b(b)) p(b(b(b('x'))) 'y'))",
    "<table><tr><td>a<td>b</table>c": "table(tbody(tr(td('a') td('b')))) 'c'",
    "<table>x<tr><b>y</b><td>z</table>": "'x' b('y') table(tbody(tr(td('z'))))",
    "<table><caption>c<tr><td>1</table>": "table(caption('c') tbody(tr(td('1'))))",
    "<table><colgroup><col><tr><td>x": "table(colgroup(col) tbody(tr(td('x'))))",
    "<table><td><table><td>1</table>2</table>3": "table(tbody(tr(td(table(tbody(tr(td('1')))) '2')))) '3'",
    "<table><input type=hidden><input></table>": "input table(input)",
    "<table><form><tr><td>x</table>": "table(form tbody(tr(td('x'))))",
    "<select><option>a<option>b<p>c</select>d": "select(option('a') option('bc')) 'd'",
    "<table><td><select><td>x": "table(tbody(tr(td(select) td('x'))))",
    "<ul><li>a<div><li>b</div></ul>": "ul(li('a' div) li('b'))",
    "<dl><dt>a<dd>b<dt>c</dl>": "dl(dt('a') dd('b') dt('c'))",
    "<h1>a<h2>b</h1>c": "h1('a') h2('b') 'c'",
    "<pre>\n\nx</pre><textarea>\ny</textarea>": "pre('\\nx') textarea('y')",
    "<svg><g/><p>x": "svg(g) p('x')",
    "<svg><foreignObject><p>x</foreignObject></svg>y": "svg(foreignobject(p('xy')))",
    "<ruby>a<rt>b<rp>c</ruby>": "ruby('a' rt('b') rp('c'))",
    "<button>a<button>b": "button('a') button('b')",
    "<nobr>a<nobr>b": "nobr('a') nobr('b')",
    "<object><b>x</object>y": "object(b('x')) 'y'",
    "<p>a<hr>b</p>": "p('a') hr 'b' p",
    "a&lt;b&notit;&ampx": "'a<b¬it;&x'",
    "a<!-- -- > --!>b<!>c": "'a' 'b' 'c'",
    "\x00x\r\ny\rz": "'x\\ny\\nz'",
    "<form>a<div></form>b</div>": "form('a' div('b'))",
}


@pytest.mark.parametrize("page", CASES)
def test_trees(page):
    body = CASES[page]
    assert shown(build(page)) == f"#document(html(head body({body})))" if body else "#document(html(head body))"


def test_heads():
    assert shown(build("<title>a<p></title><script>1<2</script><p>x")) == "#document(html(head(title('a<p>') script('1<2')) body(p('x'))))"
    assert shown(build("<head></head><style>s</style> <link><body>x")) == "#document(html(head(style('s') link) ' ' body('x')))"
    assert shown(build("<noscript><p></noscript><body>")) == "#document(html(head(noscript('<p>')) body))"
    assert shown(build("<template><td>x</template><p>y")) == "#document(html(head(template(td('x'))) body(p('y'))))"
    assert shown(build("<html lang=a><body class=b><html lang=c id=d><body id=e>")) == "#document(html(head body))"
    root = build("<html lang=a><body class=b><html lang=c id=d><body id=e class=f>").kids[0]
    assert root.attrs == {"lang": "a", "id": "d"} and root.kids[1].attrs == {"class": "b", "id": "e"}
    assert build("<a href='?a=1&copy=2&amp;c&lt' HREF=z b = c d>").kids[0].kids[1].kids[0].attrs == {"href": "?a=1&copy=2&c<", "b": "c", "d": ""}


PIECES = st.sampled_from("<p> </p> <b> </b> <a> </a> <table> </table> <tr> <td> </td> <li> <ul> </ul> <div> </div> <h1> <svg> </svg> <select> <option> <form> </form> <template> </template> <caption> <col> <title> </title> <frameset> <br> <i> </i> <button> <object> </object> <!-- --> <textarea> </textarea> <head> </head> <body> </body> x y".split())


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_any_markup_has_a_tree(pieces):
    """Every node stands in the tree once, under its parent, and the page's facts can be read."""
    root, seen = build("".join(pieces)), set()
    todo = [root]
    while todo:
        n = todo.pop()
        assert id(n) not in seen
        seen.add(id(n))
        for k in n.kids:
            if isinstance(k, Node):
                assert k.parent is n
                todo.append(k)
    html.page_facts("".join(pieces))


def test_deep_and_long_pages_take_time_in_proportion():
    began = time.monotonic()
    for page in ("<div>" * 30_000, "<b>" * 3_000 + "<p>x" * 300, "<table>" + "x<b>" * 500, "<a href=x>" * 5_000, "</p>" * 30_000, "<!--" + "-" * 300_000, "<" * 100_000):
        html.page_facts(page)
    assert time.monotonic() - began < 60


def test_charsets():
    say = charset.charset_of
    assert say(b"\xef\xbb\xbfx", "text/html; charset=koi8-r") == "utf-8" and say(b"\xff\xfex\0", "text/html") == "utf-16le"
    assert say(b"x", "text/html; charset=Latin1") == "windows-1252" and say(b"x", "text/html; charset = ' x-sjis'") == "shift_jis"
    assert say("é".encode(), "text/html") == "utf-8" and say(b"\xe9", "text/html") == "windows-1252" and say(b"x", "text/html") == "windows-1252"
    cut = ("a" * 1023 + "é").encode()
    assert say(cut, "text/html") == "windows-1252" and say(("é" + "a" * 1021 + "é").encode(), "text/html") == "utf-8"  # the last character is cut off
    assert say(b" " * 1020 + b"<meta charset=koi8-r>", "text/html") == "windows-1252"  # too late
    assert say(b"<meta http-equiv=refresh content='text/html; charset=koi8-r'>", "text/html") == "windows-1252"
    assert say(b"<p title='<meta charset=koi8-r>'><meta charset=\"x-user-unknown\"><meta charset=greek>", "text/html") == "iso-8859-7"
    assert say(b"<?xml version='1.0' encoding='EUC-KR'?>", "text/xml") == "euc-kr" == say(b"<?xml version='1.0' encoding='EUC-KR'?>", None, "/a.XML")
    assert say(b"<rss/>", "application/rss+xml") == "" == say(b"\xe9", "text/plain") == say(b"{}", "application/json; charset=latin1")
    assert say(b"\n <H1>x", "text/plain") == "windows-1252" and say(b"<h1x>", "text/plain") == ""
    assert all(charset.decode("é".encode("utf-8"), f"text/html; charset={label}") is not None for label in charset.NAMES)


@pytest.mark.parametrize("label,codec,text", [("latin2", "iso-8859-2", "ł"), ("koi8_r", "koi8-r", "Ж"), ("macintosh", "mac_roman", "é"), ("x-mac-ukrainian", "mac_cyrillic", "Ж"), ("cp866", "cp866", "Ж"), ("big5-hkscs", "big5hkscs", "中"), ("ks_c_5601-1987", "cp949", "한"), ("csiso2022jp", "iso2022_jp", "日"), ("windows-1258", "cp1258", "đ"), ("iso-8859-8", "iso-8859-8", "ש"), ("gb18030", "gb18030", "€")])
def test_labels(label, codec, text):
    assert charset.decode(text.encode(codec), f"text/html; charset={label}") == text
