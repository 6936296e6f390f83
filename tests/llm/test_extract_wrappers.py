"""Pages whose article stands in a form, has a header of its own, or holds elements that aren't shown; other layouts, marked by hand."""

import itertools

import pytest

from auditmill.llm import extract

LINE = "The river rises in the hills and runs to the sea."
WORDS = " ".join([LINE] * 6)
PARAGRAPHS = [f"{WORDS} Part {k} ends here." for k in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(PARAGRAPHS)
NAV = '<nav><ul><li><a href="/">Home</a><li><a href="/x">About</a></ul></nav>'
FOOT = "<footer><p>© 2026 Example. All rights reserved.</p></footer>"
FIELDS = '<form action="/s"><label>Search</label><input><button>Go</button><p>Your address is never shared.</p></form>'


def test_form_around_the_page():
    assert extract.main_text(f"<body><form id=aspnetForm>{NAV}<div>{ARTICLE}</div>{FOOT}</form></body>") == TEXT
    assert extract.main_text(f"<body><form><fieldset><article>{ARTICLE}</article></fieldset>{NAV}</form>{FOOT}</body>") == TEXT


def test_forms_beside_the_article_go():
    assert extract.main_text(f"<body>{NAV}<article>{ARTICLE}</article>{FIELDS}{FOOT}</body>") == TEXT
    assert extract.main_text(f"<body><form>{NAV}<main>{ARTICLE}{FIELDS.replace('form', 'fieldset')}</main></form></body>") == TEXT


def test_header_of_an_article():
    assert extract.main_text(f"<body><header><p>Example site</p>{NAV}</header><article><header><h1>On rivers</h1></header>{ARTICLE}</article></body>") == f"On rivers {TEXT}"
    assert extract.main_text(f"<body><header><h1>Example site, a place to read</h1></header><main>{ARTICLE}</main></body>") == TEXT


@pytest.mark.parametrize("how", ["hidden", "hidden=''", "style='color:red; display : NONE'", "style='visibility:hidden;'"])
def test_hidden_paragraphs(how):
    assert extract.main_text(f"<article><p {how}>{WORDS} Not shown.</p>{ARTICLE}<div {how}><p>{WORDS} Nor this.</p></div></article>") == TEXT


def test_shown_all_the_same():
    """A name that only sounds hidden, and a page that is hidden until its script runs."""
    assert extract.main_text(f"<article><p data-hidden=no style='display:block'>{PARAGRAPHS[0]}</p></article>") == PARAGRAPHS[0]
    assert extract.main_text(f"<body><div style='visibility:hidden'><article>{ARTICLE}</article></div></body>") == TEXT


AROUND = ["<body>{}</body>", "<body><form>{}</form></body>", "<body><div class=wrapper><div class=page>{}</div></div></body>", "<body class='menu-open'><header class=top><p>Example</p></header>{}</body>", "<body><table><tr><td>{}</td></tr></table></body>"]
INNER = ["<article>{}</article>", "<main><section>{}</section></main>", "<div class=post-content>{}</div>", "<div id=content><div>{}</div></div>"]
BESIDE = [f"{NAV}{{}}{FOOT}", f"{NAV}{{}}<aside><p>Read our other pages too.</p></aside><section class=comments><p>Nice article, I love it so much.</p></section>{FOOT}"]


def test_layouts():
    """Forty layouts: precision and recall of words."""
    found = wanted = shared = 0
    for around, inner, beside in itertools.product(AROUND, INNER, BESIDE):
        got = extract.main_text(around.format(beside.format(inner.format(ARTICLE)))).split()
        want = TEXT.split()
        both = sum(min(got.count(w), want.count(w)) for w in set(want))
        found, wanted, shared = found + len(got), wanted + len(want), shared + both
    assert shared / found >= 0.95 and shared / wanted >= 0.95, (shared / found, shared / wanted)
