"""Class names of wrappers, and letters whose lower case is longer."""

import pytest

from auditmill.llm import extract

WORDS = " ".join(["The river rises in the hills and runs to the sea."] * 10)
ARTICLE = "".join(f"<p>{WORDS}</p>" for _ in range(4))
AROUND = '<nav><ul><li><a href="/">Home</a><li><a href="/x">About</a></ul></nav>'
SIDE = '<div class="sidebar"><p>Read our other pages too.</p></div><section class="comments"><p>Nice article, I love it so much.</p></section>'
TEXT = " ".join([WORDS] * 4)


@pytest.mark.parametrize("page", [
    f'<html><body class="has-sidebar">{AROUND}<article>{ARTICLE}</article>{SIDE}</body></html>',
    f'<html class="no-sidebar"><body id="menu">{AROUND}<main>{ARTICLE}</main>{SIDE}</body></html>',
    f'<body>{AROUND}<div class="with-menu"><article>{ARTICLE}</article></div>{SIDE}</body>',
    f'<body><div class="with-menu">{AROUND}<div>{ARTICLE}</div>{SIDE}</div></body>',
    f'<body><div class="with-menu"><article>{ARTICLE}</article></div><div class="comments"><p>{TEXT}</p></div></body>',
])
def test_wrappers(page):
    assert extract.main_text(page) == TEXT


def test_boilerplate_stays_out():
    page = f'<body><article>{ARTICLE}</article><div class="related"><article><p>A short teaser of another story.</p></article></div></body>'
    assert extract.main_text(page) == TEXT


def test_long_lower_case():
    page = f"<article><p>{'İ' * 30} one.</p><script>var x = '<p>no</p>';</SCRIPT><p>Two three four five.</p></article>"
    assert extract.main_text(page) == f"{'İ' * 30} one. Two three four five."
