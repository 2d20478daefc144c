"""Pages whose markup names, language or links must not decide alone."""

import pytest

from tidewater.llm.html_extract import extract

ART = ("This is the first of the sentences that the article has, and it is about what was there in the world. " * 4).strip()
RU = ("Это первое предложение большой статьи о том, что было в мире и чего в нём не было. " * 5).strip()
MENU, FOOT = "<html><body><nav><a href=x>Home</a></nav>", '<div class="footer">The end of it all.</div></body></html>'


@pytest.mark.parametrize(
    "body",
    [
        '<div class="content no-sidebar"><p>{}</p></div>',
        '<div class="site has-sidebar"><p>{}</p></div>',
        '<div class="entry-content share-ready"><p>{}</p></div>',
        '<article><div class="recommended-reading-level"><p>{}</p></div></article>',
        '<form id="aspnetForm"><div><p>{}</p></div></form>',
        '<div class="promo-page"><div><p>{}</p></div></div>',
    ],
)
def test_names_and_forms_alone_lose_no_article(body):
    assert extract(MENU + body.format(ART) + FOOT) == ART


def test_a_page_in_an_unknown_language():
    assert extract(f"{MENU}<div><p>{RU}</p><p>{RU}</p></div>{FOOT}") == f"{RU} {RU}"


def test_comments_stay_out_though_they_are_long():
    assert extract(f"{MENU}<article><p>{ART}</p></article><div class='user-comments'><p>{ART}</p><p>{ART}</p></div>{FOOT}") == ART
    assert extract(f"{MENU}<div id=comments><p>{ART}</p></div>{FOOT}") == ""


def test_a_paragraph_that_is_a_link():
    link = "This is a paragraph which is wholly one link, and it is a part of the article itself"
    assert extract(f"<article><p>{ART}</p><p><a href=x>{link}</a></p><p>{ART}</p></article>") == f"{ART} {link} {ART}"


def test_camel_case_names():
    assert extract(f'{MENU}<div><p>{ART}</p></div><div class="siteFooter"><p>It is the end of it and that is what it is, as it was in the world of the makers.</p></div>') == ART
