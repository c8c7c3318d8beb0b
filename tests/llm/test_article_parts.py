"""Articles inside elements of unlikely names, and articles in several parts."""

import pytest

from lanternq.llm.html_text import main_text

P = "A paragraph of the text, with commas, and more, and words enough to count as running text, said the writer."
MORE = "Another part of the text, with commas, and more, and words enough to count as running text, said they all."


@pytest.mark.parametrize("name", ["page has-sidebar", "layout with-sidebar", "content no-comments", "widget"])
def test_article_inside_an_unlikely_name(name):
    for tag in ("article", "div"):
        page = f'<body><div class="{name}"><{tag}><p>{P}</p><p>{MORE}</p></{tag}></div><div class="sidebar"><p>Short, aside.</p></div></body>'
        assert main_text(page) == f"{P}\n\n{MORE}"


@pytest.mark.parametrize("rest", [f"<article><p>{MORE}</p><p>{P}</p></article>", f"<p>{MORE}</p><p>{P}</p>"])
def test_siblings_of_an_article_stay(rest):
    page = f"<body><div><article><p>{P}</p><p>{P}</p></article>{rest}</div></body>"
    assert main_text(page) == "\n\n".join([P, P, MORE, P])


FOREIGN = [
    "reader-comments", "user-comments", "post-comments", "commentlist", "discussion", "newsletter-signup", "in-article-ad", "adsbygoogle", "outbrain", "taboola", "related-posts",
    "site-footer", "author-box", "cookie-notice", "promo-box", "comments", "ad-slot", "sidebar-left", "subscribe-form", "sponsored-content",
]


@pytest.mark.parametrize("name", FOREIGN)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_foreign_parts_of_an_article_go(name, attribute):
    other = "Some other words, of another kind, that nobody asked for, as long as running text may be, and longer."
    page = f'<body><article><p>{P}</p><div {attribute}="{name}"><p>{other}</p></div><p>{MORE}</p></article></body>'
    assert main_text(page) == f"{P}\n\n{MORE}"


def test_threads_of_comments_go():
    page = f'<body><article><p>{P}</p><p>{MORE}</p><div id="disqus_thread"><p>{P}</p></div></article></body>'
    assert main_text(page) == f"{P}\n\n{MORE}"


@pytest.mark.parametrize("name", ["share-price", "market-share", "shares", "social-history", "author-note", "article-header", "content", "main-section", "commentary", "adventure", "navy", "subscribers", "text_ad2x"])
@pytest.mark.parametrize("around", ["article", "div"])
def test_parts_whose_names_only_sound_foreign_stay(name, around):
    page = f'<body><{around}><p>{P}</p><div class="{name}"><p>{MORE}</p></div><p>{P}</p></{around}></body>'
    if around == "article" or name != "article-header":
        assert main_text(page) == "\n\n".join([P, MORE, P])


@pytest.mark.parametrize("name", ["article-share", "social-links", "share-buttons", "author"])
def test_doubtful_names_go_without_running_text(name):
    page = f'<body><article><p>{P}</p><div class="{name}"><a href="x">Share this</a> <a href="y">Send it</a></div><p>{MORE}</p></article></body>'
    assert main_text(page) == f"{P}\n\n{MORE}"
