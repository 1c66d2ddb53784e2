"""Names of containers in pages: evidence, not law."""

import pytest

from loomspark.llm import html_extract as H

TEXT = "<h1>Heading of the page</h1>" + "".join(f"<p>Paragraph {i} is a full sentence of the article that says something of interest to the people who read it.</p>" for i in range(30))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "legal-news", "search-results", "banner-story", "rating-guide", "form-guide", "alert-levels", "post-content share-enabled", "no-comments open"])
@pytest.mark.parametrize("around", ["<body>{}</body>", "<main>{}</main>"])
def test_names_of_several_words_keep_an_article(name, around):
    got = H.main_text("<html>" + around.format(f'<div class="{name}">{TEXT}</div><div class="sidebar"><p>Other things that are here to be read.</p></div>') + "</html>")
    assert got.count("\n") == 30 and got.startswith("Heading of the page") and "Other things" not in got


@pytest.mark.parametrize("name", ["sidebar", "comment-list", "commentList", "site-footer", "cookie-notice", "related-posts", "post-comments", "main-nav", "ad-slot", "newsletter-signup", "hidden", "sidebar-left"])
def test_names_that_say_nothing_else_are_certain(name):
    article = f'<div class="story">{TEXT}</div>'
    other = "".join(f"<p>Somebody writes a long text of number {i} here, and it goes on for some time, as it often does.</p>" for i in range(40))
    got = H.main_text(f'<html><body>{article}<div class="{name}">{other}</div></body></html>')
    assert got.count("\n") == 30 and "Somebody" not in got


def test_an_article_of_an_odd_name():
    one = "<p>One paragraph of the article, long enough to be one of a text, and no more than that.</p>"
    assert H.main_text(f'<html><body><article class="post social-issues">{one}</article></body></html>').startswith("One paragraph")
    both = H.main_text(f'<html><body><article class="post">{one}</article><div class="x"><article class="comment">{one.replace("One", "Reader")}</article></div></body></html>')
    assert both.startswith("One paragraph") and "Reader" not in both


def test_a_label_is_one_name():
    assert H.main_text(f'<html><body><div aria-label="How cookie law came to be">{TEXT}</div></body></html>').count("\n") == 30
    assert H.main_text(f'<html><body>{TEXT}<div aria-label="Main menu"><p>Some words of a menu that are long enough to be a text of their own.</p></div></body></html>').count("\n") == 30
