"""Reader comments, and names of page parts that only look like parts without article text."""

from __future__ import annotations

import pytest

from ticklake.llm import html_extraction

SAY = [f"Sentence {k} of the post tells something that a reader wants to know." for k in range(12)]


def comments(k, n, shape):
    return "".join(shape.format(t=f"Comment {k} {j}, which is as long as a sentence of the post is, or longer than it.") for j in range(n))


SHAPES = {
    "post": ('<article class="post"><h1>Title</h1>{p}</article><div id="comments" class="comments-area"><h2 class="comments-title">Replies</h2>{c}</div>', '<article class="comment-body"><p>{t}</p></article>'),
    "main": ("<main><h1>Title</h1>{p}{c}</main>", '<article id="div-comment-7" class="comment-body"><p>{t}</p></article>'),
    "list": ('<div class="entry"><div class="article-header"><h1>Title</h1></div>{p}</div><ol class="commentList">{c}</ol>', '<li class="comment even depth-1"><p>{t}</p></li>'),
    "typed": ("<div><div><h1>Title</h1>{p}</div>{c}</div>", '<div itemscope itemtype="https://schema.org/Comment"><p>{t}</p></div>'),
    "inside": ('<article class="story"><h1>Title</h1>{p}<section class="story-comments">{c}</section></article>', "<article><p>{t}</p></article>"),
}


@pytest.mark.parametrize("counts", [[0, 1, 2, 3], [40], [5]])
def test_comments_go_and_the_article_stays(spark, counts):
    rows = []
    for host, (page, one) in SHAPES.items():
        for k in range(20):
            body = page.format(p="".join(f"<p>{s}</p>" for s in SAY), c=comments(k, counts[k % len(counts)], one))
            rows.append((len(rows), f"https://{host}.example/{k}", f"<html><body><nav><a>Menu</a></nav>{body}<footer>Foot</footer></body></html>"))
    want = " ".join(["Title", *SAY])
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {(r["url"], r["text"]) for r in found} == {(u, want) for _, u, _ in rows}


KEPT = [
    ('<article><p>See the <span class="ad-hoc">plan</span>, and <em class="side-note">more</em>.</p></article>', "See the plan, and more."),
    *((f'<article><div class="{name}"><h1>Title</h1></div><p>Body of it.</p></article>', "Title Body of it.") for name in ("article-header", "promo-code-explained", "share-price", "comment-on-policy", "entry-footer", "no-sidebar", "adventure")),
    ('<div class="content-sidebar-wrap"><main><p>Body.</p></main><div class="sidebar"><p>Side.</p></div></div>', "Body."),
    ('<div class="site-header"><article><p>Body.</p></article></div>', "Body."),
    ('<article class="sponsored"><p>Body.</p></article>', "Body."),
]
GONE = [
    *((f'<article><p>Body.</p></article><div class="{name}"><p>Not of it, though it is long enough.</p></div>', "Body.") for name in ("ad", "google-ads-top", "adBox", "sidebar", "site-header", "page-banner", "related-posts", "newsletter-signup-form", "cookie-notice", "share-buttons", "main-nav")),
    ('<article><p>Body.</p><span class="ad">Buy.</span></article>', "Body."),
    ('<article><p>Body.</p></article><div class="related"><article><p>Teaser of another.</p></article></div>', "Body."),
    ('<article><p>Body.</p></article><div class="sidebar-wrap"><article><p>Teaser of another.</p></article></div>', "Body."),
    ('<article><p>Body.</p></article><article class="reply"><p>I reply.</p></article>', "Body."),
]


@pytest.mark.parametrize("html, want", [*KEPT, *GONE])
def test_names_of_parts(html, want):
    assert html_extraction.read(f"<html><body>{html}</body></html>", None) == want
