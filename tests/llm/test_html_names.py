"""Elements that are named like asides but hold the article stay."""

import pytest

from sparrowdex.llm import html_extract

P = "Some long text of the article that goes on for a while. " * 4


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content-sidebar-wrap"><main><p>{}</p></main></div></body>',
        '<body><div class="layout has-sidebar"><div><p>{}</p></div></div></body>',
        '<body><div class="post comments-open"><p>{}</p></div></body>',
        '<body><div class="sidebar"><article><p>{}</p></article></div></body>',
        '<body><div class="related"><p>{}</p></div><div class="comments"><p>A short comment.</p></div></body>',
        '<body><main><p>{}</p><div class="box ad"><p>Buy this.</p></div></main></body>',
    ],
)
def test_the_article_stays(page):
    assert html_extract.extract(page.format(P)) == P.strip()
