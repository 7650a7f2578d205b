"""On a page without article or main, dense siblings stay whatever their tag."""

from sparrowdex.llm import html_extract


def test_siblings_of_every_tag_stay():
    para = lambda k, n: (f"w{k} " * n)[:n].strip()
    text = [para(k, 400) for k in range(6)]
    quote, after, items = para(7, 500), para(8, 400), [para(k, 400) for k in range(9, 12)]
    page = f'<body><div class="nav"><a href="/">Home</a></div><div id="content"><div class="text">{"".join(f"<p>{t}</p>" for t in text)}</div><h2>A heading</h2><blockquote>{quote}</blockquote><pre>{after}</pre><ul>{"".join(f"<li>{t}</li>" for t in items)}</ul></div></body>'
    assert html_extract.extract(page) == "\n".join([*text, "A heading", quote, after, *items])
