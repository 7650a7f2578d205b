"""Long inputs, clashing names, repeated rows and empty tables for the operators that test_operators.py does not try them on."""

import hashlib
import math
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from sparrowdex.llm import chat, decontaminate, html_extract, packing, queries, sharding, url_filter, warc
from sparrowdex.storage import drop_path, shared_path

SF = "/root/testdata/sf0.001"


def test_a_conversation_of_many_turns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é says <|im_end|> and "), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    began = time.time()
    out = chat.op8(spark, rows).where("conv_id = 1").collect()[0]
    assert time.time() - began < 60 and out.n_turns == n
    con = oracle.connection(SF)
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT 1::BIGINT AS conv_id, i AS turn, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'é says <|im_end|> and ' || repeat(i::VARCHAR, 20) AS text FROM range(20000) t(i)")
    want = con.execute(chat.OP8_SQL).df().query("conv_id == 1").iloc[0]
    assert all(out[c] == want[c] for c in ("turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


def test_chat_with_any_names_and_long_texts(spark):
    long = "<|im_start|>" * 20_000 + "x" * 1_000_000
    rows = [(1, 0, "user", long, "a", "b", 1), (1, 0, "user", long, "a", "b", 1), (1, 1, "assistant", long, "a", "b", 1), (None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, written string, ts string, t int")
    out = {r.conv_id: r for r in chat.format_turns(frame).collect()}
    assert [t.text for t in out[1].turns] == [long] * 3 and len(out[None].turns) == 1
    s = out[1].loss_spans[0]
    assert out[1].formatted[s.first - 1 : s.first - 1 + s.length].replace("<\\|", "<|") == long and s.turn == 2
    assert chat.format_turns(frame.limit(0)).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that leaks")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see: A passage of  the benchmark that leaks!", "a", 1, None), (1, "clean", "b", 2, [1]), (None, None, "c", 3, None), (None, "a passage of the benchmark that leaks", "c", 3, None)], "doc_id long, text string, _id string, _h int, `x.y` array<int>")
    out = decontaminate.without_leaks(docs, bench)
    assert out.columns == docs.columns and sorted((r._id, r.text) for r in out.collect() if r.text) == [("b", "clean")] and out.count() == 2
    assert decontaminate.without_leaks(docs, bench, block_chars=5).count() == 2
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 4 and decontaminate.without_leaks(docs.limit(0), bench).count() == 0


def test_shards_equal_a_second_ranking(spark):
    """Shuffled ranks within sources, fractional ranks and the cut, by plain sorting."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", F.lit(9).alias("SHARD"), F.lit("x").alias("slot"))
    strata = {}
    for r in docs.collect():
        strata.setdefault(r.source, []).append((int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id))
    order = []
    for source, held in strata.items():
        order += [((k + 0.5) / len(held), source, h, i) for k, (h, i) in enumerate(sorted(held))]
    order.sort()
    for shards in (1, 3, 8):
        cuts = [k * (len(order) // shards) + min(k, len(order) % shards) for k in range(shards + 1)]
        want = {order[p][3]: (k, p - cuts[k]) for k in range(shards) for p in range(cuts[k], cuts[k + 1])}
        out = sharding.interleave(docs, shards)
        assert out.columns == ["doc_id", "source", "shard", "slot"]
        assert {r.doc_id: (r.shard, r.slot) for r in out.collect()} == want


def test_urls_of_odd_pages(spark):
    long = "http://long.com/" + "a" * 200_000
    link = '<a href="http://x.com/">x</a>' * 50_000
    rows = [(1, "http://x.com/en/1", "", "a", "b", 1, "r"), (1, "http://x.com/en/1", "", "a", "b", 1, "r"), (2, long, link, None, None, None, None), (3, None, None, None, None, None, None), (4, "", "", None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _h string, host int, row string")
    out = url_filter.judged(pages)
    assert out.columns == ["page_id", "url", "_h", "host", "row", "_host", "_path", "_rule", "_verdict", "_trust", "_distrust"]
    assert sorted((r.page_id, r._host, r._verdict) for r in out.collect()) == [(1, "x.com", "block"), (1, "x.com", "block"), (2, "long.com", "block"), (3, "", "allow"), (4, "", "allow")]
    assert url_filter.judged(pages.limit(0)).count() == 0


@pytest.mark.parametrize("query", ["op6_html_extraction", "op7_url_filter", "op10_warc"])
def test_pages_repeated_and_none(spark, query):
    op = {"op6_html_extraction": html_extract.op6, "op7_url_filter": url_filter.op7, "op10_warc": warc.op10}[query]
    assert query in queries.queries()
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>" + "some text " * 30, "x", "y"), (1, "http://a.com/", "<p>" + "some text " * 30, "x", "y"), (2, "http://b.com/", "<p>" + "some text " * 30, None, None), (3, None, None, None, None)], "page_id long, url string, html string, text string, digest string")
    rows = op(spark, pages).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 2, 3]
    assert op(spark, pages.limit(0)).count() == 0


class Plain(HTMLParser):
    """A tree of [tag, items] from well-formed markup, by the standard library."""

    def __init__(self):
        super().__init__()
        self.top = ["#root", []]
        self.path = [self.top]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.path[-1][1].append(node)
        self.path.append(node)

    def handle_endtag(self, tag):
        assert self.path.pop()[0] == tag

    def handle_data(self, data):
        self.path[-1][1].append(data)


def nodes_below(node):
    for x in node[1]:
        if isinstance(x, list):
            yield x
            yield from nodes_below(x)


def counts(node, linked=False):
    """(characters, tags, link characters, link tags) of a node, each counted afresh from all that lies below."""
    c = t = lc = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            c, lc = c + n, lc + n * linked
        else:
            a = counts(x, linked or x[0] == "a")
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (x[0] == "a")
    return c, t, lc, lt


def density(node, ratio, linked=False):
    c, t, lc, lt = counts(node, linked or node[0] == "a")
    t, lt = max(1, t), max(1, lt)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
    inner = c / max(1, lc) * t / lt
    # A page without links has the base 1, to which there is no logarithm: its characters per tag count as they are.
    return c / t * max(0.0, math.log(inner, base)) if base > 1 else c / t


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        words = " ".join(rng.choice(["alpha", "be", "gamma", "delta"]) for _ in range(rng.choice([1, 3, 12, 40])))
        if kind < 0.35 or depth > 4:
            out.append(f"<p>{words}</p>")
        elif kind < 0.5:
            out.append(f"<h2>{words[:20]}</h2>")
        elif kind < 0.6:
            out.append("<ul>" + "".join(f'<li><a href="x">{w}</a></li>' for w in words.split()) + "</ul>")
        elif kind < 0.7:
            out.append(f"<blockquote>{words}</blockquote>")
        else:
            out.append(f"<div>{random_page(rng, depth + 1)}</div>")
    return "".join(out)


def test_densities_equal_a_second_computation():
    """Pages without marked articles or asides: the largest sum of child densities, the path's least density as threshold, all by definition."""
    rng = random.Random(21)
    for _ in range(150):
        page = "<html><body>" + random_page(rng) + "</body></html>"
        parser = Plain()
        parser.feed(page)
        body = parser.top[1][0][1][0]
        c, _, lc, _ = counts(body)
        ratio = lc / c if c else 0.0
        parent, inside = {}, {id(body): False}
        for x in [body, *nodes_below(body)]:
            for y in x[1]:
                if isinstance(y, list):
                    parent[id(y)], inside[id(y)] = x, inside[id(x)] or x[0] == "a"
        dense = {id(x): density(x, ratio, inside[id(x)]) for x in [body, *nodes_below(body)]}
        total = {id(x): sum(dense[id(y)] for y in x[1] if isinstance(y, list)) for x in [body, *nodes_below(body)]}
        mine = html_extract.tree(page)
        html_extract.measure(mine)
        order, stack = [], [mine.items[0].items[0]]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += [y for y in reversed(x.items) if isinstance(y, html_extract.Node)]
        theirs = [body, *nodes_below(body)]
        assert [x.tag for x in order] == [x[0] for x in theirs]
        assert all(abs(x.density - dense[id(y)]) < 1e-9 and abs(x.sum - total[id(y)]) < 1e-9 for x, y in zip(order, theirs, strict=True))
        best = max(total.values())
        if not best or sum(abs(v - best) < 1e-9 for v in total.values()) > 1:
            continue
        top = next(x for x in theirs if abs(total[id(x)] - best) < 1e-9)
        path = [top]
        while path[-1] is not body:
            path.append(parent[id(path[-1])])
        threshold = min(dense[id(x)] for x in path)
        keep = {id(top)}
        for below, x in zip(path, path[1:], strict=False):
            beside = [y for y in x[1] if isinstance(y, list)]
            held = [k for k, y in enumerate(beside) if y is below or counts(y)[0] and dense[id(y)] >= threshold]
            keep |= {id(beside[k]) for k in held if beside[k] is not below}
            keep |= {id(y) for k, y in enumerate(beside) if y is not below and held[0] < k < held[-1] and y[0] == "h2"}
        said, stack = [], [body]
        while stack:
            x = stack.pop()
            if id(x) in keep:
                said += [" ".join(t.split()) for t in texts(x)]
            else:
                stack += [y for y in reversed(x[1]) if isinstance(y, list)]
        assert html_extract.extract(page).split("\n") == [t for t in said if t]


def texts(node):
    """One text per block: here every element with text of its own but links."""
    for x in node[1]:
        if isinstance(x, str):
            yield x
        elif x[0] == "a":
            yield x[1][0]
        else:
            yield from texts(x)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep" + "</p></section></b>" * 100_000,
        "<b>" * 50_000 + "<div>" + "x</b>" * 50_000,
        "<b>" * 50_000 + "<h1>" * 50_000 + "x",
        "<b>" * 50_000 + "<header>" * 3 + "<li>x" * 50_000,
        "<a " + "x" * 3_000_000 + "<p>",
        "<table>" + "<tr><td>x" * 50_000,
        "<script>" * 50_000,
        "<" * 500_000,
        "&amp;" * 200_000 + "<!-- " * 1000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    assert isinstance(html_extract.extract(page), str)
    assert time.time() - began < 8


def test_the_archive_is_read_once(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i % 5) + "payload " * (20 if i % 3 else 20_000)) for i in range(60)], "page_id long, url string, html string")
    path = shared_path(spark, "once")
    warc.write_archive(pages, path)
    out = warc.reassembled(spark, path)
    drop_path(spark, path)
    assert {r.page_id: r.payload_bytes for r in out.collect()} == {r.page_id: len(r.html) for r in pages.collect()}


def test_warc_segments_that_end_in_line_ends():
    """Files cut at double line ends as the text reader cuts them, with blocks whose last segments are of every small size."""
    for n in range(60, 140):
        files = []
        for name in ("a", "b"):
            records = list(warc.page_records(name, 1, "http://a/b", b"x" * n, "d", None, 64, 50))
            pieces = "".join(r + warc.END for r in records).split(warc.END)
            files += [p.encode() for p in (pieces if pieces[-1] else pieces[:-1])]
        found = list(warc.split_records(iter(files)))
        assert len(found) == 2 * len(records)
        body = b"".join(block for _, block in found[: len(records)])
        assert warc.dechunked(body.partition(warc.BEND)[2]) == b"x" * n


def test_warc_reads_a_file_that_ends_in_a_short_segment(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([(1, "http://a/b", "x" * 90)], "page_id long, url string, html string").coalesce(1), path, segment=64, chunk=50)
    assert [r.payload for r in warc.reassembled(spark, path).collect()] == ["x" * 90]


@pytest.mark.parametrize("text", [" " * 1_500_000, "a" + "\n" * 1_500_000 + "x", "see\u3000<|endoftext|>" + " \t\u2003" * 500_000 + "<|endoftext|>" + " " * 3000 + "b  c" + "\r\n" * 2000 + "'s", "x" * 1_500_000])
def test_ids_of_texts_too_long_for_the_pattern(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    e = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(e(text), "<u4").tolist() == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    plain = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ())
    assert 50256 not in np.frombuffer(plain(text), "<u4")


def test_cutting_at_white_space_changes_no_ids():
    import public_tokenizers as P

    e = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for space in (" ", "\n", " \n", "\u2003 ", "\x85"):
        for tail in ("", "x", "'s", "\x1c", " ", "9 "):
            text = "ab  c" + space * 1500 + tail + space * 1000
            assert e._cut(text) == e._encode(text)


def test_bands_are_the_same_however_few_hits_are_listed(monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    passages = [(k, word(rng.choice([30, 60, 200]))) for k in range(20)] + [(20, "a" * 60)]
    p = decontaminate.Passages(passages, 8, 0.1)
    texts = [word(300) + t + word(300) for _, t in passages] + ["a" * 900 + word(200), word(3000), "", "a"]
    want = [sorted(p.regions(decontaminate.normalise(t)[0])) for t in texts]
    found = decontaminate.matches(texts, p)
    assert all(k in {m[0] for m in found[k]} for k in range(20))
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert [sorted(p.regions(decontaminate.normalise(t)[0])) for t in texts] == want
    assert decontaminate.matches(texts, p) == found


def test_wording_that_all_passages_share_costs_a_text_little():
    """4,000 passages begin alike, and a text holds nothing but that beginning, 50,000 times: 10 ** 9 pairs of places."""
    rng = random.Random(4)
    p = decontaminate.Passages([(k, "Question number: " + "".join(rng.choice("abcdefgh") for _ in range(100))) for k in range(4000)], 8, 0.1)
    began = time.time()
    assert decontaminate.matches(["Question number: " * 50_000], p) == [[]] and time.time() - began < 20


def test_shards_do_not_depend_on_the_number_of_blocks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, "b").alias("source"))
    of = lambda block: sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, 8, block=block).collect())
    few = of(20_000)
    assert of(2) == few and sorted(s for _, k, s in few if k == 0) == list(range(375))
