"""Alignment against the tokenizers' own libraries and plain loops over tokens."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparrowdex.llm import queries
from sparrowdex.llm import token_alignment as T
from sparrowdex.llm.packing import vocabulary
from sparrowdex.storage import materialise

SF = "/root/testdata/sf0.001"


def tokens(texts):
    """Per text the (id, bytes) of A and of B, none where the bytes differ."""
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in printable)}
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for text in texts:
        if not text:
            yield [], []
            continue
        one = [(i, bytes(of_char[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        same = all(b"".join(x for _, x in t) == (" " + text).encode() for t in (one, two))
        yield (one, two) if same else ([], [])


def plain(docs):
    held, count = [], collections.Counter()
    for (key, _), (a, b) in zip(docs, tokens([t for _, t in docs]), strict=True):
        i = j = x = y = 0
        links, groups, now = [], [], ([], [])
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = x + len(a[i][1]), y + len(b[j][1])
            if end_a <= end_b:
                now[0].append(a[i][0])
                i, x = i + 1, end_a
            if end_b <= end_a:
                now[1].append(b[j][0])
                j, y = j + 1, end_b
            if end_a == end_b:
                groups.append("|".join(",".join(map(str, s)) for s in now))
                now = ([], [])
        count.update(links)
        held.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((k, a, b, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(s.encode()).hexdigest() if s else "") for k, a, b, g, ls, s in held), key=repr)


def test_query_equals_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.queries()["op11_token_alignment"](spark, SF)
    assert [c for c, t in got.dtypes if t == "bigint"] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs)


ODD = ["x", " ", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ is a space in B", "é日本語🙂​", "ﬁ ligature Ⅷ", "\x00 nul", "a" * 5000, "…" * 50, "copy of a text", "　wide", "é"]


@pytest.mark.parametrize(("chunk_bytes", "batch_bytes"), [(1, 1), (700, 300), (16 << 20, 2 << 20)])
def test_odd_texts(spark, chunk_bytes, batch_bytes):
    """Nulls, empty and long texts, repeated rows and ids, texts that B does not give back, clashing names; chunks and batches of several sizes."""
    docs = [(k if k != 9 else None, t) for k, t in enumerate(ODD)] + [(50, None), (51, ""), (11, "copy of a text"), (None, None)] + [(60, "copy of a text")] * 30
    frame = spark.createDataFrame([(*d, 1, "n", b"l") for d in docs], "doc_id long, text string, chunk int, pair string, links binary").repartition(3)
    got = T.alignment(frame, chunk_bytes=chunk_bytes, batch_bytes=batch_bytes)
    want = plain(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[1] == 0 and r[0] is not None and r[0] < 50 for r in want)


def test_ends_over_several_spans(monkeypatch):
    monkeypatch.setattr(T, "SPAN", 7)
    rng = random.Random(1)
    a, b = (np.array(sorted(rng.sample(range(1, 99), n)) + [100]) for n in (20, 30))
    place, kind = T.ends_of(a, b)
    assert place.tolist() == sorted({*a.tolist(), *b.tolist()})
    assert kind.tolist() == [(p in a) + 2 * (p in b) for p in place]


def test_pair_counts_add_up(spark):
    docs = spark.createDataFrame([(1, "one two one two"), (2, "one two")], "doc_id long, text string")
    counts = T.pair_counts(materialise(T.aligned_chunks(docs, chunk_bytes=1), "chunks"), 32000).collect()
    want = collections.Counter()
    for a, b in tokens(["one two one two", "one two"]):
        want.update(zip([i for i, _ in a], [i for i, _ in b], strict=True))
    assert {(r.a, r.b): r["count"] for r in counts} == dict(want)


def test_links_survive_compression():
    for values in ([], [0], [1, 2**32 - 1, 70_000] * 100):
        assert T.released(T.squeezed(np.array(values, np.uint32)), len(values)).tolist() == values


def test_no_documents(spark):
    assert T.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in T.alignment(spark.createDataFrame([(7, None)], "doc_id long, text string")).collect()] == [(7, 0, 0, 0, 0, 0, 0, "")]


def test_vocabularies_are_those_of_the_files():
    """The rank file's tokens are the bytes of the tokenizers file's entries."""
    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    t = T.tokenizers(vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))
    assert t.a.tokens.to_pylist() == [ranks[i] for i in range(len(ranks))] and t.a.n == 50256 and t.b.n == 32000
