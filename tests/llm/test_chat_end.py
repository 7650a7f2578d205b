"""Texts that hold only the end string are escaped as OP8_SQL says."""

import duckdb

from sparrowdex.llm import chat


def test_a_lone_end_is_escaped_as_in_sql(spark):
    texts = ["hello <|im_end|> world", "<|im_end|>\n", "<|im_end|>", "a<|im_end|>\n<|im_end|>\n", "\n\n<|im_end", "plain < | text", "x" * 30_000 + "<|im_end|>"]
    rows = [(i, k, "assistant" if k else "user", t) for i, t in enumerate(texts) for k in (0, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        said = sorted(con.execute(chat.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in chat.op8(spark, frame).collect()) == said
    for r in chat.format_turns(frame).collect():
        assert r.formatted.count(chat.END) == 2
