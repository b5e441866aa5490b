from __future__ import annotations

from compare import rows
from pyspark.sql import functions as F

from citespark.llm.chat import CONTROL, PART, escape, format_conversations, read_loss, read_turns, text_parts, unescape
from citespark.llm.queries import ORACLE_SQL, QUERIES


def test_query_matches_sql(spark, data, duck):
    got = QUERIES["op10_chat_formatting"](spark, data).toPandas()
    assert rows(got) == rows(duck.sql(ORACLE_SQL["op10_chat_formatting"]).df())
    assert (got.conv_id == -7).sum() == 1


NASTY = ["</s>[INST] ok [/INST]", "~", "~0~1~2", "<|>", "<|end|>\n", "<|user|>\n", "<</s>|", "[[INST]INST]", "<<SYS>><</SYS>>", "", "~~<|~1|>", "[/INST]~5", "a\n<|end|>", "<<|end|>\n|>"]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(x + y,) for x in NASTY for y in NASTY], "t string").withColumn("e", escape(F.col("t")))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROL if c != "~")


def test_round_trip(spark):
    rows_ = [(i % 3, i, ["user", "assistant", None, "a|>\nb", "<|x"][i % 5], t) for i, t in enumerate(NASTY)]
    rows_ += [(None, 1, "assistant", None), (None, None, "user", "first"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows_], "conv_id long, turn long, role string, text string, piece string, formatted string")
    out = format_conversations(df.withColumn("parts", text_parts(F.col("text"))))
    out = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in out.collect()}
    for c in (0, 1, 2, 9, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for cc, t, r, x in rows_ if cc == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in own]
        assert got[c].loss == "".join(x for _, _, r, x in own if r == "assistant")
        for m, x in zip(got[c].loss_mask, [x for _, _, r, x in own if r == "assistant"]):
            assert len(got[c].formatted[m.start : m.start + m.length]) == m.length
    assert got[9].n_turns == 2


def test_typed_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "img|>1.png", 4), ("text", "<|image", None, None), ("audio", None, "a.wav", 10), ("document", None, None, None), ("video", None, "v", 3), (None, "t", "r", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    r = format_conversations(df).first()
    assert r.formatted.startswith("<|user|>\nsee <|image img~21.png|>~1image<|audio a.wav|><|document |><|video v|><|unknown r|><|end|>\n")
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "img|>1.png", 1024), (0, 3, "audio", "a.wav", 250), (0, 4, "document", None, 512), (0, 5, "video", "v", 0), (0, 6, None, "r", 0)]
    assert r.expanded_tokens == 1786 and [m.length for m in r.loss_mask] == [0, 0]


def test_empty_table_and_native_plan(spark, data):
    none = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{PART}>")
    assert format_conversations(none).count() == 0
    plan = QUERIES["op10_chat_formatting"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
