"""Conversations, embeddings and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovelink.llm import ann, chat

TRICKY = "a <| b <!| c </s>[INST] [!/INST] <!!s> <||> \n <|end|>"


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", TRICKY, "x"), (1, 1, "assistant", TRICKY, "x"), (1, 1, "assistant", "tie", None),
        (1, 2, None, None, None), (2, 0, "assistant", "", None), (None, None, "user", "alone", None),
        (3, 0, "user", "same", None), (3, 0, "user", "same", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    done = chat.format_conversations(turns)
    back = done.select(
        "conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in back}
    assert got == {
        1: ([("user", TRICKY), ("assistant", TRICKY), ("assistant", "tie"), ("", "")], TRICKY + "tie"),
        2: ([("assistant", "")], ""),
        3: ([("user", "same")] * 2, ""),
        None: ([("user", "alone")], ""),
    }
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    def part(kind, text=None, ref=None, w=None, h=None, s=None, p=None):
        return (kind, text, ref, w, h, s, p)

    rows = [
        (1, 0, "user", [part("text", "see <|image|>"), part("image", None, "i.png", 28, 15), part("text", "é")]),
        (1, 1, "assistant", [part("text", "ok"), part("audio", None, "a.wav", s=1.5), part("document", None, "d.pdf", p=2)]),
        (1, 2, "user", [part("odd", None, "o"), part(None, "plain")]),
        (1, 3, "user", None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PART}")
    r = chat.format_conversations(turns, parts="parts").first()
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (1, "document", "d.pdf", 512), (2, "odd", "o", 1),
    ]
    assert r.expanded_tokens == 555 and r.n_turns == 4
    for a, mark in zip(r.attachments, ("<|image|>", "<|audio|>", "<|document|>", "<|attachment|>")):
        assert r.formatted[a.start : a.start + len(mark)] == mark
    assert [r.formatted[s.start : s.start + s.chars] for s in r.loss_spans] == ["ok"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    own = rng.normal(size=(1500, 16))
    own[700:1100] = own[700]  # a crowd of copies
    rows = [(i, [float(x) for x in v], "s") for i, v in enumerate(own)]
    odd = [(2000, None, "s"), (2001, [0.0] * 16, "s"), (2002, [float("nan")] * 16, "s"), (2003, [1.0], "s"),
           (2004, [None] * 16, "s"), (None, rows[0][1], "s"), (2020, [float("inf")] * 16, "s")]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string"), own


@pytest.mark.parametrize("probe,least", [(1.0, 1.0), (0.5, 0.9)])
def test_nearest(vectors, probe, least):
    table, own = vectors
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=10, probe=probe, centroids=8, shard_rows=256).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        scores = [0.0] * len(own)
        total = np.zeros(len(own))
        for d in range(16):
            total += own[q, d] * own[:, d]
        scores = total
        order = [i for i in np.lexsort((np.arange(len(own)), -scores)) if i != q][:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == scores[i] for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
        if probe == 1.0:
            assert [i for _, i, _ in found] == order
    assert hits >= least * 10 * len(got) and set(got) == set(range(0, 1500, 20))
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("count", [1, 2, 5, 21, 25, 40])
def test_nearest_of_few(spark, count):
    rng = np.random.default_rng(count)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(count)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    if count == 1:
        assert not got
    for q, own in got.items():
        assert len(own) == min(20, count - 1)


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(size=7)
    cells = ann.walk(a, b, np.ones(63), 63)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and sums == sorted(sums)


def test_pipeline_stages(spark, tmp_path):
    good = " ".join(f"word{i % 50}" for i in range(120))
    texts = [good, good.upper(), good + " tail", "mail me.1@mail.example.com now " + good[::-1], "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    ids = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, kept, folder).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert kept.columns == docs.columns
        ids.append(sorted(r.doc_id for r in kept.collect()))
    assert ids == [[1, 2, 3, 5], [1, 3, 5], [1, 3, 5], [1, 3, 5]]
