"""Block-bounded BM25 against plain Python, and how few blocks it reads."""

import math
import random
import re

from pyspark.sql import functions as F

from labspark.functions import scalar as S
from labspark.operators import retrieval


def _tokens(text):
    return [t for t in re.findall(r"[a-z0-9]+", (text or "").lower()) if t not in S.STOP_WORDS]


def _plain(docs, queries, k):
    texts = {d: _tokens(t) for d, t in docs}
    avg, n, out = sum(map(len, texts.values())) / len(texts), len(texts), set()
    df = {}
    for t in texts.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for q, query in queries:
        scores = []
        for d, t in texts.items():
            score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.4 / (t.count(w) + 1.4 * (0.25 + 0.75 * len(t) / avg)) for w in _tokens(query) if w in t)
            if score > 0:
                scores.append((-round(score, 9), -d))
        out |= {(q, -d, r) for r, (_, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def _corpus(n=3000):
    rng, words = random.Random(5), [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice([3, 9, 30, 120])))) for i in range(n)]
    docs += [(n + i, "w0 w0 w0 w1") for i in range(40)] + [(n + 40, ""), (n + 41, None)]  # ties, and texts without terms
    queries = [(q, " ".join(rng.choices(words, k=4)) + " w0") for q in range(25)] + [(90, "w0 w0 w1"), (91, "absent"), (92, ""), (93, None)]
    return docs, queries


def test_equals_plain_ranks(spark):
    docs, queries = _corpus()
    frame, asked = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "qid int, query string")
    index = retrieval.ranked_index(frame, "id", block=32)
    got = {(r.qid, r.id, r["rank"]) for r in retrieval.search(index, asked, "qid", k=5).collect()}
    assert got == _plain(docs, queries, 5)
    assert got == {(r.qid, r.id, r["rank"]) for r in retrieval.bm25(frame, asked, "id", "qid", k=5).collect()}


def test_few_blocks_are_read_of_texts_on_many_subjects(spark):
    rng, docs = random.Random(3), []
    for i in range(3000):
        subject = i % 60
        docs.append((i, " ".join(rng.choices([f"s{subject}x{j}" for j in range(8)], k=rng.choice([3, 9, 30])) + rng.choices(["alpha", "beta", "gamma"], k=5))))
    queries = [(q, f"s{q}x1 s{q}x2 alpha beta") for q in range(0, 60, 3)]
    frame, asked = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "qid int, query string")
    index = retrieval.ranked_index(frame, "id", block=32)
    assert {(r.qid, r.id, r["rank"]) for r in retrieval.search(index, asked, "qid", k=5).collect()} == _plain(docs, queries, 5)
    terms = retrieval._asked_terms(asked, "qid", "query", [])
    read = retrieval.live_cells(index, terms, "qid", 5).join(terms, "qid").join(index.blocks, ["term", "cell"]).count()
    assert read < terms.join(index.blocks, "term").count() / 2


def test_bounds_hold_and_blocks_are_small(spark):
    docs, _ = _corpus(1000)
    index = retrieval.ranked_index(spark.createDataFrame(docs, "id int, text string"), "id", block=32)
    rows = index.blocks.select("top", F.array_max("entries.w").alias("most"), F.size("entries").alias("n")).collect()
    assert all(r.top == r.most for r in rows) and max(r.n for r in rows) <= 32


def test_owners_are_apart(spark):
    rng = random.Random(9)
    docs = [(i, f"o{i % 3}", " ".join(rng.choices("abcdefghij", k=rng.randint(1, 12)))) for i in range(300)]
    queries = [(q, f"o{q % 4}", " ".join(rng.choices("bcdefgh", k=3))) for q in range(12)]
    frame, asked = spark.createDataFrame(docs, "id int, who string, text string"), spark.createDataFrame(queries, "qid int, who string, query string")
    got = {(r.qid, r.id, r["rank"]) for r in retrieval.search(retrieval.ranked_index(frame, "id", owner="who", block=16), asked, "qid", k=3).collect()}
    want = set()
    for o in ("o0", "o1", "o2"):
        want |= _plain([(d, t) for d, w, t in docs if w == o], [(q, t) for q, w, t in queries if w == o], 3)
    assert got == want


def _found(docs, asked):
    return [(r.id, r["rank"]) for r in retrieval.search(retrieval.ranked_index(docs, "id"), asked, "qid").collect()]


def test_no_texts_and_rows_of_one_key(spark):
    asked = spark.createDataFrame([(1, "iron")], "qid int, query string")
    assert _found(spark.createDataFrame([], "id int, text string"), asked) == []
    twice = spark.createDataFrame([(1, "iron low"), (1, "iron iron iron stores low"), (2, "sleep")], "id int, text string")
    assert _found(twice, asked) == [(1, 1)]


def test_scores_are_added_up_where_a_text_lies(spark, monkeypatch, tmp_path):
    """Pairs of a query and a text, nearly all of them, are not sent to other tasks; the ranks do not depend on the number of tasks."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40) if (i * 7 + j * j) % 5 < 2)) for i in range(300)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{(q * 3 + j) % 40}" for j in range(6))) for q in range(25)], "q long, query string")
    asked.write.parquet(str(tmp_path / "asked"))  # a file tells its size: few queries are broadcast
    asked = spark.read.parquet(str(tmp_path / "asked"))
    got = []
    for size in (200_000, 100):
        monkeypatch.setattr(retrieval, "POSTINGS", size)
        found = retrieval.bm25(docs, asked, "id", "q")
        assert not re.search(r"hashpartitioning\(q#\d+L, id#", found._jdf.queryExecution().executedPlan().toString())
        got.append(sorted(map(tuple, found.selectExpr("q", "id", "rank", "round(score, 9)").collect())))
    assert got[0] == got[1] and len(got[0]) == 100


def test_postings_are_shuffled_once(spark, monkeypatch):
    """Terms are counted within a text's row, without a shuffle; the blocks are made where their cell's texts lie."""
    plans, own = {}, retrieval.write_zone

    def kept(df, path, *more):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return own(df, path, *more)

    monkeypatch.setattr(retrieval, "write_zone", kept)
    index = retrieval.ranked_index(spark.createDataFrame([(1, "b a b"), (2, "c"), (3, None), (4, "")], "id int, text string"), "id", block=1)
    assert "Exchange" not in plans["texts"] and plans["blocks"].count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(cell" in plans["blocks"]
    assert sorted((r.term, len(r.entries), r.entries[0].length) for r in index.blocks.collect()) == [("b", 1, 2), ("c", 1, 1)]  # "a" is a stop word
