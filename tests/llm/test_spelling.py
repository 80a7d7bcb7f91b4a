"""Spelling variants against all pairs, with keys that very many words share."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from labspark.llm import spelling
from labspark.llm.queries import op12_spelling_variants


def near(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] and k < len(a) if len(a) == len(b) else len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


def plain(counts, factor=5):
    forms, rows = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= factor * n else None
        rows[w] = len(others)
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, rows[w], counts[forms[w]] if forms[w] else None))
    return sorted(out)


def vocabulary(seed, alphabet, size, head=""):
    rng = random.Random(seed)
    return {head + "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10))): rng.choice([5, 6, 30, 200, 2000]) for _ in range(size)}


def test_variants_equal_all_pairs(spark):
    for counts, key_bytes in ((vocabulary(1, "abé", 500), spelling.KEY_BYTES), (vocabulary(2, "ab", 300, "prefix") | vocabulary(3, "abc", 200), 400), ({}, 10), ({"abcdef": 5}, 10), ({"a" * 300: 5, "a" * 301: 50, "a" * 299 + "b": 6}, 10)):
        df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumns({"key": F.lit(1), "before": F.lit("x")})
        got = sorted(tuple(r) for r in spelling.variants(df, key_bytes=key_bytes, bin_bytes=2000).collect())
        assert got == plain(counts)


def test_query_on_whole_texts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "Überfall überfall " * 5), (10**6, None), (10**6, "")], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode()) if r.doc_id is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert sorted((tuple(r) for r in op12_spelling_variants(spark, str(tmp_path)).collect())) == plain(counts)
