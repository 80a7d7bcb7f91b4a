"""Each stage of the pipeline, as run, against a brute-force version on its own input; and on rows of every awkward kind."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from labspark.llm import queries, toxicity

from .test_operators import SPACES, _repeated_bytes, _similar_groups

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and the rows that each stage leaves of its predecessor's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", {r.doc_id: r for r in docs.collect()})]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, rows if name == "packing" else {r.doc_id: r for r in rows}))
    return dict(out)


def test_columns_and_order(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    for name in list(stages)[:-1]:
        assert tuple(next(iter(stages[name].values())).asDict()) == corpus_pipeline.COLUMNS


def test_toxicity_stage(stages, spark):
    """What stays is what scores below the threshold, by the lexicon searched without tries or caches."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = queries.toxicity_model(spark, docs, DATA)
    weights = np.array(model.weights)

    class Plain(toxicity.Lexicon):
        def misspelt(self, word):
            near = [(d, t) for t in self.terms if (k := toxicity.allowed_edits(t)) and abs(len(t) - len(word)) <= k and (d := _edits(word, t, k)) <= k]
            return min(near)[::-1] if near else None

    lexicon = Plain(model.terms, model.stems)
    want = {k for k, r in stages["documents"].items() if 1 / (1 + np.exp(-np.clip(np.array(toxicity.features(r.text or "", lexicon)) @ weights, -30, 30))) < queries.THRESHOLD}
    assert set(stages["toxicity"]) == want
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [k for k, y in label.items() if not y and k in stages["documents"]]
    assert sum(k in want for k in clean) >= 0.99 * len(clean)


def _edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def test_exact_stage(stages):
    groups = defaultdict(list)
    for k, r in stages["toxicity"].items():
        groups[SPACES.sub("", r.text or "")].append(k)
    assert set(stages["exact_dedup"]) == {min(g, key=lambda k: (-len(stages["toxicity"][k].text or ""), k)) for g in groups.values()}


def test_near_stage(stages):
    before, after = stages["exact_dedup"], set(stages["simhash_near_dedup"])
    groups = _similar_groups({k: r.text for k, r in before.items()})
    kept = set(groups.values())
    assert kept <= after and len(after - kept) <= 0.1 * (len(before) - len(kept))


def test_passage_stage(stages):
    before, after = stages["simhash_near_dedup"], stages["suffix_array_dedup"]
    for k, (data, gone) in _repeated_bytes({k: r.text for k, r in before.items()}, 100).items():
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        got = after[k].text if k in after else ""
        assert "�" not in got or "�" in before[k].text
        if gone.any():
            assert got.encode() == _whole_characters(data, gone)
        else:
            assert got.encode() == kept or not re.search(r"[^\x20\x09-\x0D]", kept.decode())
        assert k not in after or after[k].n_chars == len(got)


def _whole_characters(data, gone):
    """Without each removed byte, and without what is left of a character that lost one; blank texts go."""
    out, i = b"", 0
    while i < len(data):
        n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        if not gone[i : i + n].any():
            out += data[i : i + n]
        i += n
    return out if re.search(rb"[^\x20\x09-\x0D]", out) else b""


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens, sequences = defaultdict(int), defaultdict(int)
    for r in stages["packing"]:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert tokens == {k: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in stages["suffix_array_dedup"].items()}
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sequences.values())


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, blanks, repeated rows and ids, a very long text, no rows at all, and columns that clash with the stages' own."""
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(30_000))
    rows = [(None, None, None, None, None), (None, "text without an id here", "en", None, 1), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \t\n", "en", "s", 3), (4, "same text twice", "en", "s", 15), (4, "same text twice", "en", "s", 15), (5, long, "en", "s", len(long)), (7, "another text of the same id", "en", "s", 5), (7, "and a third one of it", "en", "s", 5), (6, "x " + long, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for clash in ("score", "print", "chunk", "rank"):
            docs = docs.selectExpr("*", f"'clash' as {clash}")
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert name == "packing" or tuple(docs.columns) == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            counts.append(docs.count())
        if not own:
            assert counts == [0] * 5
        else:
            # Exact: null, empty and blank texts are one group, of which row 3 stays; of repeated rows all that share the kept id (or its lack) do.
            # Near: 6 is a copy of 5.  Passages: rows without words go.
            assert counts[:4] == [11, 9, 8, 6]
            assert {r.doc_id for r in docs.collect()} == {None, 4, 5, 7}
