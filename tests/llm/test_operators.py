"""Each training-data operator against a brute-force version on small tables, and on rows of every awkward kind."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from labspark.llm import ann, byte_bpe, common, components, exact, packing, queries, sharding, simhash, substring, suffix_array, toxicity, warc
from labspark.llm.common import ordered_chunks

SPACES = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Given documents, and after them nulls, blanks, ties, repeated rows, long texts and clashing extra columns."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    random.seed(5)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(300)]
    passage = " ".join(random.choice(words) for _ in range(60))
    more = [None, "", " \n\t ", None, "one", "ONE", "o n e", "two words", "aaa" * 300, "aaa" * 300, passage, "x " + passage, passage + " tail\n" + passage, "日本語テキスト " * 40, "日本語 テキスト " * 40]
    more += [" ".join(random.choice(words) for _ in range(60_000))]
    more += [f"{passage} {random.choice(words)}" for _ in range(12)]
    extra = pd.DataFrame({"doc_id": [10_000 + i for i in range(len(more))], "text": more})
    frame = pd.concat([base, extra], ignore_index=True)
    rows = [(int(i), None if t is None else t, 1, "s", -1, "clash") for i, t in zip(frame.doc_id, frame.text, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string, rank int, chunk string").repartition(5)


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id and repeated rows."""
    return spark.createDataFrame([(None, "a b c"), (None, None), (1, "same text here"), (1, "same text here"), (2, "same  text here")], "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_every_operator_takes_empty_tables(empty, spark):
    for run in (byte_bpe.round_trip, simhash.near_duplicate_components, sharding.assign_shards, packing.pack, substring.remove_repeats, suffix_array.remove_repeats_by_index, exact.exact_groups, exact.drop_copies, simhash.drop_near_duplicates):
        assert run(empty).count() == 0, run
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_operator_takes_rows_without_ids_and_repeated_rows(odd):
    for run in (byte_bpe.round_trip, simhash.near_duplicate_components, sharding.assign_shards, packing.pack, substring.remove_repeats, suffix_array.remove_repeats_by_index, exact.exact_groups):
        assert run(odd).count() == 5, run
    assert exact.exact_groups(odd).where("doc_id = 2").first().keep_id == 2
    assert simhash.drop_near_duplicates(odd, words=2).count() == 4


# ---- toxicity ------------------------------------------------------------------------------------------------------


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_trie_search_equals_edit_distance():
    random.seed(2)
    terms = sorted({"".join(random.choice("abc") for _ in range(random.randint(3, 10))) for _ in range(60)})
    lexicon = toxicity.Lexicon(terms, {})
    for _ in range(3000):
        word = "".join(random.choice("abc") for _ in range(random.randint(1, 11)))
        near = [(d, t) for t in terms if (d := _edits(word, t)) <= toxicity.allowed_edits(t)]
        got = lexicon.search(word)
        assert (got and (got[2], got[1])) == (min(near) if near else None), word


def test_quotation_and_misspelling_are_told_apart():
    lexicon = toxicity.Lexicon(["idiot"], {"vermi": 1.0})
    names = toxicity.FEATURES
    direct, quoted, wrong, stem = (dict(zip(names, toxicity.features(t, lexicon), strict=True)) for t in ("you idiot", 'he said "what an idiot" aloud', "you idi0t", "verminous"))
    assert direct["terms"] > 0 and direct["addressed"] > 0 and not direct["quoted"]
    assert quoted["quoted"] > 0 and not quoted["terms"]
    assert wrong["misspelt"] > 0 and not wrong["terms"]
    assert stem["stems"] > 0


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_toxicity(spark, d).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held)


def test_toxicity_of_null_empty_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    model = toxicity.Model()
    texts = {1: None, 2: "", 3: long, 4: long + " you idiot, you idiot", 5: "x" * 300_000}
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    none = 1 / (1 + np.exp(-model.weights[0]))
    assert got[1] == got[2] == got[3] == got[5] == pytest.approx(none) and got[4] > got[3]


def test_fit_takes_odd_labels_and_does_not_depend_on_order(spark):
    """Repeated ids, contradictory and missing labels, null texts; the same model from any partitioning."""
    random.seed(12)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(random.choices(words, k=30)) + (" zornbraten grumpf" if i % 3 == 0 else "")) for i in range(600)] + [(7, "another text of seven"), (None, "zornbraten"), (601, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(600)] + [(9, 0), (9, 1), (10, None), (None, 1), (601, 0)]
    models = []
    for parts in (1, 7):
        docs = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
        models.append(toxicity.fit(docs, spark.createDataFrame(random.Random(parts).sample(labels, len(labels)), "doc_id long, toxic int").repartition(parts)))
    assert models[0].terms == models[1].terms and models[0].stems == models[1].stems and np.allclose(models[0].weights, models[1].weights)
    assert {"zornbraten", "grumpf"} <= set(models[0].terms)
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert one.terms == list(toxicity.SEED_TERMS) and one.weights == toxicity.PRIOR.tolist()


def test_toxicity_keeps_rows_and_clashing_columns(docs):
    scored = toxicity.score(docs, toxicity.Model())
    assert scored.columns == ["doc_id", "text", "n_chars", "rank", "chunk", "score"] and scored.count() == docs.count()


# ---- byte-level BPE ------------------------------------------------------------------------------------------------


def test_byte_bpe_equals_the_rank_library(docs, plain):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs).collect()}
    assert got.keys() == plain.keys()
    for k, t in plain.items():
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coder = byte_bpe.coder(path)
    random.seed(3)
    for _ in range(3000):
        t = "".join(random.choice("ab '-.\n\t  é日한😀1st　#") for _ in range(random.randint(0, 25)))
        ids = np.frombuffer(coder.encode_batch([t])[0], "<u4")
        assert ids.tolist() == own.encode_ordinary(t) and coder.decode_text(ids) == t
        assert all(t[a:b] for a, b in coder.offsets(t))


def test_split_characters_decode(spark):
    coder = byte_bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = np.frombuffer(coder.encode_batch(["𓀀"])[0], "<u4")
    assert len(ids) > 1 and coder.decode(ids) == "𓀀".encode() and "�" in coder.decode_text(ids[:1])
    rows = byte_bpe.encode(spark.createDataFrame([(1, "𓀀 x"), (2, None)], "doc_id long, text string"), offsets=True)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[2].ids == [] and max(got[1].end) == 3
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(rows).collect()} == {1: "𓀀 x".encode(), 2: b""}


# ---- SimHash --------------------------------------------------------------------------------------------------------


def _union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def _print(text, k=4):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(docs, plain):
    short = docs.where(F.length("text") < 20000)
    texts = {k: t for k, t in plain.items() if t is not None and len(t) < 20000}
    prints = {k: _print(t) for k, t in texts.items()}
    want = _union(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicate_components(short).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].fingerprint == f"{p:016x}" for k, p in prints.items())


def test_vantage_point_trees_miss_no_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for x in base[:500]]
    dense = [int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)]
    prints = sorted({*map(int, base), *near, *dense})
    values = np.array(prints, np.uint64)
    rows = spark.createDataFrame([(int(p), i) for i, p in enumerate(values.view(np.int64))], "print long, rep long")
    links = simhash.candidate_links(rows, simhash.block_masks(3), 1, 4, leaf=64)
    want = _union(range(len(values)), [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4) if j > i])
    pairs = [(r.a, r.b) for r in links.collect()]
    assert _union(range(len(values)), pairs) == want
    assert len(pairs) < 12 * len(values)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {n: c for n, c in want.items() if c != n or c in {v for k, v in want.items() if k != v}}


def test_near_duplicates_by_similarity(spark):
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows, want = [], set()
    for i in range(120):
        text = [random.choice(words) for _ in range(random.randint(40, 300))]
        rows.append((10 * i, " ".join(text)))
        want.add(10 * i)
        copy = list(text)
        copy[len(copy) // 2] = "changed"  # five shingles of at least 36 differ
        if len(text) >= 60:
            rows.append((10 * i + 1, " ".join(copy)))
        rows.append((10 * i + 2, " ".join(random.sample(text, len(text)))))
        want.add(10 * i + 2)
    rows += [(5000, None), (5001, ""), (5002, "!")]
    want |= {5000, 5001, 5002}
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got
    assert len(got - want) <= 1


def test_near_duplicates_among_many_variants(spark):
    """Whatever a crowded neighbourhood's representative stands for, similar texts in it meet."""
    rng = np.random.default_rng(3)
    prints = np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    prints = np.unique(prints)
    texts = [" ".join(f"w{i // 2}x{j}" for j in range(30)) for i in range(len(prints))]  # 2k and 2k + 1 are equal, others have nothing in common
    order = rng.permutation(len(prints))
    rows = spark.createDataFrame([(int(p), int(p), 26, int(i)) for p, i in zip(prints.view(np.int64)[order], range(len(prints)), strict=True)], "print long, second long, size long, rep long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(i + 1, i) for i in range(0, len(prints) - 1, 2)}
    for budget in (1 << 22, 3000):  # the second one splits the shards into blocks
        links = simhash.similar_links(docs, rows, spark.createDataFrame([], "a long, b long"), 5, 0.8, 18, simhash.sampled_masks(12, 10), budget=budget).collect()
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in links} == want


def _similar_groups(texts, similarity=0.8, words=5):
    """Components of all pairs whose sets of word shingles are similar, by rarest-shingle prefixes."""
    sets = {k: set(simhash.shingle_hashes(t or "", words)) for k, t in texts.items()}
    often, met, pairs = Counter(h for s in sets.values() for h in s), defaultdict(list), set()
    for k in sorted(sets):
        rare = sorted(sets[k], key=lambda h: (often[h], h))
        for h in rare[: len(rare) - int(np.ceil(similarity * len(rare))) + 1]:
            pairs |= {(o, k) for o in met[h]}
            met[h].append(k)
    return _union(sets, [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])])


def test_near_duplicates_equal_all_pairs(spark):
    """On the given documents, each group of similar texts keeps one, and nothing else goes."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    groups = _similar_groups({r.doc_id: r.text for r in rows.collect()})
    got = {r.doc_id for r in simhash.drop_near_duplicates(rows).collect()}
    want = set(groups.values())
    assert want <= got and len(got - want) <= 0.02 * (len(groups) - len(want))


def test_near_duplicates_at_the_stated_similarity(spark):
    """Of 3,000 pairs of similarity 0.80 to 0.85, of 45 to 366 shingles, among 6,000 fingerprints, 98.5 % or more are found."""
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        k = rng.randint(2, 6)  # words changed, five shingles each
        shingles = rng.randint(45 * k, 61 * k)
        text = [f"{rng.getrandbits(40):x}" for _ in range(shingles + 4)]
        copy = list(text)
        for j in range(k):
            copy[4 + (shingles - 5) * j // k] = "changed"
        sets = [{tuple(t[j : j + 5]) for j in range(shingles)} for t in (text, copy)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id").collect()}
    assert {2 * i for i in range(3000)} <= got
    found = 6000 - len(got)
    print(f"recall {found / 3000:.4f}")
    assert found >= 0.985 * 3000


@pytest.mark.parametrize(("rows", "least"), [(10_000, 10), (10_000_000, 16), (10_000_000_000, 26)])
def test_the_search_plan_keeps_its_recall_at_every_size(rows, least):
    """Simulated pairs at similarity 0.8 are within reach on one of the planned masks, 98.5 % or more of them, however many rows there are."""
    bits, count = simhash.search_plan(rows, 0.8)
    assert bits >= least
    rng = np.random.default_rng(rows)
    differing = rng.random((4000, 64)) < np.arccos(1.6 / 1.8) / np.pi
    found = np.zeros(4000, bool)
    for mask in simhash.sampled_masks(count, bits):
        found |= differing[:, [i for i in range(64) if mask >> i & 1]].sum(axis=1) <= 1
    assert found.mean() >= 0.985


def test_a_shard_is_searched_whole():
    """The tree within a shard loses no pair, on its mask or, where that leaves a leaf too large, on the other bits."""
    rng = np.random.default_rng(11)
    mask = (1 << 21) - 1
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    base[:1500] = base[0] & np.uint64(mask) | base[:1500] & np.uint64(simhash.FULL ^ mask)  # half of them alike on the mask
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(3000)], np.uint64)
    prints = np.unique(np.concatenate((base, base ^ flips)))
    meet = set()
    for at, home in simhash.subleaves(prints, np.ones(len(prints), bool), [(mask, 1), (simhash.FULL ^ mask, 4)], 64):
        for i in at[home].tolist():
            near = at[np.bitwise_count(prints[at] ^ prints[i]) <= 4]
            meet |= {(min(i, j), max(i, j)) for j in near.tolist() if j != i}
    want = {(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= 4) & (np.bitwise_count((prints ^ prints[i]) & np.uint64(mask)) <= 1)) if j > i}
    assert want <= meet and len(want) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    random.seed(seed)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, None), (None, None)]
    nodes = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    want = _union(nodes, [(a, b) for a, b in links if a is not None and b is not None and a != b])
    assert {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


# ---- sharding -------------------------------------------------------------------------------------------------------


def test_sharding_law(docs, plain, spark):
    got = sharding.assign_shards(docs).collect()
    assert len(got) == len(plain)
    for r in got:
        t = (plain[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.law == "key" and r.grown_shard in (r.shard, 8)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    counts = Counter((r.shard, r.grown_shard) for r in sharding.assign_shards(many).collect())
    assert all(2300 < sum(n for (s, _), n in counts.items() if s == k) < 2700 for k in range(8))
    assert 2000 < sum(n for (_, g), n in counts.items() if g == 8) < 2450


def test_weights_move_keys_only_in_their_subtree(spark):
    tree = sharding.even_tree(8)
    heavy = tuple(sharding.Shard(s.region, s.rack, s.number, 3.0) if s.number == 0 else s for s in tree)
    rows = spark.range(5000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b")).where("a <> b").collect()
    assert rows and all(r.b in (0, 1, 2, 3) for r in rows)
    assert all(r.b in (0, 1) for r in rows if r.a in (0, 1, 2, 3))


# ---- packing --------------------------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(docs, plain):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs, ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert pieces.keys() == plain.keys()
    for k, t in plain.items():
        ids = [i for p in sorted(pieces[k], key=lambda p: p.start) for i in p.ids]
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 2] and all(p.doc_tokens == len(ids) for p in pieces[k])
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert total == own[0].tier and total & (total - 1) == 0 and total <= 4096
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_group].add((r.sequence_id, r.tier))
    tokens = Counter()
    for s in steps.values():
        assert len({t for _, t in s}) == 1
        own = sum(t for _, t in s)
        assert own <= packing.STEP_TOKENS
        tokens[next(iter(s))[1]] += own < packing.STEP_TOKENS
    assert all(n <= 1 for n in tokens.values())  # one short step a tier, whatever the number of tasks
    assert max(Counter(r.doc_id for r in rows if r.doc_tokens < 2000).values()) <= 12


def test_word_coder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, coder = Tokenizer.from_file(path), packing.WordCoder(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|STARTOFTEXT|>", "É ̀ ßeİ.", "İ. İ, Iİ ıI.", "don't, it's. I'LL", "ΣΑΣ. σας, Ας", "日本語。 テキスト.", "K Å ﬁ.", "", " \n", "a" * 3000 + ". b"]
    random.seed(8)
    parts = ["İ", "ı", "é", "e", "́", "ß", ".", ",", " ", "'s", "a", "Ab", "Σ", "ς", "<|endoftext|>", "<|", "|>", "日", "ﬁ", "1", "-", "\t", "\u00a0", "Ａ", "ʼn", "ǅ", "́."]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(1, 14))) for _ in range(6000)]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for t, got in zip(part, coder.encode(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    words, pieces = packing.WordCoder(public_tokenizers.path("word_bpe_49k.json")), byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for coder, encode in ((words, words.encode), (pieces, pieces.encode_batch)):
        for i in range(20):
            encode([" ".join(f"w{i}x{j}" for j in range(50)) + " " + "long" * 5000])
            assert sum(map(len, coder.cache)) < 40_000 and max(map(len, coder.cache)) <= 256 and coder.held >= 0


# ---- substring dedup ------------------------------------------------------------------------------------------------


def test_substring_dedup(docs, plain):
    n = 13
    words = {k: [w for w in SPACES.split(t or "") if w] for k, t in plain.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - n + 1):
            first.setdefault(tuple(words[k][i : i + n]), k)
    got = {r.doc_id: r for r in substring.remove_repeats(docs, keep_text=True).collect()}
    assert got.keys() == words.keys()
    for k, w in words.items():
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < k for j in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        r = got[k]
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert {j for s in r.spans for j in range(s.start, s.end)} == gone


# ---- suffix-array dedup ---------------------------------------------------------------------------------------------


def _repeated_bytes(texts, n):
    seen, out = set(), {}
    for k in sorted(texts):
        data, gone = (texts[k] or "").encode(), np.zeros(len((texts[k] or "").encode()) + 1, int)
        for i in range(len(data) - n + 1):
            w = data[i : i + n]
            if w in seen:
                gone[i] += 1
                gone[i + n] -= 1
            else:
                seen.add(w)
        out[k] = (data, np.cumsum(gone)[:-1] > 0)
    return out


def test_suffix_array_dedup(docs, plain):
    want = _repeated_bytes(plain, 100)
    got = {r.doc_id: r for r in suffix_array.remove_repeats_by_index(docs, keep_text=True).collect()}
    assert got.keys() == want.keys()
    for k, (data, gone) in want.items():
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        edges = np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 5000


def test_run_length_index(spark):
    random.seed(1)
    n = 12
    for _ in range(150):
        alphabet = random.choice(["ab", "abc", "abcdefgh"])
        base = "".join(random.choice(alphabet) for _ in range(60))
        texts = []
        for _ in range(random.randint(1, 12)):
            a = random.randint(0, 30)
            t = list(base[a : a + random.randint(n, 30)])
            t[random.randrange(len(t))] = random.choice(alphabet)
            texts.append("".join(t))
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1) - 1
        data = ("\0".join(texts) + "\0").encode()
        index = suffix_array.RunLengthIndex.build(np.frombuffer(data, np.uint8), ends)
        places = np.concatenate([np.arange(s, e - n + 1) for s, e in zip(ends - sizes, ends, strict=True)])
        found = index.earlier_matches(places, n)
        seen, want = set(), set()
        for s, e in zip(ends - sizes, ends, strict=True):
            for i in range(s, e - n + 1):
                want |= {int(i)} if data[i : i + n] in seen else set()
                seen.add(data[i : i + n])
        assert {int(p) for p in places[found >= 0]} == want
        assert all(w < p and data[w : w + n] == data[p : p + n] for p, w in zip(places.tolist(), found.tolist(), strict=True) if w >= 0)


def test_matches_come_from_the_sampled_run_ends():
    """Repetitive texts make few runs, and results go wrong with the samples."""
    random.seed(4)
    base = "".join(random.choice("abcdefgh ") for _ in range(300))
    texts = [base[a:] + str(a) for a in range(0, 150, 3)]
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)
    places = np.concatenate([np.arange(s, e - 99) for s, e in zip(ends - sizes, ends, strict=True)])
    index = suffix_array.RunLengthIndex.build(data, ends)
    assert len(index.symbol) < len(data) / 10
    right = index.earlier_matches(places, 100)
    assert (right >= 0).sum() > 5000
    for field in ("head_sample", "tail_sample", "head_match"):
        broken = suffix_array.RunLengthIndex.build(data, ends)
        values = getattr(broken, field)
        values[:] = np.roll(values, 1)
        try:
            assert (broken.earlier_matches(places, 100) != right).any(), field
        except (ValueError, IndexError):
            pass


def test_suffix_array_dedup_of_repeated_ids(spark):
    """Rows of one id, and rows without one, follow each other by a hash of their text, in whatever order and partitions they come."""
    random.seed(6)
    words = ["".join(random.choice("abcdef") for _ in range(5)) for _ in range(500)]
    passages = [" ".join(random.choice(words) for _ in range(40)) for _ in range(5)]
    rows = [(random.choice([None, 1, 2, 3]), f"{i} {random.choice(passages)} {random.choice(words)} {random.choice(passages)}") for i in range(80)]
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.xxhash64("text").alias("tie")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))
    want = sorted((str(r.doc_id), len(data), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()) for r, (data, gone) in zip(order, _repeated_bytes({k: r.text for k, r in enumerate(order)}, 100).values(), strict=True))
    for seed, parts in ((1, 1), (2, 7), (3, 3)):
        shuffled = random.Random(seed).sample(rows, len(rows))
        got = suffix_array.remove_repeats_by_index(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize(("per_task", "most"), [(1 << 16, 90), (200, 100)])
def test_chunks_stay_near_their_target(spark, per_task, most):
    """With ids at both ends of the long range, an outlying one, dense and repeated ones and many missing ones; chunks numbered by one task and by several."""
    ends = [-(1 << 63), (1 << 63) - 1, 1 << 40]
    rows = [(i, "x" * 84) for i in [*ends, *range(3000), *([7] * 50)]] + [(None, f"{i:084d}") for i in range(1000)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string")
    chunked, count = ordered_chunks(docs, "doc_id", "text", 10_000, per_task=per_task)
    got = chunked.collect()
    assert len(got) == len(rows) and {r.chunk for r in got} <= set(range(count))
    sizes = Counter(r.chunk for r in got)
    assert max(sizes.values()) <= 160 and 40 <= len(sizes) <= most
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.tie, r.chunk) for r in got)
    assert [r[3] for r in ids] == sorted(r[3] for r in ids)
    assert len({r.chunk for r in got if r.doc_id == 7}) == 1
    assert len({r.chunk for r in got if r.doc_id is None}) > 5


def test_driver_gets_a_row_a_task(spark, monkeypatch):
    """Numbering chunks brings the driver a row a task of cells, not a row a cell."""
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("x" * 84).alias("text"))
    fetched, kind = [], type(docs)
    for name in ("collect", "toArrow", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, fetch=getattr(kind, name): fetched.append(len(got := fetch(self))) or got)
    shifts, levels = common._cells(docs, F.octet_length("text").cast("long") + 16, 10_000)
    known, n, count = common._numbered(levels, 10_000, 1000)
    assert n > 5000 and sum(fetched) <= n // 1000 + 10
    assert n == known.count() and known.select("chunk").distinct().count() == count and 200 <= count <= 230


def test_hash_collisions_remove_nothing(spark, monkeypatch):
    """Windows whose hashes meet are judged by digests of their words."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(6)] + [(6, " ".join(f"w2x{j}" for j in range(5, 30)))]
    texts = pa.array([t for _, t in rows], pa.large_string())
    table = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": texts, "tie": pa.array([0] * 7), "chunk": pa.array([0] * 7, pa.int32())})
    chunk = substring.Chunk(table, 13)
    chunk.hashes = chunk.hashes % np.uint64(5)  # as if nearly all hashes collided
    elsewhere, here = chunk.met(0, pa.table({"bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())}))
    assert here.all() and not elsewhere.any()
    values, inverse = np.unique(chunk.digests(np.flatnonzero(here)), return_inverse=True)
    assert len(values) == 6 * 28 and {tuple(sorted(chunk.row[inverse == k])) for k in range(len(values)) if (inverse == k).sum() > 1} == {(2, 6)}


# ---- exact dedup ----------------------------------------------------------------------------------------------------


def test_exact_groups(docs, plain):
    squeezed = {k: SPACES.sub("", t or "") for k, t in plain.items()}
    groups = defaultdict(list)
    for k, s in squeezed.items():
        groups[s].append(k)
    got = {r.doc_id: r for r in exact.exact_groups(docs).collect()}
    for k, s in squeezed.items():
        keep = min(groups[s], key=lambda i: (-len(plain[i] or ""), i))
        r = got[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[s]), k == keep, hashlib.sha256(s.encode()).hexdigest())
    assert {r.doc_id for r in exact.drop_copies(docs).collect()} == {k for k, r in got.items() if r.kept}


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "A text", 1), (5, "A text", 2), (6, "Atext", 3), (7, "AAAA", 4), (7, "BB", 5), (3, "BB", 6), (None, "C", 7), (None, "C", 7), (None, "C ", 8), (None, None, 9), (8, "", 10), (-(2**63), "D", 11), (2**63 - 1, "D", 12), (-(2**63), "E", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(4)
    got = sorted(((r.doc_id, r.text, r.keep_id) for r in exact.drop_copies(df).collect()), key=lambda r: r[2])
    assert got == [(5, "A text", 1), (7, "AAAA", 4), (3, "BB", 6), (None, "C ", 8), (8, "", 10), (-(2**63), "D", 11), (-(2**63), "E", 13)]
    ids = {(r.doc_id, r.keep_id) for r in exact.exact_groups(df).collect()}
    assert (2**63 - 1, -(2**63)) in ids and (-(2**63), -(2**63)) in ids
    assert exact.drop_copies(df.limit(0)).count() == 0
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    assert exact.drop_copies(many).count() == 1


def test_only_repeated_fingerprints_are_compared(spark):
    df = spark.createDataFrame([(k, f"text {k % 60}") for k in range(100)], "doc_id long, text string")
    narrow = spark.createDataFrame([(*reversed(exact.fingerprint(f"text{k % 60}".encode())),) for k in range(100)], "print long, length long")
    assert np.unpackbits(exact._repeated(narrow)).sum() == 40
    assert exact._repeated(narrow.limit(0)).sum() == 0
    assert {r.group_size for r in exact.exact_groups(df).collect()} == {1, 2}


def test_fingerprints_compose_and_collisions_part(monkeypatch, spark):
    data = bytes(random.Random(1).randbytes(200_001))
    for cut in (0, 1, 65_536, 70_000, 200_001):
        assert exact.combine(_whole(data[:cut]), _whole(data[cut:])) == _whole(data)
    assert exact.fingerprint(data) == (len(data), _whole(data)[1] << 31 | _whole(data)[2])
    rows = [(1, 3, b"abc"), (1, 3, b"abd"), (1, 3, b"abc"), (2, 3, b"abd")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["print", "length", "data"])
    out = pa.Table.from_batches(exact._differing(iter([batch]))).to_pylist()
    assert [(r["print"], r["sha"], r["variant"]) for r in out] == [(1, hashlib.sha256(b"abd").digest(), 1)]


def _whole(data):
    total = (0, 0, 0)
    for i in range(0, len(data), exact.CHUNK):
        total = exact.combine(total, exact.chunk_hash(data[i : i + exact.CHUNK]))
    return total


# ---- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 700
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, "short"), (4, "http://c/", "short"), (5, "http://d/\r\nX: y", None), (6, "http://e/", ""), (7, "http://f/", long), (8, "http://g/", long + "!"), (9, "u", "z"), (9, "u", "z"), (None, "v", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    all_rows = warc.captures(pages, f"{tmp_path}/a").collect()
    assert Counter(r.page_id for r in all_rows) == Counter(r[0] for r in rows)
    got = {r.page_id: r for r in all_rows}
    assert set(got) == {*range(1, 10), None}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 7, 2: 7}
    whole = {r.page_id: r for r in warc.assemble(warc.read_records(spark, f"{tmp_path}/a", payloads=True)).where("page_id < 9").collect()}
    assert bytes(whole[7].response.payload).decode() == long and whole[1].response.payload is None
    assert all(r.request is not None and r.metadata is not None for r in whole.values())


def test_large_captures_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_BYTES", 5000)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (10 + 1000 * (i % 8)) + str(i)) for i in range(80)], "page_id long, url string, html string")
    got = {r.page_id: r.payload_bytes for r in warc.captures(pages, f"{tmp_path}/b").collect()}
    assert got == {i: 10 + 1000 * (i % 8) + len(str(i)) for i in range(80)}
    assert len(list((tmp_path / "b" / "large").glob("*.gz"))) == 30
    assert all(r.response is not None and r.request is not None and r.metadata is not None for r in warc.assemble(warc.read_records(spark, f"{tmp_path}/b")).collect())


# ---- twins -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    """Each query with a DuckDB twin gives the twin's rows."""
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())


# ---- nearest neighbours ---------------------------------------------------------------------------------------------


def test_ann_recall_and_order(spark):
    d = "/root/testdata/sf0.1"
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    names, matrix = np.array(list(data)), np.array(list(data.values()))
    table = ann.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
    got = defaultdict(list)
    for r in table.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q in (i for i in data if i % 100 == 0):
        dist = np.sqrt(((matrix - data[q]) ** 2).sum(axis=1))
        order = [int(i) for i in np.lexsort((names, dist)) if names[i] != q][:10]
        found += len({int(names[i]) for i in order} & {v for _, v, _ in got[q]})
        total += 10
        assert [r for r, _, _ in got[q]] == list(range(1, 11)) and [(s, v) for _, v, s in got[q]] == sorted((s, v) for _, v, s in got[q])
        assert all(abs(s - np.linalg.norm(data[q] - data[v])) < 1e-9 for _, v, s in got[q])
    assert found / total >= 0.9


def test_ann_odd_vectors_and_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0]), (103, [None, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = ann.nearest(table, F.col("vec_id").isin(0, 29, 106, 100)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append(r.vec_id)
    assert by == {0: list(range(1, 11)), 29: list(range(10)), 106: list(range(10))}
    assert ann.nearest(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_ann_groups_and_blocks_lose_nothing(spark, monkeypatch):
    """Small groups and blocks, and cells larger than a group: the same rows as by comparing all."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(5)
    data = np.concatenate((rng.normal(0, 0.01, (300, 6)) + 1, rng.normal(0, 1, (300, 6))))
    data[-1] = data[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % 5 == 0, wanted=10_000).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 600, 5):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        assert got[q] == [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]


def test_ann_work_grows_less_than_by_all_pairs():
    """On clustered vectors, what all queries (one row in a hundred) visit grows with a power of the rows below 1.5."""
    rng, work, sizes = np.random.default_rng(1), [], (4_000, 64_000)
    for n in sizes:
        centres = rng.normal(0, 1, (n // 40, 16))
        data = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.05, (n, 16))
        sample = data[: ann.SAMPLE]
        first, second = (ann.lloyd(x, ann.centroids_for(n), 4, i) for i, x in enumerate((sample[:, :8], sample[:, 8:])))
        work.append(n / 100 * n * ann.visited_share(sample, first, second, 10))
    assert np.log(work[1] / work[0]) / np.log(sizes[1] / sizes[0]) < 1.5


def test_heap_visits_pairs_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    sums = [a[i] + b[j] for i, j in ann.cells_by_distance(a, b)]
    assert len(sums) == 35 and sums == sorted(sums)
