"""The prefix trie against a plain recursive version."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from labspark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, group=5, reach=9):
    """The contract in plain Python: rebuilt conversations, then a walk over the trie."""
    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % reach
        built[c] = tuple(own.get(c - c % group, [])[:h] + own[c][h:])
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    children = {n: [] for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    total = {}
    for n in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        total[n] = (1 if not children[n] else sum(total[k][0] for k in children[n]), saved + sum(total[k][1] for k in children[n]))
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), len(children[n]), *total[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == n))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def found(spark, rows, component=ct.COMPONENT, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        df = df.withColumns({c: F.lit(1) for c in ("conv", "d", "n1", "weight", "digest", "row")})
    turns = ct.ordered_turns(df)
    conv = F.col("conv")
    trie = ct.prefix_trie(*ct.splice(turns, base=conv - conv % 5, reach=F.crc32(conv.cast("string").cast("binary")) % 9, most=8), component)
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.collect())


def test_trie_of_shared_copied_and_long_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é" * 3, "", None, "long " * 40])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100 + c, t, "user", "the same") for c in range(40) for t in range(5)]  # copies of one conversation
    rows += [(7, 100 + t, "user", str(t % 3)) for t in range(300)] + [(8, 100 + t, "user", str(t % 3)) for t in range(300)]  # long ones that other tasks continue
    rows += [(None, 0, "user", "no conversation"), (3, None, "user", "null first"), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "user", "other")]
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, component=3, extra=True) == want  # nearly all splits by joins


def test_trie_of_little(spark):
    assert found(spark, []) == []
    rows = [(1, None, None, None)]  # its first turns belong to conversation 0, which is absent
    assert found(spark, rows) == plain(rows)


def test_rollup_equals_plain_sums():
    rng = random.Random(5)
    for n in (1, 2, 7, 60):
        for deep in (1, n):
            parents = [0] + [rng.randint(max(0, k - deep), k - 1) for k in range(1, n)]
            own = [rng.randint(0, 9) for _ in range(n)]
            want, weight = list(own), [1] * n
            for k in range(n - 1, 0, -1):
                want[parents[k]] += want[k]
                weight[parents[k]] += weight[k]
            assert ct._rollup(parents, weight, [own])[0] == want
