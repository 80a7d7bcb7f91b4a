"""Plain identifiers against the contract's patterns, disguised ones by examples, and time on awkward texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from labspark.llm import personal as p

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(x) <= 255 for x in found.split("."))
        if kind == 2:
            double = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted(((k, m.start(), m.end()) for k, pattern in enumerate(PATTERNS) for m in re.finditer(pattern, text) if good(k, m[0])), key=lambda s: (s[1], s[0]))


def test_plain_identifiers_of_random_texts():
    rng = random.Random(2)
    for alphabet in ("a@.b-", "1.2 ", "0123456789 -", "+12() .-", "a1@.+ -é", "4111 -"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert p.identifiers(text) == plain(text), text


def found(text):
    base = p.identifiers(text)
    return [(p.KINDS[k], text[a:b]) for k, a, b in p.disguised(text, base)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to john.smith [at] example [dot] com today", [("email", "john.smith [at] example [dot] com")]),
        ("é john(at)example.org.", [("email", "john(at)example.org")]),
        ("john dot smith at mail dot example dot com, please", [("email", "john dot smith at mail dot example dot com")]),
        ("anna_at_example_dot_de", [("email", "anna_at_example_dot_de")]),
        ("info@example[.]com", [("email", "info@example[.]com")]),
        ("ana arroba ejemplo punto es", [("email", "ana arroba ejemplo punto es")]),
        ("bob @ example.com", [("email", "bob @ example.com")]),
        ("јоhn@ехаmple.com", [("email", "јоhn@ехаmple.com")]),
        ("jo​hn@example.com", [("email", "jo​hn@example.com")]),
        ("john＠example．com", [("email", "john＠example．com")]),
        ("call plus four nine one seven one two three four five six seven now", [("phone", "plus four nine one seven one two three four five six seven")]),
        ("card four one one one 1111 1111 one one one one", [("card", "four one one one 1111 1111 one one one one")]),
        ("4111 1111 1111 llll", []),
        ("4111 l111 1111 1I11", [("card", "4111 l111 1111 1I11")]),
        ("host one nine two dot one six eight dot zero dot one", [("ip", "one nine two dot one six eight dot zero dot one")]),
        ("٤١١١١١١١١١١١١١١١", [("card", "٤١١١١١١١١١١١١١١١")]),
        ("look at this dot matrix printer", []),
        ("look at example.com, and meet me at the point of no return", []),
        ("one or two of the three (at most four) were six feet", []),
        ("john.smith@example.com and +1 (048) 555-4142", []),
        ("", []),
    ],
)
def test_disguised(text, want):
    assert found(text) == want


def test_given_documents_and_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = p.find(docs.withColumns({"n_ip": F.lit("x"), "spans": F.lit(1)})).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r.spans == ",".join(f"{p.KINDS[k]}:{a}:{b}" for k, a, b in want)  # nothing is disguised there
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a@b.c"), (2, "")], "doc_id long, text string")
    assert sorted(r.spans for r in p.find(odd).collect()) == ["", "", "", "email:0:5"]
    assert p.find(odd.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "@", "a@", "@a", "+1", "a.", "l1", "one ", "[at]", " at a", " dot ", "(", " ", "a_", "at_", "a@b.c1", "a [at] b.c1", "plus ", "double "])
def test_time_is_linear(unit):
    text = unit * (400_000 // len(unit))
    began = time.time()
    p.disguised(text, p.identifiers(text))
    assert time.time() - began < 8
