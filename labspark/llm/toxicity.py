"""Toxicity: Levenshtein automata over a lexicon trie, and context windows around the hits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_array
from .simhash import shingle_hashes

#: Labelled rows that a model is fitted on at most (by order of a hash of their id), and lexicon entries learnt.
TRAINING_ROWS, LEXICON = 20_000, 5_000
#: Characters on each side of a hit that are its context.
WINDOW = 80
#: Insults known beforehand; more are learnt from the labels.
SEED_TERMS = ("bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Words that report what someone said.
REPORTING = re.compile(r"\b(?:said|says|say|called|calls|wrote|writes|quoted?|reported|reports|word|term|phrase|sagte|schrieb|nannte|wort|dit|appel\w+|mot|dijo|llam\w+|palabra)\b")
ADDRESS = re.compile(r"\b(?:you|your|youre|u|du|dich|dein|ihr|tu|toi|vous|te|usted)\b")
QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]")
TOKEN = re.compile(r"[\w@$]+")
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("01345@$", "oieasas")
#: Bytes of words that a task remembers as looked up; it starts anew when there are more.
CACHE_BYTES = 32 << 20


class Levenshtein:
    """The automaton of all words within ``edits`` of ``word``.  A state is the row of edit counts that are still small enough."""

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        row: dict[int, int] = {}
        for i, cost in state:
            row[i] = min(row.get(i, 99), cost + 1)
            if i < len(self.word):
                row[i + 1] = min(row.get(i + 1, 99), cost + (self.word[i] != char))
        for i in sorted(row):
            if i < len(self.word) and row[i] + 1 < row.get(i + 1, 99) and row[i] < self.edits:
                row[i + 1] = row[i] + 1
        # The loop above may add places behind the last one it saw.
        last = max(row, default=0)
        while last < len(self.word) and row[last] < self.edits:
            row[last + 1] = row[last] + 1
            last += 1
        return tuple(sorted((i, c) for i, c in row.items() if c <= self.edits))

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits to the word in an accepting state, else None."""
        return next((c for i, c in state if i == len(self.word)), None)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Tries of terms, and stems that any ending may follow, each with its weight; the longest stem of a word counts."""

    def __init__(self, terms: list[str], stems: dict[str, float]) -> None:
        self.terms, self.stems = set(terms), stems
        self.stem_lengths = sorted({len(s) for s in stems}, reverse=True)
        # A word within e edits of a term keeps its first or last of e + 1 parts in place, or a middle one moved by a place.
        # Terms with a part in common share a trie; a word walks the tries of the parts that it has.
        self.heads: dict[str, dict] = {}
        self.tails: dict[str, dict] = {}
        self.middles: dict[tuple[str, int], dict] = {}
        for t in terms:
            edits = allowed_edits(t)
            if edits:
                cuts = [len(t) * i // (edits + 1) for i in range(edits + 2)]
                parts = [(t[x:y], x) for x, y in zip(cuts, cuts[1:], strict=False)]
                self._add(self.heads.setdefault(parts[0][0], {}), t)
                self._add(self.tails.setdefault(parts[-1][0], {}), t)
                for part, x in parts[1:-1]:
                    for move in (-1, 0, 1):
                        self._add(self.middles.setdefault((part, x + move), {}), t)
        self.head_lengths, self.tail_lengths = sorted({len(p) for p in self.heads}), sorted({len(p) for p in self.tails})
        self.middle_shapes = sorted({(len(p), x) for p, x in self.middles})
        self.lengths = {n for t in terms for n in range(len(t) - allowed_edits(t), len(t) + allowed_edits(t) + 1) if allowed_edits(t)}
        self.known: set[str] = set()
        self.held = 0
        self.found: dict[str, tuple[str, str, int]] = {}

    @staticmethod
    def _add(trie: dict, term: str) -> None:
        for c in term:
            trie = trie.setdefault(c, {})
        trie[""] = term

    def misspelt(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits: the automaton of the word and a trie advance together, and a branch
        ends where no state is left."""
        tries = [t for n in self.head_lengths if (t := self.heads.get(word[:n]))] + [t for n in self.tail_lengths if (t := self.tails.get(word[-n:]))]
        tries += [t for n, x in self.middle_shapes if (t := self.middles.get((word[x : x + n], x)))]
        best, automaton = None, Levenshtein(word, 2)
        todo = [(t, automaton.start()) for t in tries]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    d = automaton.distance(state)
                    if d is not None and d <= allowed_edits(child) and (best is None or (d, child) < best):
                        best = (d, child)
                elif following := automaton.step(state, c):
                    todo.append((child, following))
        return best and (best[1], best[0])

    def search(self, word: str) -> tuple[str, str, int] | None:
        """(kind, entry, edits) of a word: term, stem or misspelt."""
        if word in self.terms:
            return "term", word, 0
        for n in self.stem_lengths:
            if len(word) >= n and word[:n] in self.stems:
                return "stem", word[:n], 0
        plain = word.translate(LOOKALIKES)
        if plain != word and plain in self.terms:
            return "misspelt", plain, 1
        if len(plain) in self.lengths:
            near = self.misspelt(plain)
            if near:
                return "misspelt", *near
        return None

    def hits(self, words: list[str]) -> bool:
        """Looks every new word up; whether any is a hit."""
        if self.held > CACHE_BYTES:
            self.known, self.found, self.held = set(), {}, 0
        own = set(words)
        for w in own - self.known:
            self.known.add(w)
            self.held += len(w) + 100
            if hit := self.search(w):
                self.found[w] = hit
        return not own.isdisjoint(self.found)


#: terms, stems (by weight) and misspelt words used by the writer; hits within quotations or reports; hits that address someone; several; density.
FEATURES = ("bias", "terms", "stems", "misspelt", "quoted", "addressed", "several", "density")
PRIOR = np.array([-3.0, 1.0, 1.0, 0.3, -0.2, 0.3, 1.5, 0.3])


def features(text: str, lexicon: Lexicon) -> list[float]:
    lower = text.lower()
    words = TOKEN.findall(lower)
    if not words or not lexicon.hits(words):
        return [1.0] + [0.0] * 7
    counts = dict.fromkeys(("term", "stem", "misspelt", "quoted", "addressed"), 0.0)
    direct = 0
    quotes = [m.span() for m in QUOTED.finditer(lower)]
    for m in TOKEN.finditer(lower):
        hit = lexicon.found.get(m[0])
        if hit is None:
            continue
        a, b = max(0, m.start() - WINDOW), m.end() + WINDOW
        before, around = lower[a : m.start()], lower[a:b]
        in_quotes = any(x < m.start() and m.end() < y for x, y in quotes)
        if in_quotes or (REPORTING.search(before) and any(q in around for q in "\"“«„'")):
            counts["quoted"] += 1
        else:
            counts[hit[0]] += lexicon.stems[hit[1]] if hit[0] == "stem" else 1
            direct += hit[0] != "misspelt"
            counts["addressed"] += bool(ADDRESS.search(around))
    own = counts["term"] + counts["stem"]
    return [1.0, *(float(np.log1p(counts[k])) for k in ("term", "stem", "misspelt", "quoted", "addressed")), float(direct > 1), float(np.log1p(100 * own / len(words)))]


@dataclass
class Model:
    terms: list[str] = field(default_factory=lambda: list(SEED_TERMS))
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=PRIOR.tolist)


def regress(x: np.ndarray, y: np.ndarray, rounds: int = 30, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, held to the prior weights by a squared penalty."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A lexicon and weights from at most ``rows`` labelled documents.

    Entries are words, and beginnings that several words share, whose share of toxic documents is beyond chance for so many
    candidates.  Word counts are summed in Spark; at most ``LEXICON`` entries and ``rows`` short feature vectors reach the driver.

    Labels are those of the smallest hashes of their ids.  Rows without an id or a label don't train; null texts are empty ones.  Of near copies (equal least shingle
    hash and label) the one with the smallest id trains, of several texts of one id the one with the smallest hash; a document with contradictory labels
    trains once for each.  Without labels, or with labels of one kind only, nothing can be learnt: the model then is ``SEED_TERMS`` with prior weights.
    Terms of fewer than five letters are found as they are only, as nearly every short word is within an edit of another.
    """
    chosen = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [min(shingle_hashes(t, 5), default=0) & (1 << 63) - 1 for t in text_array(batch.column("text")).to_pylist()]
            yield batch.append_column("signature", pa.array(least, pa.int64()))

    joined = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most ``rows`` rows on the small side
    # Copies and near copies mostly share their least shingle hash; of each such group one row trains, else its words would all seem toxic.
    one_each = joined.mapInArrow(signed, "doc_id long, text string, label int, signature long").groupBy("signature", "label").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    train = durable(one_each.select("text", "label", "signature"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out, labels, marks = [], [], []
                for t, y, s in zip(text_array(batch.column("text"))[i : i + 64].to_pylist(), batch.column("label")[i : i + 64].to_pylist(), batch.column("signature")[i : i + 64].to_pylist(), strict=True):
                    own = set(TOKEN.findall(t.lower()))
                    out.extend(own), labels.extend([y] * len(own)), marks.extend([s] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.int32()), pa.array(marks, pa.int64())], ["word", "label", "signature"])

    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return Model()
    base_rate = F.lit(toxic / n)
    counts = train.mapInArrow(words, "word string, label int, signature long").groupBy("word").agg(F.sum("label").alias("pos"), F.count("*").alias("n"), F.min("signature").alias("low"), F.max("signature").alias("high"))
    counts = durable(counts)
    stems = counts.where("length(word) >= 5").select(F.explode(F.expr("transform(sequence(4, least(9, length(word) - 1)), k -> substring(word, 1, k))")).alias("word"), "pos", "n", "low", "high").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("words"), F.min("low").alias("low"), F.max("high").alias("high"))
    evidence = F.col("pos") * F.log(F.col("pos") / F.col("n") / base_rate)
    vocabulary = counts.where("n >= 2").count()
    beyond = (evidence >= float(np.log(max(vocabulary, 2)) + 4)) & F.col("word").rlike(r"^\p{L}{3,}")
    terms = [r[0] for r in counts.where(beyond & F.expr("pos >= 0.9 * n")).orderBy(F.desc("pos"), "word").limit(LEXICON).select("word").collect()]
    odds = F.log(F.col("pos") / F.greatest(F.col("n") - F.col("pos"), F.lit(0.5)) * (1 - base_rate) / base_rate)
    shared = stems.where(beyond & F.expr("words >= 5 and pos >= 0.5 * n and low < high")).orderBy(F.desc("pos"), "word").limit(LEXICON).select("word", odds).collect()
    model = Model(sorted({*SEED_TERMS, *terms}), {r[0]: float(r[1]) for r in shared})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.stems)
        for batch in batches:
            made = [features(t, lexicon) for t in text_array(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column("label"), batch.column("signature")], ["x", "label", "signature"])

    # Repeated ids may join more rows than were chosen; the vectors are short, so the driver's bound is kept here.
    rows_ = train.mapInArrow(vectors, "x array<double>, label int, signature long").orderBy("signature", "label").limit(rows).collect()
    model.weights = regress(np.array([r[0] for r in rows_]), np.array([r[1] for r in rows_], float)).tolist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``: the chance, from 0 to 1, that the whole text is toxic.

    Null and empty texts score as texts without hits.  All rows and columns stay (a column named ``to`` is replaced); no shuffle.
    """
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.stems)
        for batch in batches:
            texts = text_array(batch.column(text_col))
            values = [1 / (1 + np.exp(-np.clip(np.array(features(t, lexicon)) @ weights, -30, 30))) for i in range(0, len(texts), 128) for t in texts[i : i + 128].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, to])

    docs = docs.drop(to) if to in docs.columns else docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{to}` double")
