"""Chunks, BM25 and vector search over sets of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.io import durable, scratch, write_zone
from . import neighbours

K1, B = 1.4, 0.75
#: Postings that a task of ``bm25`` scores.
POSTINGS = 200_000
#: Terms asked of an index, and texts with their cell (16 bytes each), that are sent to every task; more meet in shuffles.
ASKED, TEXTS = 200_000, 1 << 22


def allowed(chunks: DataFrame) -> DataFrame:
    """Active and not internal; the default audience is the patient's."""
    return chunks.where((F.lower("status") == "active") & ~F.lower(F.coalesce("audience", F.lit("patient"))).isin("internal", "clinician-internal"))


def owned(records: DataFrame, owner: str, asking: Column) -> tuple[DataFrame, DataFrame]:
    """The records of the one who asks, and a count of others that were among them."""
    return records.where(F.col(owner) == asking), records.agg(F.count_if(F.col(owner) != asking).alias("foreign"))


def paragraph_chunks(docs: DataFrame, key: str, body: str = "body", title: Column | None = None, size: int = 700, compat: bool = False) -> DataFrame:
    """Paragraphs packed up to ``size`` characters, with the heading in force at a chunk's first paragraph (``compat``: at its end)."""
    start = F.struct(F.array().cast("array<struct<text:string,section:string>>").alias("done"), F.lit("").alias("current"), F.coalesce(title if title is not None else F.lit(None), F.lit("")).alias("section"), F.coalesce(title if title is not None else F.lit(None), F.lit("")).alias("heading"))

    def step(acc: Column, para: Column) -> Column:
        heading = F.when(para.startswith("#"), F.coalesce(F.nullif(F.regexp_replace(para, "^[# ]+", ""), F.lit("")), acc["heading"])).otherwise(acc["heading"])
        full = (acc["current"] != "") & (F.length(acc["current"]) + F.length(para) > size)
        label = heading if compat else acc["section"]
        done = F.when(full, F.array_append(acc["done"], F.struct(acc["current"].alias("text"), label.alias("section")))).otherwise(acc["done"])
        fresh = full | (acc["current"] == "")
        return F.struct(done.alias("done"), F.when(fresh, para).otherwise(F.concat(acc["current"], F.lit("\n\n"), para)).alias("current"), F.when(fresh, heading).otherwise(acc["section"]).alias("section"), heading.alias("heading"))

    paras = F.filter(F.transform(F.split(F.col(body), "\n\n"), F.trim), lambda p: p != "")
    end = lambda acc: F.when(acc["current"] != "", F.array_append(acc["done"], F.struct(acc["current"].alias("text"), (acc["heading"] if compat else acc["section"]).alias("section")))).otherwise(acc["done"])
    return docs.select(key, F.posexplode(F.aggregate(paras, start, step, end)).alias("chunk_no", "c")).select(key, "chunk_no", "c.section", "c.text")


def window_chunks(docs: DataFrame, key: str, text: str = "text", size: int = 600, overlap: int = 100) -> DataFrame:
    """Overlapping windows; blank ones are left out."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap)))
    rows = docs.where(F.length(text) > 0).select(key, text, starts.alias("start"))
    return rows.select(key, (F.col("start") / (size - overlap)).cast("int").alias("chunk_no"), F.substr(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk")).where("trim(chunk) <> ''")


def postings(docs: DataFrame, key: str, text: str = "text", owner: str | None = None) -> DataFrame:
    """term, key, tf, length (and owner) of each chunk; chunks without terms have none."""
    keep = [owner] if owner else []
    rows = docs.select(key, *keep, S.tokens(F.col(text)).alias("_t")).select(key, *keep, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return rows.groupBy(*keep, key, "length", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, key: str, text: str = "text", owner: str | None = None) -> DataFrame:
    """Number of chunks and their average length (per owner)."""
    keep = [owner] if owner else []
    return docs.select(*keep, F.size(S.tokens(F.col(text))).alias("length")).groupBy(*keep).agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


@dataclass
class SearchIndex:
    """Postings in blocks, written once: owner, ``term``, ``cell``, ``top`` (the block's largest weight) and ``entries`` (key, length, weight); and ``terms``, with
    the ``idf`` that all weights of a term are to be multiplied by."""

    blocks: DataFrame
    key: str
    keep: list[str]
    terms: DataFrame


def _counted(words: Column) -> Column:
    """The different terms of an array and how often each occurs, in the order of the terms."""

    def runs(t: Column) -> Column:
        words, starts = t["words"], t["starts"]
        return F.transform(starts, lambda p, i: F.struct(F.get(words, p).alias("term"), (F.coalesce(F.get(starts, i + 1), F.size(words)) - p).alias("tf")))

    def marked(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(words.alias("words"), F.filter(places, lambda p: (p == 0) | (F.get(words, p) != F.get(words, p - 1))).alias("starts"))

    return S.once(F.array_sort(words), lambda w: S.once(marked(w), runs))


def ranked_index(docs: DataFrame, key: str, text: str = "text", owner: str | None = None, block: int = 128) -> SearchIndex:
    """The BM25 weight of every posting, in blocks of one term and one cell of at most ``block`` texts.

    A cell is a run of texts ordered by their weightiest term and its weight, and is the same for all terms; so the sum of its blocks' largest weights bounds the
    score of every text in it, and texts about the same thing lie together, which keeps that bound low elsewhere.
    Rows that share a key and a length are one text; a text without terms has no posting.

    A text's terms are counted within its row, and a posting is shuffled once: to the task of its cell, which makes the cell's blocks.  Up to ``TEXTS`` texts learn
    their cell from a broadcast table, more by one shuffle more.
    """
    keep, spark = [owner] if owner else [], docs.sparkSession
    words = docs.select(key, *keep, S.tokens(F.col(text)).alias("_t")).select(key, *keep, F.size("_t").alias("length"), "_t")
    if not docs.groupBy(*keep, key).count().where("count > 1").isEmpty():
        words = words.groupBy(*keep, key, "length").agg(F.flatten(F.collect_list("_t")).alias("_t"))
    folder = scratch(spark, "postings")
    write_zone(words.select(key, *keep, "length", _counted(F.col("_t")).alias("terms"), F.monotonically_increasing_id().alias("_row")), f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    stats = durable(texts.groupBy(*keep).agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")))

    def described(rows: DataFrame) -> DataFrame:
        return rows.join(stats, keep) if keep else rows.crossJoin(F.broadcast(stats))  # without owners one row

    df = described(texts.select(*keep, F.explode("terms.term").alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("df")))
    write_zone(df.select(*keep, "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    # The order of texts needs no exact weights: only the terms that most texts have are looked at.
    common = F.broadcast(terms.orderBy(F.desc("df"), *keep, "term").limit(ASKED).select(*keep, "term", "idf"))
    found = described(texts.select("_row", *keep, "length", F.inline("terms"))).join(common, [*keep, "term"], "left")
    heads = found.groupBy("_row", *keep, "avg_length").agg(F.max(F.struct((F.col("idf") * weight).alias("w"), "term")).alias("_h"))
    order = [*map(F.col, keep), F.col("_h.term"), F.desc("_h.w"), F.xxhash64("_row")]
    # Row numbers of different partitions lie 2^33 apart, so a run never spans two.
    placed = heads.repartitionByRange(*order).sortWithinPartitions(*order)
    cells = durable(placed.select("_row", "avg_length", F.floor(F.monotonically_increasing_id() / block).alias("cell")))
    celled = texts.join(F.broadcast(cells) if cells.count() <= TEXTS else cells, "_row").repartition("cell")
    blocks = celled.select(*keep, "cell", key, "length", "avg_length", F.inline("terms")).select(*keep, "cell", "term", key, "length", weight.alias("w"))
    write_zone(blocks.groupBy(*keep, "term", "cell").agg(F.max("w").alias("top"), F.collect_list(F.struct(key, "length", "w")).alias("entries")), f"{folder}/blocks")
    return SearchIndex(spark.read.parquet(f"{folder}/blocks"), key, keep, terms.drop("df"))


def live_cells(index: SearchIndex, asked: DataFrame, query_key: str, k: int, probe: int = 4) -> DataFrame:
    """query, owner, cell: the cells that may hold one of a query's ``k`` best texts.

    The blocks' largest weights bound each cell's scores.  The ``k``-th best text of a query's ``probe`` most promising cells is as good as its ``k``-th best of all or worse, so
    cells bounded below it are never read; where those hold fewer than ``k`` texts all cells stay.
    """
    keep, asked = index.keep, _weighed(index, asked)
    tops = index.blocks.select(*keep, "term", "cell", "top")
    bounds = durable((F.broadcast(asked) if _few(asked) else asked).join(tops, [*keep, "term"]).groupBy(query_key, *keep, "cell").agg(F.sum(F.col("top") * F.col("times") * F.col("idf")).alias("bound")))
    first = Window.partitionBy(query_key, *keep).orderBy(F.desc("bound"), "cell")
    probed = bounds.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= probe).drop("_r", "bound")
    probed = F.broadcast(probed) if _few(asked) else probed  # at most ``probe`` rows for each query
    floor = _best(index, asked, probed, query_key, k, probing=True).where(F.col("rank") == k).select(query_key, *keep, F.col("score").alias("_floor"))
    # The margin is far above what the order of a sum or the rounding of ranks can move.
    return bounds.join(floor, [query_key, *keep], "left").where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - F.lit(1e-6))).select(query_key, *keep, "cell")


def _best(index: SearchIndex, asked: DataFrame, cells: DataFrame, query_key: str, k: int, probing: bool = False) -> DataFrame:
    """The ``k`` best texts of each query among those of its cells, which are a few for each query when ``probing``."""
    keep, key = index.keep, index.key
    wanted = asked.join(cells, [query_key, *keep])
    wanted = F.broadcast(wanted) if probing and _few(asked) else wanted  # at most a row for each asked term and cell
    read = wanted.join(index.blocks.select(*keep, "term", "cell", "entries"), [*keep, "term", "cell"])
    entries = read.select(query_key, *keep, "times", "idf", F.inline("entries"))
    texts = entries.groupBy(query_key, *keep, key, "length").agg(F.sum(F.col("w") * F.col("idf") * F.col("times")).alias("score")).where("score > 0")
    scored = texts.groupBy(query_key, *keep, key).agg(F.max("score").alias("score"))
    order = Window.partitionBy(query_key, *keep).orderBy(F.desc(F.round("score", 9)), F.desc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _weighed(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """The asked terms that the index holds, with their ``idf``, written once."""
    return asked if "idf" in asked.columns else durable(asked.join(index.terms, [*index.keep, "term"]))


def _few(asked: DataFrame) -> bool:
    return asked.count() <= ASKED


def _asked_terms(queries: DataFrame, query_key: str, query: str, keep: list[str]) -> DataFrame:
    return queries.select(query_key, *keep, F.explode(S.tokens(F.col(query))).alias("term")).groupBy(query_key, *keep, "term").agg(F.count("*").alias("times"))


def search(index: SearchIndex, queries: DataFrame, query_key: str, query: str = "query", k: int = 4) -> DataFrame:
    """The ``k`` best texts with a positive score of each query, exactly; of the index, only blocks that may still hold one of them are read whole."""
    asked = _weighed(index, _asked_terms(queries, query_key, query, index.keep))
    return _best(index, asked, live_cells(index, asked, query_key, k), query_key, k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", query: str = "query", k: int = 4, owner: str | None = None) -> DataFrame:
    """The ``k`` best chunks with a positive score of each query, ties to the higher key.

    A repeated query term counts repeatedly.  With ``owner`` both sides carry it and statistics are each owner's own, so a query
    never meets another owner's chunks.  Only postings of terms that queries have leave the first join.  One set of queries is answered in
    one pass over the texts; for many sets over the same texts see ``ranked_index`` and ``search``.
    """
    keep = [owner] if owner else []
    asked = queries.select(query_key, *keep, F.explode(S.tokens(F.col(query))).alias("term")).groupBy(query_key, *keep, "term").agg(F.count("*").alias("times"))
    terms = asked.select(*keep, "term").distinct()
    # One pass makes tokens of the texts; what is kept of it is an array a chunk of the terms that queries ask for, and its length.
    words = docs.select(key, *keep, S.tokens(F.col(text)).alias("_t")).select(key, *keep, F.size("_t").alias("length"), F.explode_outer("_t").alias("term"))
    marked = words.join(terms.withColumn("_asked", F.lit(1)), [*keep, "term"], "left")
    counted = durable(marked.groupBy(*keep, key, "length", F.when(F.col("_asked").isNotNull(), F.col("term")).alias("term")).agg(F.count("*").alias("tf")))
    found = counted.where("term is not null")
    df = found.groupBy(*keep, "term").agg(F.count("*").alias("df"))
    stats = counted.groupBy(*keep, key, "length").agg(F.lit(1).alias("_one")).groupBy(*keep).agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    weighed = found.join(df, [*keep, "term"])
    weighed = weighed.join(stats, keep) if keep else weighed.crossJoin(F.broadcast(stats))  # without owners one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    # A text's postings lie in one task, which adds up all queries' scores of its texts and keeps the best of each: nearly every text has one of a query's terms.
    weighed = weighed.select(*keep, "term", key, (idf * tf).alias("w")).repartition(max(1, -(-found.count() // POSTINGS)), key)
    scored = asked.join(weighed, [*keep, "term"]).groupBy(query_key, *keep, key).agg(F.sum(F.col("w") * F.col("times")).alias("score")).where("score > 0")
    order = Window.partitionBy(query_key, *keep).orderBy(F.desc(F.round("score", 9)), F.desc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_search(chunks: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str = "embedding", k: int = 4) -> DataFrame:
    """Exact nearest chunks of a stated query set, by Euclidean distance; filters go before.  See ``neighbours.nearest_join``."""
    found = neighbours.nearest_join(queries, chunks, query_key, key, vector, k)
    return found.select(F.col("query").alias(query_key), F.col("chunk").alias(key), "distance", "rank")


def holders(docs: DataFrame, passages_: DataFrame, key: str, passage_key: str, text: str = "text", passage: str = "query", block: int = 10_000) -> DataFrame:
    """passage_key, key: the documents whose text holds a whole passage; an empty passage is held by every text.

    A document that holds a passage has all of its inner terms (the outer two may be parts of longer words there), so each passage is looked up by the inner
    term that the fewest documents have, and only those are searched.  Passages of fewer than three terms have no inner one: texts are scanned for ``block``
    of them at a time by an Aho-Corasick automaton, in time linear in the text.
    """
    termed = passages_.select(passage_key, F.col(passage).cast("string").alias("_p"), S.tokens(F.col(passage)).alias("_t")).where("_p is not null")
    inner = termed.where(F.size("_t") > 2)
    inner = inner.select(passage_key, "_p", F.explode(F.array_distinct(F.slice("_t", 2, F.size("_t") - 2))).alias("term"))
    lists = durable(docs.select(key, F.explode(F.array_distinct(S.tokens(F.col(text)))).alias("term")).join(inner.select("term").distinct(), "term", "left_semi"))
    counts = lists.groupBy("term").agg(F.count("*").alias("_df"))
    rare = inner.join(counts, "term").groupBy(passage_key, "_p").agg(F.min_by("term", F.struct("_df", "term")).alias("term"))
    found = rare.join(lists, "term").join(docs.select(key, F.col(text).alias("_d")), key)
    out = found.where(F.col("_d").contains(F.col("_p"))).select(passage_key, key).distinct()
    short = durable(termed.where(F.size("_t") <= 2).select(passage_key, "_p").distinct())
    different = short.select("_p").distinct()
    blocks = -(-different.count() // block)
    for b in range(blocks):
        patterns = [r[0] for r in different.where(F.pmod(F.xxhash64("_p"), F.lit(blocks)) == b).collect()]  # about ``block`` short texts
        out = out.unionByName(_holding(docs, key, text, patterns).join(short, "_p").select(passage_key, key).distinct())
    return out


def _holding(docs: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """key, _p: the patterns that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in filter(None, patterns):
            automaton.add_word(p, p)
        automaton.make_automaton()
        always = [""] if "" in patterns else []
        for batch in batches:
            at, held = [], []
            for i, t in enumerate(batch.column("_d").to_pylist()):
                own = [] if t is None else [*always, *({p for _, p in automaton.iter(t)} if len(automaton) else ())]
                at += [i] * len(own)
                held += own
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), pa.array(held, pa.string())], ["_key", "_p"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_d"))
    return rows.mapInArrow(run, f"_key {dict(rows.dtypes)['_key']}, _p string").withColumnRenamed("_key", key)


def retrieval_accuracy(hits: DataFrame, expected: DataFrame, query_key: str, key: str) -> DataFrame:
    """Share of queries whose expected chunk comes first, or among the first three."""
    best = expected.join(hits.select(query_key, F.col(key).alias("_hit"), "rank"), query_key, "left").groupBy(query_key).agg(F.min(F.when(F.col("_hit") == F.col("expected"), F.col("rank"))).alias("r"))
    return best.agg(F.avg(F.coalesce((F.col("r") <= 1).cast("int"), F.lit(0))).alias("top1"), F.avg(F.coalesce((F.col("r") <= 3).cast("int"), F.lit(0))).alias("top3"), F.count("*").alias("queries"))


def passages(hits: DataFrame, query_key: str, title: str = "title", level: str = "evidence_level", text: str = "text") -> DataFrame:
    """The hits of a query in one text, each under its title and evidence level."""
    one = F.concat(F.lit("["), F.col(title), F.lit(" | evidence: "), F.coalesce(F.col(level), F.lit("unverified")), F.lit("]\n"), F.col(text))
    return hits.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("p")))), lambda s: s["p"]), "\n\n---\n\n").alias("passages"))


def extractive_answer(hits: DataFrame, query_key: str, query: str = "query", title: str = "title", text: str = "text") -> DataFrame:
    """The first three sentences of the best passage, and of the second if the query names its title."""
    named = (F.col("rank") == 1) | ((F.col("rank") == 2) & F.arrays_overlap(S.tokens(F.col(title)), S.tokens(F.col(query))))
    rows = hits.where(named).select(query_key, "rank", F.array_join(F.slice(S.sentences(F.col(text)), 1, 3), " ").alias("a"))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "a"))), lambda s: s["a"]), "\n\n").alias("answer"))


def result_lines(rows: DataFrame, key: str) -> DataFrame:
    """A report's results as one searchable text."""
    line = F.format_string("%s: %s %s (%s)", F.col("marker"), S.show_number(F.col("value_si")), F.col("unit_si"), F.col("status"))
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
