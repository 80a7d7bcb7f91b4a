"""Syllables of whole texts by passes over the joined words."""

from pyspark.sql import functions as F

from labspark.functions import scalar as S

ODD = ["yyed", "eded", "aded", "themes", "Y", "yes", "you'es", "you'e", "don't", "rhythms", "bbed", "bles", "table", "yelled", "ee", "eeee", "AEIOU", "yed", "yyyy", "ses", "esses", "Pfft", "x", "queue", "laes", "makees", "heddy's"]


def test_syllables_of_a_text_are_the_sum_of_its_words(spark):
    rows = [(i, [w]) for i, w in enumerate(ODD)] + [(100, ODD), (101, []), (102, ["a", "bc"]), (103, ODD[::-1] * 50), (104, None)]
    got = spark.createDataFrame(rows, "id int, w array<string>").select("id", S.all_syllables(F.col("w")).alias("n"), F.aggregate("w", F.lit(0), lambda a, w: a + S.syllables(w)).alias("want")).collect()
    assert {r.id: r.n for r in got} == {r.id: r.want for r in got} and {r.id: r.n for r in got}[101] == 0


def test_grade_makes_a_texts_words_and_sentences_once(spark):
    texts = spark.createDataFrame([(1, "The cat sat. Themes yelled at you."), (2, "1. 2. 3"), (3, ""), (4, None)], "id int, t string")
    df = texts.select("id", "t", S.sentences(F.col("t")).alias("own")).select("id", S.reading_grade(F.col("t"), F.col("own")).alias("grade"), S.reading_grade(F.col("t")).alias("alone"))
    assert df.select("grade")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(t#") == 1
    got = {r.id: (r.grade, r.alone) for r in df.collect()}
    grade = round(0.39 * (7 / 2) + 11.8 * (7 / 7) - 15.59, 2)
    assert got == {1: (grade, grade), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (None, None)}


def test_sentences_lose_blanks_and_nothing_else(spark):
    text = "0 is a start.  1 follows. 2 ends here 2\n \n   3 and 3 \n4"
    got = spark.createDataFrame([(text,)], "t string").select(S.sentences(F.col("t")).alias("s")).first().s
    assert got == ["0 is a start.", "1 follows.", "2 ends here 2", "3 and 3", "4"]
