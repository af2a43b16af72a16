"""Repeated rows don't hide a language, and personal data in long texts takes time in proportion to their length."""

import time

import pytest
from pyspark.sql import functions as F

from chimerascope.llm import language, pii, spans


@pytest.mark.parametrize("doc_id", [7, 8, 9, 11])
def test_a_language_of_one_repeated_document_is_learned(spark, doc_id):
    rows = [(doc_id, "le chat est sur la table avec du pain et du vin", "fr")] * 5000 + [(i, f"the cat is on the table with bread and wine {i}", "en") for i in range(1000, 1050)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(docs, held_out=(5, 9)).languages == ["en", "fr"]


def test_profiles_count_every_document_where_there_are_few(spark):
    rows = [(i, f"word{i} only", "en") for i in range(40)] * 2
    profile = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=(5, 9))
    only = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert language.identify(only, profile).first()["lang_pred"] == "en"


def test_spans_clear_of_others(spark):
    span = lambda a, b, k: (a, k, b, "x")
    taken = [span(5, 9, 0), span(5, 20, 1), span(30, 31, 0), span(50, 60, 2)]
    found = [span(0, 5, 4), span(0, 6, 4), span(8, 10, 5), span(19, 25, 4), span(20, 30, 4), span(20, 31, 5), span(31, 50, 4), span(40, 51, 4), span(60, 61, 4), span(52, 53, 5)]
    row = spark.createDataFrame([(found, taken)], f"found array<{spans.SPAN}>, taken array<{spans.SPAN}>").select(spans.clear_of(F.col("found"), F.col("taken")).alias("kept")).first()
    assert sorted(tuple(s) for s in row["kept"]) == sorted(c for c in found if all(not (t[0] < c[2] and c[0] < t[2]) for t in taken))


def test_windows_read_what_substring_reads(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "🙂" for i in range(1000))
    rows = spark.createDataFrame([(text, a, n) for a in (0, 1, 215, 216, 255, 256, 500, 990, 999, 1000) for n in (0, 1, 40, 256)], "t string, a int, n int")
    got = rows.select("a", "n", spans.window(spans.pieces(F.col("t")), F.col("a"), F.col("n")).alias("w")).collect()
    assert all(r["w"] == text[r["a"] : r["a"] + r["n"]] for r in got)


def test_time_follows_the_length_of_a_text(spark):
    line = "Contact Dr. Anna Smith, a.b{}@example.org or +49 30 1234567 {}, 555-123-4567, 12 Main Street, 10.0.0.{}, 123-45-6789\n"

    def timed(n):
        text = "".join(line.format(i, i % 10, i % 250) for i in range(n))
        began = time.time()
        row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        return time.time() - began, row

    timed(100)
    short, one = timed(1000)
    long, eight = timed(8000)
    assert (one["n_email"], eight["n_email"], eight["n_ip"]) == (1000, 8000, 8000)
    assert len(eight["spans"].split(",")) > 30_000
    assert long < 30 and long < 16 * max(short, 1)
