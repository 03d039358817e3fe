"""Operators on texts that come whole: same results as those on rows of words, without a shuffle of words."""

import pytest
from pyspark.sql import functions as F
from test_sequence import _words

from clipsift.operators import sequence
from clipsift.plans import registry


def _whole(df):
    return df.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "word"))).alias("w"))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pieces_and_candidates_are_those_of_rows(spark):
    rows, _ = _words(5)
    df = spark.createDataFrame(rows, "video int, pos int, start double, end double, word string").repartition(3)
    units = sequence.with_units(_whole(df)).localCheckpoint()
    flat = lambda t, c: t.select("video", F.posexplode_outer(c).alias("k", "p")).where("p is not null").select("video", "k", "p.*")
    own = sequence.sentence_units(df)
    assert _rows(flat(units, "units")) == _rows(own)
    assert _rows(flat(sequence.with_captions(_whole(df)), "cues")) == _rows(sequence.captions(df))
    found = flat(sequence.with_candidates(units), "candidates")
    wanted = sequence.candidate_texts(sequence.candidates(own), sequence.unit_texts(own, df))
    keys = ["video", "start", "end", "start_unit", "end_unit"]
    assert _rows(found.select(*keys, F.col("words"), "text_md5")) == _rows(wanted.select(*keys, F.col("word_count"), F.md5("text")))
    assert found.count() > 50
    assert sequence.with_candidates(sequence.with_units(_whole(df.where("false")))).count() == 0


@pytest.mark.parametrize("name", ["seq01_sentence_units", "seq02_candidates", "seq03_candidate_text", "str19_caption_cues", "str19_timed_captions"])
def test_words_of_a_text_are_not_shuffled(spark, sf, name):
    assert "Exchange" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
