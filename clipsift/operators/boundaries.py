"""Where a clip could better begin and end: features, scores and proposals of boundaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import clamp
from clipsift.functions.text import DANGLING, REFINEMENT_OPENERS, REFINEMENT_PHRASES, SENTENCE_END
from clipsift.operators.joins import earliest_after, latest_before

WORD_BEFORE, WORD_AFTER = 5, 6


def plain(word: Column) -> Column:
    """The first run of letters and apostrophes, lower case; empty without one."""
    return F.lower(F.regexp_extract(word, "([A-Za-z']+)", 1))


def last_plain(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("([A-Za-z']+)"))
    return F.lower(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit("")))


def word_features(words: DataFrame) -> DataFrame:
    """Words with the gaps, sentence ends and context around them; all windows share one sort."""
    w = Window.partitionBy("video").orderBy("pos")
    around = F.lower(F.array_join(F.collect_list("word").over(w.rowsBetween(-WORD_BEFORE, WORD_AFTER)), " "))
    flag = lambda c: c.cast("int").cast("double")
    return words.select(
        "video", "pos", "start", "end", "word",
        F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("start") - F.coalesce(F.lag("end").over(w), F.col("start")))).alias("gap_before"),
        F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(F.lead("start").over(w), F.col("end")) - F.col("end"))).alias("gap_after"),
        flag(F.coalesce(F.lag("word").over(w).rlike(SENTENCE_END), F.lit(False))).alias("previous_ends"),
        flag(F.col("word").rlike(SENTENCE_END)).alias("ends"),
        flag(plain(F.col("word")).isin(list(REFINEMENT_OPENERS))).alias("opener"),
        flag(plain(F.col("word")).isin([*DANGLING, "if"])).alias("dangling"),
        flag(around.rlike("|".join(REFINEMENT_PHRASES))).alias("intro_or_ad"),
    )


def featured_words(texts: DataFrame, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """``word_features`` of the words of ``texts`` (w: timed words in order as an array of (pos, start, end, word), ...), a row each with
    the other columns in place of ``w``; of the ``wanted`` words if given.

    A word meets its neighbours as arrays moved by one place, so that no word leaves its text and the features are plain columns.
    Phrases are looked for around single words only in texts that have one.
    """
    w, rest = F.col("w"), [c for c in texts.columns if c != "w"]
    flag = lambda c: c.cast("int").cast("double")
    phrases = "|".join(REFINEMENT_PHRASES)
    joined = lambda words: F.lower(F.array_join(words, " "))
    near = lambda i: F.transform(F.sequence(F.greatest(i - WORD_BEFORE, F.lit(0)), i + WORD_AFTER), lambda k: F.get(w, k)["word"])  # noqa: E731; a slice reads the whole array; joining leaves nulls out
    asked = lambda x, told: told if wanted is None else F.when(wanted(x), told)
    told = F.when(joined(w["word"]).rlike(phrases), F.transform(w, lambda x, i: asked(x, joined(near(i)).rlike(phrases))))
    before = lambda name, kind: F.concat(F.array(F.lit(None).cast(kind)), w[name])
    told_texts = texts.select(*rest, "w", F.coalesce(told, F.array().cast("array<boolean>")).alias("_told"))
    places = F.arrays_zip(
        *[w[c].alias(c) for c in ("pos", "start", "end", "word")], before("end", "double").alias("_end_before"), before("word", "string").alias("_word_before"),
        F.slice(w["start"], 2, F.size(w)).alias("_start_after"), F.col("_told"),
    )
    # the outer generator keeps Spark from asking first whether there are words, which would find them twice
    words = told_texts.select(*rest, F.inline_outer(places if wanted is None else F.filter(places, wanted))).where("pos IS NOT NULL")
    return words.select(
        *rest, "pos", "start", "end", "word",
        F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("start") - F.coalesce(F.col("_end_before"), F.col("start")))).alias("gap_before"),
        F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(F.col("_start_after"), F.col("end")) - F.col("end"))).alias("gap_after"),
        flag(F.coalesce(F.col("_word_before").rlike(SENTENCE_END), F.lit(False))).alias("previous_ends"),
        flag(F.col("word").rlike(SENTENCE_END)).alias("ends"),
        flag(plain(F.col("word")).isin(list(REFINEMENT_OPENERS))).alias("opener"),
        flag(plain(F.col("word")).isin([*DANGLING, "if"])).alias("dangling"),
        flag(F.coalesce(F.col("_told"), F.lit(False))).alias("intro_or_ad"),
    )


def heuristic_score(kind: str, offset: Column, energy: Column) -> Column:
    """Fixed weights of an option to begin (or end) at a word."""
    pause, sentence, penalty = (F.col("gap_before"), F.col("previous_ends"), F.col("opener")) if kind == "start" else (F.col("gap_after"), F.col("ends"), F.col("dangling"))
    return 0.9 * F.least(pause / 1.5, F.lit(1.0)) + 1.2 * sentence + 0.35 * energy - 0.8 * penalty - 0.035 * F.abs(offset) - 1.2 * F.col("intro_or_ad")


#: Seconds by which the end or start of detected speech may lie on the wrong side of a boundary.
SPEECH_SLACK = 0.05


def _speech_gaps(units: DataFrame, speech: DataFrame) -> DataFrame:
    """``units`` with the silence (speech_before, speech_after) between their boundaries and the nearest detected speech."""
    ends, starts = speech.select("video", F.col("end").alias("at")), speech.select("video", F.col("start").alias("at"))
    seen = latest_before(units, ends, ["video"], "start", "at", "at", "heard_before", SPEECH_SLACK)
    seen = earliest_after(seen, starts, ["video"], "end", "at", "at", "heard_after", SPEECH_SLACK)
    gap = lambda x: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))
    return seen.select(*units.columns, gap(F.col("start") - F.col("heard_before")).alias("speech_before"), gap(F.col("heard_after") - F.col("end")).alias("speech_after"))


def unit_options(units: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """Units (video, unit, start, end, text) with what start and end options are scored by, but for the distance.

    With ``speech`` (video, start, end: intervals in which speech was detected) a pause is the larger of the gap between units and
    the gap to the nearest speech; without it, or in a video without any, the gap between units decides.
    """
    if speech is None:
        units = units.withColumns({"speech_before": F.lit(0.0), "speech_after": F.lit(0.0)})
    else:
        units = _speech_gaps(units, speech)
    w = Window.partitionBy("video").orderBy("unit")
    pause = lambda gap: clamp(gap / 1.5)
    flag = lambda c: c.cast("int").cast("double")
    first = plain(F.col("text"))
    opening = flag((first != "") & ~first.isin(list(REFINEMENT_OPENERS)))
    before = F.greatest(F.col("speech_before"), F.coalesce(F.col("start") - F.lag("end").over(w), F.lit(0.0)))
    after = F.greatest(F.col("speech_after"), F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(0.0)))
    complete = F.col("text").rlike(SENTENCE_END)
    return units.select(
        "video", "unit", "start", "end",
        (1.2 * opening + 0.7 * pause(before) + 0.6 * flag(F.coalesce(F.lag(complete).over(w), F.lit(True))) - 1.5 * flag(F.lower("text").rlike("|".join(REFINEMENT_PHRASES)))).alias("start_score"),
        (1.4 * flag(complete) + 0.8 * pause(after) - 0.7 * flag(last_plain(F.col("text")).isin(list(DANGLING)))).alias("end_score"),
    )


def refine(options: DataFrame, cases: DataFrame, radius: float, shortest: float, longest: float) -> DataFrame:
    """(video, s, e, refined_start, refined_end, score) of each case (video, s, e): the best pair of options near its boundaries.

    Both sides are cut to the radius before they meet, so a case compares a handful of starts with a handful of ends.
    """
    near = options.join(cases, "video")
    away = lambda x, y: F.least(F.abs(x - y) / radius, F.lit(1.0))
    starts = near.where(F.abs(F.col("start") - F.col("s")) <= radius).select("video", "s", "e", F.col("start").alias("rs"), (F.col("start_score") - 0.55 * away(F.col("start"), F.col("s"))).alias("ss"))
    ends = near.where(F.abs(F.col("end") - F.col("e")) <= radius).select("video", "s", "e", F.col("end").alias("re"), (F.col("end_score") - 0.55 * away(F.col("end"), F.col("e"))).alias("es"))
    long, own = F.col("re") - F.col("rs"), F.col("e") - F.col("s")
    shared = F.greatest(F.lit(0.0), F.least("re", "e") - F.greatest("rs", "s"))
    met = starts.join(ends, ["video", "s", "e"]).where(long.between(shortest, longest) & (shared >= F.least(F.lit(5.0), own * 0.25)))
    score = F.round(F.col("ss") + F.col("es") - 0.35 * F.abs(long - own) / F.greatest(own, F.lit(1.0)), 9)
    moved = F.round(F.abs(F.col("rs") - F.col("s")) + F.abs(F.col("re") - F.col("e")), 9)
    best = met.groupBy("video", "s", "e").agg(F.max_by(F.struct("rs", "re"), F.struct(score, -moved, -F.col("rs"), -F.col("re"))).alias("b"), F.max(score).alias("score"))
    return best.select("video", "s", "e", F.col("b.rs").alias("refined_start"), F.col("b.re").alias("refined_end"), "score")
