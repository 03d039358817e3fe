"""Posts drawn from clips, and what creators did with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Platforms of a pack with the most characters of a body, and the actions on a post.
POSTS = {"youtube": 420, "tiktok": 150, "instagram": 520, "linkedin": 620}
ACTIONS = ("copied_original", "copied_edited", "rejected")
TITLE, TAGS, SHORT_TAGS, NO_TAG = 70, 5, 4, "#CreatorClip"


def shortened(text: Column, most: int) -> Column:
    """Single spaced, at most ``most`` characters: cut before the last word that isn't whole, less closing marks, with an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(clean, 1, most - 1)
    whole = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[ ,;:-]+$", "")
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.when(whole != "", whole).otherwise(head)), F.lit("…")))


def topic_tag(term: Column) -> Column:
    """``#`` and a term's words, each capitalised, in at most 40 characters; null for no words or numbers alone."""
    words = F.regexp_extract_all(term, F.lit("([a-zA-Z0-9]+)"))
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")
    return F.when(F.exists(words, lambda w: w.rlike("[^0-9]")), F.concat(F.lit("#"), F.substring(joined, 1, 40)))


def platform_packs(clips: DataFrame, topics: DataFrame, key: str, text: str) -> DataFrame:
    """(key, platform, title, post) for each clip with a text that isn't blank: a post for each platform, from its own words.

    ``topics`` is (key, term, rank), a few of each clip. The excerpt is the sentence that shares most words with them, is complete and
    of a fit length; tags are the terms in order, each once whatever its case. Only youtube has a title.
    """
    said = topics.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("_terms"))
    c = clips.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(key, F.col(text).alias("_text")).join(said, key, "left")
    terms = F.coalesce("_terms", F.array().cast("array<string>"))
    tags = F.filter(F.transform(terms, topic_tag), lambda t: t.isNotNull())
    tags = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)))
    tags = F.when(F.size(tags) > 0, F.slice(tags, 1, TAGS)).otherwise(F.array(F.lit(NO_TAG)))
    parts = F.filter(F.transform(F.split("_text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    own = F.flatten(F.transform(terms, lambda t: F.split(t, " ")))

    def rated(s: Column, i: Column) -> Column:
        words = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit("([a-zA-Z0-9']+)")), lambda w: F.lower(w)))
        fit = F.greatest(F.lit(0.0), 1.0 - F.abs(F.length(s) - 120) / 160.0)
        score = F.size(F.array_intersect(words, own)) + 0.4 * s.rlike(r"[.?!]$").cast("int") + 0.2 * fit + 0.15 * (i == 0).cast("int")
        return F.struct(F.round(score, 9).alias("score"), (-i).alias("place"), s.alias("s"))

    c = c.withColumns({"_excerpt": F.array_max(F.transform(parts, rated))["s"], "_tags": tags})
    title = shortened(F.regexp_replace("_excerpt", r"\.+$", ""), TITLE)
    few, every = F.array_join(F.slice("_tags", 1, SHORT_TAGS), " "), F.array_join("_tags", " ")
    body = {p: shortened(F.col("_excerpt" if p == "tiktok" else "_text"), most) for p, most in POSTS.items()}
    posts = [
        F.struct(F.lit(p).alias("platform"), (title if p == "youtube" else F.lit(None).cast("string")).alias("title"),
                 F.concat_ws("\n\n", *([title] if p == "youtube" else []), body[p], every if p == "instagram" else few).alias("post"))
        for p in POSTS
    ]
    return c.select(key, F.explode(F.array(*posts)).alias("p")).select(key, "p.*")


def copy_feedback(feedback: DataFrame, packs: DataFrame, pack: str = "pack_id") -> DataFrame:
    """``feedback`` (pack, platform, action, generated, final) with ``reason``: what speaks against each row, null if nothing does.

    ``packs`` is (pack, pack_json); a post is found at platforms.<platform>.text of its JSON.
    """
    stored = F.from_json("pack_json", "platforms map<string,struct<text:string>>")["platforms"]
    known = packs.select(F.col(pack).alias("_pack"), stored.alias("_stored"), F.lit(True).alias("_known"))
    f = feedback.join(known, F.col(pack) == F.col("_pack"), "left")
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))
    copied, same = F.col("action").startswith("copied"), F.col("final").eqNullSafe(F.col("generated"))
    reason = (
        F.when(~F.coalesce(F.col("platform").isin(*POSTS), F.lit(False)), "platform").when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action")
        .when(blank("generated"), "no generated text").when(copied & blank("final"), "no final text").when(F.col("_known").isNull(), "unknown pack")
        .when(~F.col("generated").eqNullSafe(F.element_at("_stored", F.col("platform"))["text"]), "not the stored text")
        .when((F.col("action") == "copied_original") & ~same, "edited").when((F.col("action") == "copied_edited") & same, "unchanged")
    )
    return f.withColumn("reason", reason).drop("_pack", "_stored", "_known")
