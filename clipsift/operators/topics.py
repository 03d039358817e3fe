"""Topics and trends of texts."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.functions.scalars import let, six
from clipsift.functions.text import TOPIC_STOPWORDS, trend_words, with_next
from clipsift.operators.ranking import top_k
from clipsift.sources.snapshots import written


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbouring words, joined; none where there are fewer. ``words`` should be a column of its own."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def run_lengths(ordered: Column) -> Column:
    """How often each value of an ordered array that isn't empty is there. ``ordered`` should be bound by ``let``: it is read for every place."""
    places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    return let(places, lambda p: F.transform(p, lambda i, k: F.coalesce(F.get(p, k + 1), F.size(ordered)) - i))


#: What a term's score is multiplied by where the audience's trends favour it, and where they don't.
FAVOURED, DISFAVOURED = 1.35, 0.75


#: Terms of most texts, of which documents' frequencies are known where their terms are first seen.
COMMON = 1 << 17
#: Terms of texts that a task holds before it counts and sends them on, words that it knows by number, and the most bits that tell of
#: a term whether it may be in two texts.
COUNTED, WORDS, BITS = 1 << 22, 1 << 20, 1 << 28
#: Bytes of tokens, in lower case; all others are blanks.
_TOKEN = bytes(ord(c.lower()) if (c := chr(i)) == "'" or c.isascii() and c.isalnum() else 32 for i in range(256))
_STOP = frozenset(TOPIC_STOPWORDS)
_LOW = (1 << 32) - 1


def _words(text: str) -> list[str]:
    """``topic_words`` where a task reads texts itself. Bytes are lower-cased and not characters, of which others could become ASCII."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TOKEN).decode("ascii").split() if len(w) > 2 and w not in _STOP]


def _numbers(words: Iterable[str] = ()) -> defaultdict[str, int]:
    """Numbers of words, from 1 in the order they come; 0 is no word."""
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    for w in ("", *words):
        ids[w]
    return ids


def _codes(words: list[str], ids: defaultdict[str, int]) -> np.ndarray:
    """Words and their neighbouring pairs, repeats included: the number of the first word above that of the second."""
    own = np.fromiter(map(ids.__getitem__, words), "int64", len(words))
    return np.concatenate([own << 32, own[:-1] << 32 | own[1:]])


def document_frequencies(docs: DataFrame, group: str, text: str, counted: int = COUNTED) -> DataFrame:
    """(group, term, df), written: in how many of a group's texts a term is, for terms of two texts or more; most terms are in one.

    Tasks count the terms of many texts by the numbers of their words, and send them on as lines, a first word and all that follow it,
    packed and dealt by the first word: a term takes a few bytes.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[group].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, size = _numbers(), {}, 0

        def packed() -> pd.DataFrame:
            names, out = np.array(list(ids), dtype=object), []
            part = [zlib.crc32(w.encode()) % (8 * tasks) for w in ids]
            for g, found in held.items():
                codes, n = np.unique(np.concatenate(found), return_counts=True)
                first, follow = codes >> 32, names[codes & _LOW].tolist()
                starts = np.flatnonzero(np.diff(first, prepend=-1)).tolist()
                dealt: dict[int, tuple[list, list]] = {}
                for a, b in zip(starts, [*starts[1:], len(codes)]):
                    lines, counts = dealt.setdefault(part[first[a]], ([], []))
                    lines.append(names[first[a]] + " " + " ".join(follow[a:b]))
                    counts.append(n[a:b])
                out += [(k, g, zlib.compress("\n".join(lines).encode(), 1), zlib.compress(np.concatenate(counts).astype("<i4").tobytes(), 1)) for k, (lines, counts) in dealt.items()]
            return pd.DataFrame(out, columns=["_part", "g", "terms", "counts"])

        for batch in batches:
            for g, t in zip(batch[group], batch[text]):
                found = np.unique(_codes(_words(t), ids))
                if len(found):
                    held.setdefault(g, []).append(found)
                    size += len(found)
                if size > counted:
                    yield packed()
                    ids, held, size = _numbers(), {}, 0
        yield packed()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, rows in part.groupby("g"):
            ids, codes = _numbers(), []
            for terms in rows["terms"]:
                lines = [line.split(" ") for line in zlib.decompress(terms).decode().split("\n")]
                sizes = np.fromiter(map(len, lines), int, len(lines))
                flat = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(lines)), "int64", sizes.sum())
                heads = np.cumsum(sizes) - sizes
                codes.append(np.repeat(flat[heads], sizes - 1) << 32 | np.delete(flat, heads))
            counts = np.concatenate([np.frombuffer(zlib.decompress(c), dtype="<i4") for c in rows["counts"]])
            codes, at = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(at, weights=counts).astype("int64")
            names, kept = list(ids), total > 1
            out += [(g, f"{names[c >> 32]} {names[c & _LOW]}" if c & _LOW else names[c >> 32], n) for c, n in zip(codes[kept].tolist(), total[kept].tolist())]
        return pd.DataFrame(out, columns=[group, "term", "df"])

    known = docs.select(group, text).where(F.col(group).isNotNull() & F.col(text).isNotNull())
    parts = known.mapInPandas(pack, f"_part int, g {kind}, terms binary, counts binary")
    return written(parts.repartition(tasks, "_part").groupBy("_part").applyInPandas(merge, f"`{group}` {kind}, term string, df long"))


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def _places(group: object, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bits of terms, by the hashes of their words, that of no word where there is one."""
    x = (first * np.uint64(0x9E3779B97F4A7C15) + (second ^ _hashes([str(group)])[0])) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype("int64")


def _seen(terms: DataFrame, group: str, most: int) -> np.ndarray:
    """Bits of which those of all ``terms`` (group, term) are set: a term whose bit isn't set is none of them."""
    bits = min(most, max(1 << 13, 1 << (16 * terms.count()).bit_length()))
    width = max(bits >> 4, 1 << 13)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, rows in batch.groupby(group):
                words = [t.partition(" ") for t in rows["term"]]
                at = np.unique(_places(g, _hashes([w[0] for w in words]), _hashes([w[2] for w in words]), bits))
                yield pd.DataFrame({"at": at, "part": (at // width).astype("int32")})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, rows in batch.groupby("part"):
                held.setdefault(k, np.zeros(width, dtype=bool))[rows["at"].to_numpy() % width] = True
        yield pd.DataFrame([(k, np.packbits(b).tobytes()) for k, b in held.items()], columns=["part", "bits"])

    found = terms.select(group, "term").where(F.col(group).isNotNull()).mapInPandas(placed, "at long, part int").repartition(16, "part").mapInPandas(packed, "part int, bits binary").collect()
    out = np.zeros(bits // 8, dtype="uint8")
    for r in found:
        out[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, dtype="uint8")
    return out


def _contenders(docs: DataFrame, group: str, key: str, text: str, counts: DataFrame, n: DataFrame, trends: DataFrame | None, used: int, common: int, most: int = BITS) -> tuple[DataFrame, int]:
    """((group, key, n, term, tf, df, favoured), rare): of each text the terms that can be taken, and a frequency.

    The most frequent terms of all groups, at most ``common``, are known to every task; others are in fewer than ``rare`` texts of
    their group (df is null), and most are in this text alone, as their bit says (at most ``most`` bits tell of the terms of ``counts`` and
    ``trends``). So a term's score lies between two bounds. Before the last choice at most ``used`` words are used; of
    ``used + 1`` terms that share no word, one has none of these. So once all of them were passed, all choices are made, and a term
    whose upper bound is below the lower bounds of such terms can't be taken; nor can one of the same score that comes after them.
    """
    many, rare = 0, 2
    for df, k in counts.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).count().orderBy(F.desc("df")).collect():
        many += k
        if many > common:
            rare = df + 1
            break
    held = counts.where(F.col("df") >= rare).join(n, group)
    held = held.withColumn("favoured", F.lit(None).cast("boolean")) if trends is None else held.join(trends.select(group, "term", "favoured"), [group, "term"], "left")
    factor = F.when(F.col("favoured"), FAVOURED).when(~F.col("favoured"), DISFAVOURED).otherwise(1.0)
    rows = held.select(F.col(group).alias("g"), "term", "df", "favoured", ((F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0) * factor).alias("v")).collect()
    ids, of_group = _numbers(), {}
    for i, r in enumerate(rows):
        first, _, second = r.term.partition(" ")
        of_group.setdefault(r.g, []).append((ids[first] << 32 | ids[second], i))
    of_group = {g: np.array(sorted(found), dtype="int64").T for g, found in of_group.items()}
    several = counts.select(group, "term") if trends is None else counts.select(group, "term").union(trends.select(group, "term"))
    known = docs.sparkSession.sparkContext.broadcast((list(ids)[1:], of_group, np.array([r.v for r in rows] + [np.nan]), np.array([r.df for r in rows] + [np.nan], dtype=float), np.array([r.favoured for r in rows] + [None], dtype=object), _seen(several, group, most)))
    low, high = (1.0, 1.0) if trends is None else (DISFAVOURED, FAVOURED)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common_words, of_group, values, dfs, favoured, bits = known.value
        ids, told, hashes, sizes = None, [], np.zeros(0, dtype="uint64"), np.zeros(0, dtype=int)
        nothing = np.zeros((2, 0), dtype="int64")
        for batch in batches:
            out: list[tuple] = []
            many = 0
            for g, k, n, said in zip(batch[group], batch[key], batch["n"], batch["_text"]):
                if ids is None or len(ids) > WORDS + len(common_words):
                    ids, told, hashes, sizes = _numbers(common_words), [], hashes[:0], sizes[:0]
                codes, times = np.unique(_codes(_words(said), ids), return_counts=True)
                if len(ids) > len(told):
                    new = list(itertools.islice(reversed(ids), len(ids) - len(told)))[::-1]
                    told += new
                if len(ids) > len(hashes):
                    hashes = np.concatenate([hashes, _hashes(told[len(hashes) :])])
                    sizes = np.concatenate([sizes, np.fromiter(map(len, told[len(sizes) :]), int)])
                first, second = codes >> 32, codes & _LOW
                firsts, seconds = first.tolist(), second.tolist()
                term = lambda i: f"{told[firsts[i]]} {told[seconds[i]]}" if seconds[i] else told[firsts[i]]  # noqa: B023, E731
                own, index = of_group.get(g, nothing)
                at = np.full(len(codes), -1)
                if len(own):
                    near = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                    at = np.where(own[near] == codes, index[near], -1)
                chosen, single = range(len(codes)), np.zeros(len(codes), dtype=bool)
                if len(codes) > used:
                    place = _places(g, hashes[first], hashes[second], 8 * len(bits))
                    single = (bits[place >> 3] >> (7 - (place & 7)).astype("uint8")) & 1 == 0
                    pair = second > 0
                    v, unit, alone = values[at], times * np.where(pair, 1.15, 1.0), math.log((n + 1) / 2) + 1.0
                    least = np.where(single, alone, np.where(np.isnan(v), low * (math.log((n + 1) / rare) + 1.0), v)) * unit
                    most = np.where(single, alone, np.where(np.isnan(v), high * alone, v)) * unit
                    size = sizes[first] + np.where(pair, sizes[second] + 1, 0)
                    seen: set[int] = set()
                    passed: list[int] = []
                    for _, tied in itertools.groupby(np.lexsort((-size, -least)).tolist(), lambda i: (least[i], size[i])):
                        for i in sorted(tied, key=term):
                            own_words = (firsts[i], seconds[i]) if seconds[i] else (firsts[i],)
                            if seen.isdisjoint(own_words):
                                seen.update(own_words)
                                passed.append(i)
                                if len(passed) > used:
                                    break
                        if len(passed) > used:
                            break
                    if len(passed) > used:
                        bar = least[passed[-1]]
                        fits = most * (1 + 1e-9) + 4e-6 >= bar  # scores are rounded to six decimals
                        alike = lambda i: single[i] & (times[i] == times[passed[-1]]) & (pair[i] == pair[passed[-1]])  # noqa: B023, E731
                        even = [i for i in passed if least[i] <= bar * (1 + 1e-9) + 4e-6]
                        if all(alike(i) for i in even):
                            last = max((-size[i], term(i)) for i in even)
                            later = alike(np.arange(len(codes))) & (size <= -last[0])
                            for i in np.flatnonzero(later & (size == -last[0])):
                                later[i] = term(i) > last[1]
                            fits &= ~later
                        chosen = np.flatnonzero(fits)
                chosen = np.asarray(chosen, dtype=int)
                out.append((g, k, n, [term(i) for i in chosen.tolist()], times[chosen], np.where(single, 1.0, dfs[at])[chosen], favoured[at[chosen]]))
                many += len(chosen)
                if many > 1 << 16:
                    yield table(out)
                    out, many = [], 0
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pd.DataFrame:
        sizes = [len(r[3]) for r in out]
        once = [pd.Series([r[i] for r in out]).repeat(sizes).reset_index(drop=True) for i in range(3)]
        return pd.DataFrame(dict(zip(names, [*once, list(itertools.chain.from_iterable(r[3] for r in out)), *[np.concatenate([r[i] for r in out]) for i in (4, 5, 6)]])))

    names = [group, key, "n", "term", "tf", "df", "favoured"]
    kinds = [docs.schema[c].dataType.simpleString() for c in (group, key)]
    texts = docs.select(group, key, F.coalesce(text, F.lit("")).alias("_text")).join(n, group).select(group, key, "n", "_text")
    return texts.mapInPandas(keep, f"`{group}` {kinds[0]}, `{key}` {kinds[1]}, n long, term string, tf long, df long, favoured boolean"), rare


def topics(docs: DataFrame, group: str, key: str, text: str, limit: int, trends: DataFrame | None = None, counts: DataFrame | None = None, common: int = COMMON) -> DataFrame:
    """(key, term, score, rank): a text's best terms by TF-IDF among its group's texts, none made of words already used.

    ``trends`` (group, term, favoured boolean, each term once a group) weighs terms up or down; the result then also has
    favoured, null for terms that no trend names. ``counts`` are the group's ``document_frequencies``, if these are at hand.
    A key is one text.

    Before the last choice at most ``limit - 1`` terms of two words are taken, so no more than the terms made of these words can be
    passed over: the best terms of each text up to that number decide, and the greedy choice folds an array of no more. Terms are
    counted inside their text, and only those that can be taken leave it.
    """
    used = 2 * (limit - 1)
    pool = used * (used + 1) + limit
    counts = document_frequencies(docs, group, text) if counts is None else counts
    n = written(docs.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    found, rare = _contenders(docs, group, key, text, counts, n, trends, used, common)
    others = counts.where(F.col("df") < rare).select(group, "term", F.col("df").alias("_df"))
    if trends is not None:
        others = others.join(trends.select(group, "term", F.col("favoured").alias("_f")), [group, "term"], "full")
    rated = found.join(others, [group, "term"], "left")
    rated = rated.withColumn("df", F.coalesce("df", "_df", F.lit(1)))
    if trends is not None:
        rated = rated.withColumn("favoured", F.coalesce("favoured", "_f"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0
    bonus = F.when(F.contains("term", F.lit(" ")), 1.15).otherwise(1.0)
    factor = F.when(F.col("favoured"), FAVOURED).when(~F.col("favoured"), DISFAVOURED).otherwise(1.0)
    scored = rated.select(key, "term", "favoured", six(F.col("tf") * idf * factor * bonus).alias("score"))
    best = top_k(scored, [key], [F.desc("score"), F.desc(F.length("term")), F.col("term")], pool, "i")
    ordered = F.array_sort(F.collect_list(F.struct("i", "term", "score", "favoured", F.split("term", " ").alias("own"))))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<term:string,score:double,favoured:boolean>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < limit) & (F.size(F.array_except(x["own"], acc["used"])) > 0)
        picked = F.struct(x["term"].alias("term"), x["score"].alias("score"), x["favoured"].alias("favoured"))
        return F.when(fits, F.struct(F.concat(acc["used"], x["own"]).alias("used"), F.array_append(acc["taken"], picked).alias("taken"))).otherwise(acc)

    chosen = best.groupBy(key).agg(F.aggregate(ordered, start, step)["taken"].alias("taken"))
    return chosen.select(key, F.posexplode("taken").alias("p", "x")).select(key, F.col("x.term").alias("term"), F.col("x.score").alias("score"), (F.col("p") + 1).alias("rank"), *([] if trends is None else [F.col("x.favoured").alias("favoured")]))


def term_trends(examples: DataFrame, group: str, text: str, outcome: str, limit: int, least: int = 2) -> DataFrame:
    """(group, term, support, association, rank): terms whose texts' outcomes sum highest, of those in ``least`` texts and above 0."""
    terms = examples.withColumn("_w", trend_words(F.col(text))).select(group, outcome, F.explode(F.array_distinct(with_next(F.col("_w")))).alias("term"))
    found = terms.groupBy(group, "term").agg(F.sum(outcome).alias("association"), F.count(F.lit(1)).alias("support")).where((F.col("support") >= least) & (F.col("association") > 0))
    return top_k(found, [group], [F.desc("association"), F.desc("support"), F.col("term")], limit).select(group, "term", "support", "association", "rank")


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut before the last word that doesn't fit whole, with an ellipsis.

    The end is that of the cut itself: ``$`` would also be before a line break that the cut ends in.
    """
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"\s\S*\z", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def hashtag(words: Column) -> Column:
    camel = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")
    return F.concat(F.lit("#"), F.substring(camel, 1, 40))


def community_trends(examples: DataFrame, group: str, owner: str, text: str, outcome: str, limit: int, least: int = 2) -> DataFrame:
    """(group, term, creator_support, clip_support, association, rank): like ``term_trends``, but support counts distinct owners.

    Texts are first summed by owner and term, so no count of distinct owners needs all rows of a term.
    """
    terms = examples.withColumn("_w", trend_words(F.col(text))).select(group, owner, outcome, F.explode(F.array_distinct(with_next(F.col("_w")))).alias("term"))
    per = terms.groupBy(group, "term", owner).agg(F.sum(outcome).alias("o"), F.count(F.lit(1)).alias("n"))
    found = per.groupBy(group, "term").agg(F.sum("o").alias("association"), F.count(F.lit(1)).alias("creator_support"), F.sum("n").alias("clip_support")).where((F.col("creator_support") >= least) & (F.col("association") > 0))
    return top_k(found, [group], [F.desc("association"), F.desc("creator_support"), F.col("term")], limit).select(group, "term", "creator_support", "clip_support", "association", "rank")


def best_excerpts(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, excerpt): the sentence that shares most topic words, is complete and of a fit length; the first gets a little more."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    s = docs.select(key, F.posexplode(parts).alias("i", "s"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit("([a-zA-Z0-9']+)")), lambda t: F.lower(t)))
    shared = F.size(F.array_intersect(found, F.array(*map(F.lit, words))))
    fit = F.greatest(F.lit(0.0), 1.0 - F.abs(F.length("s") - 120) / 160.0)
    score = F.round(shared + 0.4 * F.substring("s", -1, 1).isin(".", "?", "!").cast("int") + 0.2 * fit + 0.15 * (F.col("i") == 0).cast("int"), 9)
    return s.groupBy(key).agg(F.max_by("s", F.struct(score, -F.col("i"))).alias("excerpt"))
