"""Text expressions: tokens, sentences, transcript features and publishing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipsift.functions.scalars import clamp

# Word lists and phrases that results depend on.
CONTEXT_OPENERS = ("also", "and", "because", "but", "he", "her", "him", "it", "its", "she", "so", "that", "their", "them", "they", "this", "those", "we", "which")
HOOK_CUES = ("biggest", "danger", "how", "imagine", "important", "mistake", "never", "problem", "reason", "secret", "surprising", "truth", "want", "why")
FILLERS = ("actually", "basically", "honestly", "like", "literally", "um", "uh")
INTRO_OUTRO = ("good morning", "in today's episode", "subscribe", "thanks for listening", "thanks for watching", "welcome back")
ADVERTISEMENTS = (r"\b(?:this|today'?s) (?:video|episode) is sponsored by\b", r"\bbrought to you by\b", r"\buse (?:the )?(?:promo )?code\b", r"\bthanks? to .{1,80} for sponsoring\b")
MUSIC = r"\[(?:intro )?music\]|\((?:intro )?music\)|[♪♫]"
SENTENCE_END = r"[.!?][\"'”’)]*$"
TREND_STOPWORDS = (
    "about", "after", "again", "also", "and", "are", "because", "been", "before", "being", "but", "can", "could", "did", "does", "doing", "for", "from", "had", "has", "have", "here", "how", "into", "its", "just", "like",
    "more", "not", "now", "really", "that", "the", "their", "then", "there", "they", "this", "was", "were", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your",
)
TOPIC_STOPWORDS = (*TREND_STOPWORDS, "all", "any", "our", "than")
REFINEMENT_OPENERS = ("also", "and", "because", "but", "he", "however", "it", "she", "so", "that", "then", "they", "this", "those", "we", "which", "while", "who")
REFINEMENT_PHRASES = ("before we get into", "brought to you by", "don't forget to subscribe", "in today's episode", "promo code", "sponsor", "welcome back")
DANGLING = ("and", "because", "but", "or", "so", "that", "then", "which", "while")

FEATURES = ("clean_start", "complete_end", "hook_signal", "duration_fit", "words_per_second", "density_fit", "structure_fit", "lexical_diversity", "lexical_fit", "filler_ratio", "filler_control", "intro_outro")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9']+)")), lambda t: F.lower(t))


def among(token: Column, words: tuple[str, ...]) -> Column:
    return token.isin(list(words))


def transcript_features(text: Column, tok: Column, duration: Column, word_count: Column, sentence_count: Column) -> dict[str, Column]:
    """Twelve features of a candidate's text; ``tok`` are its tokens as a column, so that they are found once."""
    first, n = F.slice(tok, 1, 12), F.size(tok)
    hooks = F.size(F.filter(first, lambda t: among(t, HOOK_CUES)))
    digit = F.exists(first, lambda t: t.rlike("^[0-9]+$"))
    rate = F.when(duration > 0, word_count / duration).otherwise(F.lit(0.0))
    some = lambda x: F.when(n > 0, x / F.when(n > 0, n).otherwise(1)).otherwise(F.lit(0.0))
    diversity, filler = some(F.size(F.array_distinct(tok))), some(F.size(F.filter(tok, lambda t: among(t, FILLERS))))
    flag = lambda c: c.cast("int").cast("double")
    return {
        "clean_start": flag(~among(F.coalesce(F.get(tok, F.lit(0)), F.lit("")), CONTEXT_OPENERS)),
        "complete_end": flag(text.rlike(SENTENCE_END)),
        "hook_signal": clamp(0.5 * F.least(hooks, F.lit(2)) / 2.0 + 0.3 * flag(F.contains(F.substring(text, 1, 160), F.lit("?"))) + 0.2 * flag(digit)),
        "duration_fit": clamp(1.0 - F.abs(duration - 40.0) / 30.0),
        "words_per_second": rate,
        "density_fit": clamp(1.0 - F.abs(rate - 2.5) / 1.5),
        "structure_fit": clamp(1.0 - F.abs(sentence_count - 5) / 7.0),
        "lexical_diversity": diversity,
        "lexical_fit": clamp((diversity - 0.35) / 0.4),
        "filler_ratio": filler,
        "filler_control": clamp(1.0 - filler / 0.08),
        "intro_outro": flag(F.lower(text).rlike("|".join(INTRO_OUTRO))),
    }


def heuristic_score(f: dict[str, Column]) -> Column:
    """Weighted features, 0 to 100."""
    standalone = 0.5 * f["clean_start"] + 0.5 * f["complete_end"]
    total = 0.25 * standalone + 0.2 * f["hook_signal"] + 0.15 * f["density_fit"] + 0.15 * f["structure_fit"] + 0.1 * f["duration_fit"] + 0.1 * f["lexical_fit"] + 0.05 * f["filler_control"]
    return clamp(total - 0.15 * f["intro_outro"]) * 100.0


def prefilter_score(f: dict[str, Column], gate: Column) -> Column:
    return sum((f[k] for k in ("complete_end", "hook_signal", "duration_fit", "density_fit", "structure_fit", "lexical_fit", "filler_control")), f["clean_start"]) + gate - f["intro_outro"]


def gate_reasons(text: Column, f: dict[str, Column], duration: Column) -> Column:
    """Array of (code, severity, penalty) that a candidate's publishing rules give."""
    music = F.regexp_count(text, F.lit("(?i)" + MUSIC))
    spoken = F.size(tokens(F.regexp_replace(text, "(?i)" + MUSIC, " ")))
    rate = f["words_per_second"]
    rules = [
        ("advertisement_language", "block", F.lit(1.0), text.rlike("(?i)" + "|".join(ADVERTISEMENTS))),
        ("music_only", "block", F.lit(1.0), (music > 0) & (spoken < 8)),
        ("context_dependent_start", "review", F.lit(0.18), f["clean_start"] < 0.5),
        ("incomplete_ending", "review", F.lit(0.20), f["complete_end"] < 0.5),
        ("intro_or_outro_language", "review", F.lit(0.28), f["intro_outro"] >= 0.5),
        ("long_interval", "review", F.least(F.lit(0.15), 0.05 + (duration - 55.0) / 100.0), duration > 55),
        ("sparse_speech", "review", F.lit(0.15), rate < 1.0),
        ("dense_speech", "review", F.lit(0.10), rate > 4.2),
        ("high_filler_ratio", "review", F.lit(0.10), f["filler_ratio"] > 0.10),
    ]
    found = [F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), penalty.alias("penalty"))) for code, severity, penalty, hit in rules]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def gate_eligible(reasons: Column) -> Column:
    return ~F.exists(reasons, lambda r: r["severity"] == "block")


def gate_score(reasons: Column) -> Column:
    penalty = F.aggregate(reasons, F.lit(0.0), lambda a, r: a + r["penalty"])
    return F.when(gate_eligible(reasons), F.greatest(F.lit(0.0), 1.0 - penalty)).otherwise(F.lit(0.0))


def gate_adjustment(reasons: Column, cap: float = 0.35) -> Column:
    return F.when(gate_eligible(reasons), -cap * (1.0 - gate_score(reasons))).otherwise(F.lit(-cap))


def with_next(words: Column) -> Column:
    """Words and their neighbouring pairs. ``words`` should be a column of its own: it is read many times."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def topic_words(text: Column) -> Column:
    """Words of three characters or more without stop words; repeats stay."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~among(t, TOPIC_STOPWORDS))


def trend_words(text: Column) -> Column:
    """Words (inner hyphens and apostrophes kept) that audience trends are learned on."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9'-]{2,})"))
    return F.filter(found, lambda t: ~among(t, TREND_STOPWORDS))


#: The vector that ridge models and rankers take, in this order.
MODEL_FEATURES = ("duration_seconds", "word_count", "sentence_count", *FEATURES)
SENTENCE_STOP = r"[.!?][\"'”’)]*(?:\s|$)"


def model_vector(text: Column, tok: Column, duration: Column, word_count: Column, sentence_count: Column) -> Column:
    """The 15 features of a candidate, whose words and sentences were counted when it was cut."""
    f = transcript_features(text, tok, duration, word_count, sentence_count)
    return F.array(*[c.cast("double") for c in (duration, word_count, sentence_count)], *[f[name].cast("double") for name in FEATURES])


def queue_vector(text: Column, tok: Column, duration: Column) -> Column:
    """The same features where only a queue's text is left: words are its tokens, sentences its stops, one at least. Null without a text."""
    stops = F.greatest(F.lit(1), F.regexp_count(text, F.lit(SENTENCE_STOP)))
    return F.when(F.length(F.trim(text)) > 0, model_vector(text, tok, duration, F.size(tok), stops))
