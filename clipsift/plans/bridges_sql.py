"""The bridges in DuckDB's SQL. A query names those it needs in braces; each becomes a common table expression."""

from __future__ import annotations

import re

BRIDGES = {
    "clips": """SELECT l_orderkey AS video, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS clip,
        CASE l_linenumber % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'instagram' ELSE 'tiktok' END AS platform,
        (l_partkey % 300)::DOUBLE AS "start", (l_partkey % 300)::DOUBLE + (20e0 + q * 0.8e0) AS "end", 20e0 + q * 0.8e0 AS duration,
        1e0 + (p % 400e0) / 100e0 AS score, (l_suppkey % 5 + 1)::DOUBLE AS hook, (l_partkey % 5 + 1)::DOUBLE AS completeness,
        ((l_suppkey + l_partkey) % 5 + 1)::DOUBLE AS payoff, ((l_suppkey * 3 + l_linenumber) % 5 + 1)::DOUBLE AS clarity,
        d * 10e0 AS urgency, t * 12.5e0 AS excitement
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) q, min(l_extendedprice) p, min(l_discount) d, min(l_tax) t
              FROM lineitem GROUP BY ALL)""",
    "labels_iv": """SELECT o_orderkey AS video, 'label-' || o_orderkey AS label_id, (o_custkey % 300)::DOUBLE AS "start",
        (o_custkey % 300)::DOUBLE + 30e0 AS "end", substr(o_orderpriority, 1, 1)::INT AS priority FROM orders""",
    "feedback": """SELECT event_id, ts, user_id AS creator, user_id * 10 + event_id % 10 AS clip,
        CASE event_type WHEN 'view' THEN 'presented' WHEN 'click' THEN 'download_original' WHEN 'purchase' THEN 'download_edited'
          WHEN 'signup' THEN 'review_closed_unselected' ELSE 'reject' END AS event_type,
        event_id::DOUBLE % 300e0 AS "start", event_id::DOUBLE % 300e0 + 20e0 + value AS "end", value, event_id % 7 AS display_rank FROM events""",
    "performance": """SELECT o_custkey % 40 AS creator, o_orderkey AS clip, floor(o_totalprice / 1000e0)::BIGINT AS views,
        CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice / 1500e0)::BIGINT WHEN o_orderkey % 3 = 1 THEN 0 END AS engaged_views,
        q AS likes, n AS comments, CASE WHEN o_orderkey % 4 <> 0 THEN q % 11 END AS shares, d * 900e0 AS average_view_percentage,
        CASE WHEN o_orderkey % 5 <> 0 THEN t * 1000e0 END AS completion_rate_percentage, 20e0 + q % 40 AS duration
        FROM orders JOIN (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT q, max(l_discount) d, max(l_tax) t, count(*) n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "words": r"""SELECT doc_id AS video, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL""",
    "candidates": r"""SELECT doc_id, source, lang, regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text,
        len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) * 0.4e0 AS duration,
        len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS word_count,
        greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentence_count FROM documents WHERE text IS NOT NULL""",
    "judged": """SELECT source AS grp, doc_id, 1e0 + 2e0 * quality + doc_id % 3 AS actual, n_chars % 97 / 10e0 AS predicted,
        (n_chars % 13)::DOUBLE AS challenger FROM documents JOIN labels USING (doc_id)""",
    "vectors": """SELECT vec_id, label AS grp, list_transform(embedding, lambda x: x::DOUBLE) AS v, ((vec_id * 7) % 21 - 10) / 10e0 AS outcome FROM embeddings""",
    "word_rows": """SELECT *, "start" + 0.35e0 AS "end" FROM (SELECT video, pos, word, pos * 0.4e0 + coalesce(sum(regexp_matches(word, '{sentence_end!}')::INT) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 1.2e0 AS "start"
        FROM (SELECT video, unnest(w) AS word, unnest(range(len(w)))::INT AS pos FROM {words}))""",
    "asked": """SELECT doc_id AS video, (doc_id % 20)::DOUBLE AS s, (doc_id % 20)::DOUBLE + 15e0 AS e, (doc_id % 20)::DOUBLE + 7.3e0 AS t FROM documents WHERE text IS NOT NULL""",
    "segments": """SELECT conv_id, turn, role, text, turn * 5e0 + conv_id % 3 AS "start", turn * 5e0 + conv_id % 3 + length(text) % 4 + 1e0 AS "end" FROM conversations""",
    # the ones below build on those above
    "platformed": """SELECT *, greatest(-0.18e0, least(0.18e0,
          w1 * greatest(-1e0, 1e0 - abs(duration - pref) / 25e0) + w2 * ((hook - 3e0) / 2e0) + w3 * ((completeness - 3e0) / 2e0)
          + w4 * ((payoff - 3e0) / 2e0) + w5 * ((clarity - 3e0) / 2e0) + w6 * (2e0 * urgency - 1e0) + w7 * (2e0 * excitement - 1e0))) AS adjustment
        FROM {clips} JOIN (VALUES ('youtube', 45e0, 0.05e0, 0.025e0, 0.03e0, 0.035e0, 0.02e0, 0.01e0, 0.01e0), ('instagram', 32e0, 0.05e0, 0.035e0, 0.015e0, 0.02e0, 0.02e0, 0.025e0, 0.045e0),
          ('tiktok', 25e0, 0.06e0, 0.05e0, 0.01e0, 0.02e0, 0.01e0, 0.045e0, 0.045e0)) AS p(platform, pref, w1, w2, w3, w4, w5, w6, w7) USING (platform)""",
    "avgrank": """SELECT grp, doc_id, actual, predicted, challenger,
        rank() OVER (PARTITION BY grp ORDER BY actual) + (count(*) OVER (PARTITION BY grp, actual) - 1) / 2e0 AS ra,
        rank() OVER (PARTITION BY grp ORDER BY predicted) + (count(*) OVER (PARTITION BY grp, predicted) - 1) / 2e0 AS rp FROM {judged}""",
    "heuristic": """SELECT *, greatest(0e0, least(1e0, 0.25e0 * (0.5e0 * clean_start + 0.5e0 * complete_end) + 0.2e0 * hook_signal + 0.15e0 * density_fit
        + 0.15e0 * structure_fit + 0.1e0 * duration_fit + 0.1e0 * lexical_fit + 0.05e0 * filler_control - 0.15e0 * intro_outro)) * 100e0 AS heuristic FROM {features}""",
    "features": """SELECT *, greatest(0e0, least(1e0, 0.5e0 * least(hooks, 2) / 2e0 + 0.3e0 * asks + 0.2e0 * digits)) AS hook_signal,
        greatest(0e0, least(1e0, 1e0 - abs(duration - 40e0) / 30e0)) AS duration_fit, greatest(0e0, least(1e0, 1e0 - abs(words_per_second - 2.5e0) / 1.5e0)) AS density_fit,
        greatest(0e0, least(1e0, 1e0 - abs(sentence_count - 5) / 7e0)) AS structure_fit, greatest(0e0, least(1e0, (lexical_diversity - 0.35e0) / 0.4e0)) AS lexical_fit,
        greatest(0e0, least(1e0, 1e0 - filler_ratio / 0.08e0)) AS filler_control
        FROM (SELECT *, (NOT list_contains({openers!}, coalesce(tok[1], '')))::INT::DOUBLE AS clean_start, regexp_matches(text, '{sentence_end!}')::INT::DOUBLE AS complete_end,
          len(list_filter(tok[1:12], lambda x: list_contains({hooks!}, x))) AS hooks, contains(left(text, 160), '?')::INT AS asks,
          (len(list_filter(tok[1:12], lambda x: regexp_full_match(x, '[0-9]+'))) > 0)::INT AS digits,
          CASE WHEN duration > 0 THEN word_count / duration ELSE 0e0 END AS words_per_second,
          CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok)::DOUBLE ELSE 0e0 END AS lexical_diversity,
          CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda x: list_contains({fillers!}, x))) / len(tok)::DOUBLE ELSE 0e0 END AS filler_ratio,
          regexp_matches(lower(text), '{intro!}')::INT::DOUBLE AS intro_outro
          FROM (SELECT *, list_transform(regexp_extract_all(text, '[a-zA-Z0-9'']+'), lambda x: lower(x)) AS tok FROM {candidates}))""",
}


def _fixed(name: str) -> str:
    from clipsift.functions import text

    lists = {"openers": text.CONTEXT_OPENERS, "hooks": text.HOOK_CUES, "fillers": text.FILLERS}
    quoted = lambda s: s.replace("'", "''")
    if name in lists:
        return "[" + ", ".join(f"'{quoted(w)}'" for w in lists[name]) + "]"
    return quoted({"sentence_end": text.SENTENCE_END, "intro": "|".join(text.INTRO_OUTRO)}[name])


def with_bridges(sql: str) -> str:
    """The SQL with its bridges, and theirs, as leading common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name not in BRIDGES:
                raise KeyError(name)
            need(BRIDGES[name])
            if name not in ordered:
                ordered.append(name)

    need(sql)
    fill = lambda s: re.sub(r"\{(\w+)!\}", lambda m: _fixed(m[1]), re.sub(r"\{(\w+)\}", r"b_\1", s))
    heads = [f"b_{name} AS ({fill(BRIDGES[name])})" for name in ordered]
    body = fill(sql).strip()
    if not heads:
        return body
    if m := re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{', '.join(heads)}, {body[m.end():]}"
    return f"WITH {', '.join(heads)} {body}"
