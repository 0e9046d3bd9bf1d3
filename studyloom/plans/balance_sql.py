"""SQL of the alignment by balanced lengths, as common table expressions over recursive queries.

Limits and weights are spelled out here, so that it doesn't follow the library's own values.
"""

from __future__ import annotations

from .forms import SPACE as _SPACE


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def count(c: str) -> str:
    """Sentences of a text."""
    return f"(CASE WHEN NOT regexp_matches({c}, '[^{_SPACE}]') THEN 1 ELSE greatest(1, length(regexp_replace(regexp_replace({c}, '\\p{{Nd}}[.!?]\\p{{Nd}}', '', 'g'), '[^。！？.!?]', '', 'g'))) END)"


def segments(c: str) -> str:
    """The sentences of a text as a list."""
    lines = f"list_transform(string_split({c}, chr(10)), lambda l: {_strip('l')})"
    joined = f"array_to_string(list_transform({lines}, lambda l: CASE WHEN regexp_matches(l, '[。！？!?….]$') THEN l || chr(1) ELSE l END), '')"
    cut = f"regexp_replace(regexp_replace({joined}, '([。！？!?…])', concat('\\1', chr(1)), 'g'), '(\\.)([{_SPACE}])', concat('\\1', chr(1), '\\2'), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def sides(source: str, keys: list[str]) -> str:
    """``solid``: (key, zh, en) of rows with sentences on both sides."""
    key = "{" + ", ".join(f"'{k}': {k}" for k in keys) + "}"
    return f"solid AS MATERIALIZED (SELECT * FROM (SELECT {key} AS key, {segments('zh')} AS zh, {segments('en')} AS en FROM {source}) WHERE len(zh) > 0 AND len(en) > 0)"


def groups(source: str) -> str:
    """``groups``: (key, seq, zf, zt, ef, et) of the cheapest alignment of each row that has one."""
    infinite = "list_transform(range(m + 1), lambda j: 'inf'::DOUBLE)"

    def candidate(ki: int, kj: int) -> str:
        cost = f"r{ki}[j - {kj} + 1] + abs(ln((zp[i + 2] - zp[i + 2 - {ki}]) / (ep[j + 1] - ep[j + 1 - {kj}])) - ln(zp[n + 1] / ep[m + 1])) + 0.05::DOUBLE * abs(zp[i + 2] / zp[n + 1] - ep[j + 1] / ep[m + 1]) + 0.4::DOUBLE * {ki + kj - 2}"
        return f"CASE WHEN j >= {kj} AND i + 1 >= {ki} THEN {cost} ELSE 'inf'::DOUBLE END"

    every = ", ".join(candidate(ki, kj) for ki in range(1, 5) for kj in range(1, 5))
    return f"""sized AS MATERIALIZED (
  SELECT key, len(zh) AS n, len(en) AS m, list_transform(range(len(zh) + 1), lambda i: coalesce(list_sum(list_transform(zh[1:i], lambda s: greatest(1, length(s)))), 0)::DOUBLE) AS zp,
    list_transform(range(len(en) + 1), lambda j: coalesce(list_sum(list_transform(en[1:j], lambda s: greatest(1, length(s)))), 0)::DOUBLE) AS ep
  FROM {source} WHERE greatest(len(zh), len(en)) <= 4 * least(len(zh), len(en))
), filled AS (
  SELECT key, n, m, zp, ep, 0::BIGINT AS i, list_transform(range(m + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS r1, {infinite} AS r2, {infinite} AS r3, {infinite} AS r4, []::BIGINT[] AS picked FROM sized
  UNION ALL
  SELECT key, n, m, zp, ep, i + 1, list_transform(made, lambda c: list_min(c)), r1, r2, r3, list_transform(made, lambda c: CASE WHEN list_min(c) < 'inf'::DOUBLE THEN list_position(c, list_min(c)) ELSE 0 END)
  FROM (SELECT *, list_transform(range(m + 1), lambda j: [{every}]) AS made FROM filled WHERE i < n)
), chosen AS MATERIALIZED (SELECT key, i, picked FROM filled WHERE i > 0),
walked AS (
  SELECT key, n AS i, m AS j, NULL::BIGINT AS zt, NULL::BIGINT AS et FROM sized
  UNION ALL
  SELECT w.key, w.i - (picked[w.j + 1] - 1) // 4 - 1, w.j - (picked[w.j + 1] - 1) % 4 - 1, w.i, w.j FROM walked w JOIN chosen c ON c.key = w.key AND c.i = w.i WHERE w.i > 0
), groups AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS seq, i AS zf, zt, j AS ef, et FROM walked WHERE zt IS NOT NULL)"""


def pairs(source: str, made: str) -> str:
    """``paired``: the pairs of the groups; a row without groups is one pair of all its text."""
    return f"""paired AS MATERIALIZED (
  SELECT key, seq::INT AS seq, zf::INT AS zh_from, zt::INT AS zh_to, ef::INT AS en_from, et::INT AS en_to, array_to_string(zh[zf + 1:zt], '') AS zh, array_to_string(en[ef + 1:et], ' ') AS en,
    CASE WHEN zt - zf + et - ef > 2 THEN 'merged' ELSE 'direct' END AS how, (100 - 12 * (zt - zf + et - ef - 2)) / 100 AS confidence FROM {made} JOIN {source} USING (key)
  UNION ALL
  SELECT key, 0, 0, len(zh)::INT, 0, len(en)::INT, array_to_string(zh, ' '), array_to_string(en, ' '), 'whole', 0.2 FROM {source} WHERE key NOT IN (SELECT key FROM {made})
)"""


def flagged(source: str, low: str) -> str:
    """``flagged``: pairs with lowered confidence and what flags them; ``low``: where a low confidence does, too."""
    own = "length(en) / length(zh)"
    base = f"ratio * ({count('en')} / {count('zh')})"
    off = f"ratio > 0 AND ({own} < {base} / 2 OR {own} > {base} * 2)"
    return f"""measured AS (SELECT *, coalesce(sum(length(en)) OVER (PARTITION BY key) / nullif(sum(length(zh)) OVER (PARTITION BY key), 0), 0) AS ratio FROM {source}),
lowered AS (SELECT * REPLACE (CASE WHEN zh = '' OR en = '' THEN least(confidence, 0.3) WHEN {off} THEN least(confidence, 0.4) ELSE confidence END AS confidence), CASE WHEN zh = '' OR en = '' THEN 'empty' WHEN {off} THEN 'length_ratio' END AS first_flag FROM measured),
flagged AS (SELECT * EXCLUDE (first_flag), coalesce(first_flag, CASE WHEN ({low}) AND confidence < 0.55 THEN 'merge' END) AS flagged_by FROM lowered)"""
