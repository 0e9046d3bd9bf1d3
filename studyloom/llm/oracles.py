"""DuckDB SQL of the spelling, quality and hard-negative queries."""

from __future__ import annotations

from . import quality_rules as q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _nibbles() -> list[int]:
    """The CRC-32 of each half byte, from the polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = 0xEDB88320 ^ (c >> 1) if c & 1 else c >> 1
        out.append(c)
    return out


_N = str(_nibbles())

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
octets AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM counted
), hashed AS (
  SELECT *, xor(list_reduce(b, lambda c, x: xor(xor(xor(c, x) >> 4, {_N}[(xor(c, x) & 15) + 1]) >> 4, {_N}[(xor(xor(c, x) >> 4, {_N}[(xor(c, x) & 15) + 1]) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM octets
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
dels AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.key = b.key AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT d.word, w.word FROM dels d JOIN words w ON d.key = w.word
  UNION SELECT w.word, d.word FROM dels d JOIN words w ON d.key = w.word
), best AS (
  SELECT near.word, other, n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place
  FROM near JOIN words ON words.word = other
), formed AS (
  SELECT words.word, n, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n, coalesce(n_near, 0)::BIGINT AS n_near
  FROM words LEFT JOIN (FROM best WHERE place = 1) b ON b.word = words.word
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL
), ends AS (SELECT walk.word, root FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NULL)
SELECT formed.word, n, n_near, form, form_n, root FROM formed JOIN ends ON ends.word = formed.word
"""

_SPACE = "\\x20\\x09-\\x0D"
_KINDS = ("[^a-z]", "[^A-Z]", "[^0-9]", f"[^{_SPACE}]", """[^.,:;''"()-]""", "[^!?]", "[^#*$%&|<>]")
_LATIN = "[^\\x{80}-\\x{27f}]"
_ASCII_REST = f"""[^\\x00-\\x7f]|[a-zA-Z0-9{_SPACE}.,:;''"()!?#*$%&|<>-]"""


def _divergence(own: str, reference: str) -> str:
    """The Jensen-Shannon distance of list columns: counts and shares."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    pairs = f"list_zip(list_transform({own}, lambda v: v::DOUBLE / greatest(list_sum({own}), 1)), {reference})"
    return f"CASE WHEN list_sum({own}) > 0 THEN sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: ({part('z[1]')} + {part('z[2]')}) / 2)))) ELSE 0 END"


QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang FROM documents),
words AS (SELECT rid, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT rid, lang, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM docs)),
windows AS (
  SELECT rid, i, lead(word, 4) OVER d IS NOT NULL AS whole, [word, lead(word) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] AS five
  FROM words WINDOW d AS (PARTITION BY rid ORDER BY i)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS times FROM windows WHERE whole) WHERE times > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY rid
), n_words AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
chars AS (
  SELECT rid, doc_id, lang, {', '.join(f"length(regexp_replace(text, '{k}', '', 'g')) AS c{i}" for i, k in enumerate(_KINDS))},
    length(regexp_replace(text, '{_ASCII_REST}', '', 'g')) AS c7, length(regexp_replace(text, '{_LATIN}', '', 'g')) AS c8, length(text) AS n
  FROM docs
), base AS (
  SELECT c.rid, doc_id, lang, coalesce(w.n, 0) AS n_words, c.n - c3 AS word_chars, c6 AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    [c0, c1, c2, c3, c4, c5, c6, c7, c8, c.n - c0 - c1 - c2 - c3 - c4 - c5 - c6 - c7 - c8] AS chars
  FROM chars c LEFT JOIN n_words w USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN repeated r USING (rid)
), judged AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM base),
langs AS (SELECT lang FROM docs WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {q.LANGUAGES}),
low AS (SELECT rid, lang, translate(word, '{_UPPER}', '{_LOWER}') AS word FROM words),
top AS (
  SELECT lang, word, place FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM low WHERE lang IN (FROM langs) GROUP BY lang, word
  ) WHERE place <= {q.COMMON}
), against AS (
  SELECT rid, l.lang AS other FROM docs JOIN langs l ON docs.lang = l.lang OR docs.lang IS NULL OR docs.lang NOT IN (FROM langs)
), found AS (
  SELECT a.rid, a.other, coalesce(t.place, {q.COMMON} + 1) AS bin, count(*) AS n
  FROM against a JOIN low USING (rid) LEFT JOIN top t ON t.lang = a.other AND t.word = low.word GROUP BY ALL
), hists AS (
  SELECT a.rid, a.other, list(coalesce(f.n, 0) ORDER BY b.bin) AS words
  FROM against a CROSS JOIN (SELECT unnest(range(1, {q.COMMON} + 2)) AS bin) b LEFT JOIN found f ON f.rid = a.rid AND f.other = a.other AND f.bin = b.bin GROUP BY a.rid, a.other
), good AS (
  SELECT j.lang, list_transform(chars, lambda x: floor(x * 1000000 / list_sum(chars))) AS chars, list_transform(words, lambda x: floor(x * 1000000 / list_sum(words))) AS words
  FROM judged j JOIN hists h ON h.rid = j.rid AND h.other = j.lang WHERE NOT base_failed
), sums AS (
  SELECT lang, (SELECT list(s ORDER BY i) FROM (SELECT i, sum(x) AS s FROM (SELECT unnest(g.chars) AS x, generate_subscripts(g.chars, 1) AS i FROM good g WHERE g.lang = l.lang) GROUP BY i)) AS chars,
    (SELECT list(s ORDER BY i) FROM (SELECT i, sum(x) AS s FROM (SELECT unnest(g.words) AS x, generate_subscripts(g.words, 1) AS i FROM good g WHERE g.lang = l.lang) GROUP BY i)) AS words
  FROM (SELECT DISTINCT lang FROM good) l
), refs AS (SELECT lang, list_transform(chars, lambda x: x / list_sum(chars)) AS char_ref, list_transform(words, lambda x: x / list_sum(words)) AS word_ref FROM sums),
far AS (
  SELECT j.rid, {_divergence('j.chars', 'r.char_ref')} AS char_distance, {_divergence('h.words', 'r.word_ref')} AS word_distance
  FROM judged j JOIN hists h USING (rid) JOIN refs r ON r.lang = h.other
), nearest AS (SELECT rid, unnest(arg_min({{'c': char_distance, 'w': word_distance}}, char_distance + word_distance)) FROM far GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR (word_chars + chars[4] >= {q.CHAR_GUARD} AND coalesce(c, 0) > {q.CHAR_LIMIT} + {q.CHAR_MARGIN} / sqrt(word_chars + chars[4]))
    OR (n_words >= {q.WORD_GUARD} AND coalesce(w, 0) > {q.WORD_LIMIT} + {q.WORD_MARGIN} / sqrt(n_words))) AS kept
FROM judged LEFT JOIN nearest USING (rid)
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM scores WHERE same) WHERE place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
) WHERE rank <= 5
"""
