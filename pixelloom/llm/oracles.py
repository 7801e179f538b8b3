"""SQL for the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

from pixelloom.llm.quality import QualityRules

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _jsd(p: str, q: str) -> str:
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0::DOUBLE END"
    terms = f"{part(f'{p}[i]', f'{q}[i]')} + {part(f'{q}[i]', f'{p}[i]')}"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {terms})) / 2, 0))"


def quality_sql(rules: QualityRules = QualityRules()) -> str:
    refs = []
    for code in sorted(rules.common_words):
        words, shares = list(rules.common_words[code]), [*map(float, rules.common_words[code].values())]
        classes = [x / sum(rules.character_classes[code]) for x in rules.character_classes[code]]
        refs.append(f"('{code}', {_list(words)}, {_list([*shares, 1 - sum(shares)])}, {_list(classes)}, {rules.max_char_distance[code]}::DOUBLE)")
    every = sorted({w for ws in rules.common_words.values() for w in ws})
    cases = ", ".join("'" + v + "'" for v in sorted({v for w in every for v in (w, w.capitalize(), w.upper())}))
    left = lambda regex: f"length(regexp_replace(t, '{regex}', '', 'g'))"
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
refs(code, ref_words, ref_shares, ref_classes, char_limit) AS (VALUES {", ".join(refs)}),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY 1),
f AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(t) AS chars, {left(SPACE)}::BIGINT AS word_chars, (length(t) - {left("[#*$%&|<>]")})::BIGINT AS n_symbols,
  length(t) - {left("[a-z]")} AS lo, length(t) - {left("[A-Z]")} AS up, length(t) - {left("[0-9]")} AS di, length(t) - {left(SPACE)} AS sp, length(t) - {left("[^" + chr(92) + "x00-" + chr(92) + "x7F]")} AS wi,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, list_transform(list_filter(words, lambda w: w IN ({cases})), lambda w: lower(w)) AS common FROM d),
h AS (SELECT *, [lo, up, di, sp, chars - lo - up - di - sp - n_symbols - wi, n_symbols, wi]::DOUBLE[] AS counts FROM f),
p AS (SELECT h.*, code, ref_shares, ref_classes, char_limit, list_transform(counts, lambda c: c / greatest(chars, 1)) AS classes, list_transform(ref_words, lambda r: len(list_filter(common, lambda c: c = r)) / greatest(n_words, 1)::DOUBLE) AS shares FROM h, refs),
p2 AS (SELECT *, list_concat(shares, [1 - list_sum(shares)]) AS full_shares FROM p),
dist AS (SELECT doc_id, lang, code, {_jsd("classes", "ref_classes")} - char_limit AS dc, {_jsd("full_shares", "ref_shares")} - {rules.max_word_distance}::DOUBLE * sqrt(greatest(1, {rules.full_words}::DOUBLE / greatest(n_words, 1))) AS dw FROM p2),
best AS (SELECT doc_id, coalesce(min(dc) FILTER (WHERE code = lang), min(dc)) AS dc, coalesce(min(dw) FILTER (WHERE code = lang), min(dw)) AS dw FROM dist GROUP BY 1),
o AS (SELECT f.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, dc, dw FROM f LEFT JOIN rep USING (doc_id) JOIN best USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words_base} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (chars < {rules.min_chars} OR dc <= 0) AND (n_words < {rules.min_words} OR dw <= 0) AS kept FROM b"""


LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT *, translate(trim(line, {_TRIM}), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT x.doc_id, line, k, c.key IS NOT NULL AND x.doc_id <> holder AS gone FROM keyed x LEFT JOIN common c ON x.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

CHAT = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*[|]')) + 11)::BIGINT AS formatted_chars,
 regexp_full_match(string_agg(role, ',' ORDER BY turn), '(system,)?user(,assistant,user)*(,assistant)?') AS valid FROM c GROUP BY conv_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op2_line_dedup": LINES, "op4_chat_format": CHAT, "op6_jaccard_join": JACCARD}
