"""DuckDB SQL with the same results, for the operators that SQL can express."""

from __future__ import annotations

from quernstone.llm import op01_quality_divergence as o1
from quernstone.llm.stopwords import ALL_STOP_WORDS, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _text(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def op1() -> str:
    """Counts and verdicts; three rounds of references."""
    listed = ", ".join(f"('{lang}', '{w}')" for lang, words in STOP_WORDS.items() for w in sorted(set(words)))
    classes = ("[aeiou]+", "[b-df-hj-np-tv-z]+", "[A-Z]+", r"\p{L}+", r"\p{N}+", "[.,;:!?''\"()-]+")
    stripped = "\n".join(f"s{i + 1} AS (SELECT *, regexp_replace(r{i}, '{c}', '', 'g') AS r{i + 1} FROM s{i})," for i, c in enumerate(classes))
    half = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END / 2 + CASE WHEN {q} > 0 THEN {q} * ln({q} / (({p} + {q}) / 2)) ELSE 0 END / 2)"
    n = len(o1.CLASSES)
    rounds, before = [], "SELECT doc_id FROM f"
    for k, (chars, words) in enumerate((*o1.TRIM, (o1.CHAR_LIMIT, o1.WORD_LIMIT))):
        known = f"lang IN ({_text(STOP_WORDS)}) AND NOT base_failed AND doc_id IN ({before})"
        total = " + ".join(f"sum(c{i})" for i in range(n))
        char_nats = " + ".join(half(f"(f.c{i} / greatest(f.word_chars, 1))", f"r.q{i}") for i in range(n))
        rounds.append(f"""
ref{k} AS MATERIALIZED (SELECT lang, sum(n_words) AS nw, {", ".join(f"sum(c{i}) / greatest(1, {total}) AS q{i}" for i in range(n))} FROM f WHERE {known} GROUP BY lang HAVING sum(n_words) >= {o1.MIN_REFERENCE}),
share{k} AS MATERIALIZED (SELECT f.lang, c.w, sum(c.n) / greatest(1, any_value(r.nw)) AS q FROM f JOIN common c USING (doc_id) JOIN listed l ON l.lang = f.lang AND l.w = c.w JOIN ref{k} r ON r.lang = f.lang
 WHERE f.{known} GROUP BY f.lang, c.w),
every{k} AS (SELECT lang, sum(q) AS q FROM share{k} GROUP BY lang),
pair{k} AS (SELECT f.*, r.lang AS rl, coalesce(e.q, 0) AS eq, sqrt(greatest(({char_nats}) / {o1._LN2}, 0)) AS cd FROM f JOIN ref{k} r ON r.lang = f.lang OR f.lang IS NULL OR f.lang NOT IN (SELECT lang FROM ref{k}) LEFT JOIN every{k} e ON e.lang = r.lang),
hit{k} AS (SELECT p.doc_id, p.rl, sum(s.q) AS seen, sum(c.n / greatest(p.n_words, 1)) AS own, sum({half("(c.n / greatest(p.n_words, 1))", "s.q")}) AS bins FROM pair{k} p JOIN common c USING (doc_id) JOIN share{k} s ON s.lang = p.rl AND s.w = c.w GROUP BY p.doc_id, p.rl),
far{k} AS (SELECT p.doc_id, min(p.cd) AS cd, min(sqrt(greatest((coalesce(bins, 0) + (p.eq - coalesce(seen, 0)) * {o1._LN2 / 2} + {half("greatest(1 - coalesce(own, 0), 0)", "greatest(1 - p.eq, 0)")}) / {o1._LN2}, 0))) AS wd
 FROM pair{k} p LEFT JOIN hit{k} h ON h.doc_id = p.doc_id AND h.rl = p.rl GROUP BY p.doc_id),
near{k} AS MATERIALIZED (SELECT f.doc_id FROM f LEFT JOIN far{k} x USING (doc_id) WHERE NOT coalesce((word_chars >= {o1.MIN_CHARS} AND cd > {chars} + {o1.CHAR_NOISE} / sqrt(greatest(word_chars, 1)))
 OR (n_words >= {o1.MIN_WORDS} AND wd > {words} + {o1.WORD_NOISE} / sqrt(greatest(n_words, 1))), false))""")
        before = f"SELECT doc_id FROM near{k}"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
listed(lang, w) AS (VALUES {listed}),
ws AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
words AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM ws),
grams AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams WHERE g IS NOT NULL) x WHERE k > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
common AS MATERIALIZED (SELECT doc_id, lower(word) AS w, count(*) AS n FROM words WHERE lower(word) IN ({_text(ALL_STOP_WORDS)}) GROUP BY doc_id, lower(word)),
s0 AS (SELECT doc_id, lang, t, regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g') AS r0 FROM d),
{stripped}
f AS MATERIALIZED (SELECT s6.doc_id, lang, len(ws) AS n_words, length(r0) AS word_chars, length(r4) - length(regexp_replace(r4, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
 coalesce(repeated.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(repeated.n, 0) > 20 * len(ws) AS base_failed, {", ".join(f"length(r{i}) - length(r{i + 1}) AS c{i}" for i in range(n - 1))}, length(r{n - 1}) AS c{n - 1}
 FROM s6 JOIN ws USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
{",".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id IN ({before}) AS kept FROM f
"""


def op7() -> str:
    """All pairs that share a shingle, links among them, and what is reachable."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM ws),
grams AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, g FROM grams WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM ws WHERE len(ws) BETWEEN 1 AND 4) x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, x.b FROM reach r JOIN sym x ON r.b = x.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_divergence": op1(), "op7_near_dedup": op7()}
