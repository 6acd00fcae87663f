"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from evenfold.llm.license_scan import PHRASES, TEMPLATES, Choice, Gap, parse
from evenfold.llm.quality_rules import STOP_WORDS, SYMBOLS

SPACE = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS seat FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight,
  row_number() OVER (ORDER BY source IS NULL, encode(source)) AS seq FROM s),
r AS (SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY ratio, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
b AS (SELECT ratio, seq, level FROM l WHERE ratio > level ORDER BY ratio, seq LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN b.seq IS NULL OR (l.ratio, l.seq) < (b.ratio, b.seq) THEN (3 * l.source_size)::DOUBLE ELSE l.weight * b.level END AS target
  FROM l LEFT JOIN b ON true),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE round(t.target)::BIGINT // t.source_size END AS rounds,
  CASE WHEN t.source_size = 0 THEN 0 ELSE round(t.target)::BIGINT % t.source_size END AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.seat) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, max(seat) AS edge FROM (SELECT source, seat, max(upto) AS upto, sum(size) AS size, any_value(rest) AS rest FROM e GROUP BY source, seat)
  WHERE rest > 0 AND upto - size / 2 <= rest GROUP BY source)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * (e.rounds + CASE WHEN e.rest > 0 AND e.seat <= g.edge THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e LEFT JOIN g ON e.source IS NOT DISTINCT FROM g.source
"""

OP1 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT k, w[i:i + 3] AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, sides.b FROM r JOIN sides ON r.b = sides.a),
c AS (SELECT r.a AS k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (k) LEFT JOIN c USING (k)
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""

_STOP = ", ".join(f"'{w}'" for line in STOP_WORDS for w in line.split())
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
pos AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
gram AS (SELECT k, i, w[i:i + 4] AS g FROM pos),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM gram) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY k),
ln AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (regexp_matches(l, '^ *[-*•]')) AS bullets
  FROM ln WHERE length(trim(l, {SPACE})) > 0 GROUP BY k),
q AS (SELECT d.*, len(w) AS n, length(list_aggregate(w, 'string_agg', '')) AS chars,
  len(regexp_extract_all(t, '[{SYMBOLS}]')) AS sym, coalesce(rep.n, 0) AS repeated,
  coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS dup, coalesce(lines.bullets, 0) AS bullets,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stops,
  len(regexp_extract_all(t, '(^|[^\p{{L}}])\p{{Lu}}{{2,}}!')) AS shouted
  FROM d LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)),
v AS (SELECT *, n < 10 OR 100 * repeated > 20 * n AS failed FROM q)
SELECT doc_id, n::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  repeated::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND chars::DOUBLE / n BETWEEN 1.5 AND 14 AND sym::DOUBLE / n <= 0.12 AND shouted::DOUBLE / n <= 0.35
  AND coalesce(dup::DOUBLE / nullif(n_lines, 0), 0) <= 0.35 AND coalesce(bullets::DOUBLE / nullif(n_lines, 0), 0) <= 0.9
  AND (n < 60 OR stops::DOUBLE / n >= 0.02) AS kept
FROM v
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _pattern(parts) -> str:
    """A template as a regular expression over words that each follow a blank."""
    out = ""
    for part in parts:
        if isinstance(part, Gap):
            out += f"(?: [^ ]+){{{part.least},{part.most}}}"
        elif isinstance(part, Choice):
            out += f"(?:{'|'.join(_pattern(run) for run in part.runs)})"
        else:
            out += "".join(f" {w}" for w in part.words)
    return out


_BASE = [(label, _pattern(parse(phrase)).split()) for label, phrase in PHRASES]
_STARTS = ", ".join(
    f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))}), lambda i: i - 1)"
    for _, words in _BASE)
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN len(found[{k + 1}]) > 0 THEN '{label}' END" for k, (label, _) in enumerate(_BASE)) + "], lambda x: x IS NOT NULL)"
_OWN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{_pattern(parse(x))} ') THEN '{label}' END" for label, x in TEMPLATES) + "], lambda x: x IS NOT NULL)"
OP11 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t, [{_STARTS}] AS found FROM d),
l AS (SELECT *, {_LABELS} AS base, {_OWN} AS own, flatten(found) AS places FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, own))), ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
far{r} AS (SELECT x.k, x.p, c.e, sum((x.x - c.x) * (x.x - c.x)) AS far FROM x JOIN c{r} c USING (p, d) GROUP BY ALL),
near{r} AS (SELECT k, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM far{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT x.p, n.e, x.d, sum(x.x) AS s, count(*) AS n FROM x JOIN near{r} n USING (k, p) GROUP BY ALL),
c{r + 1} AS (SELECT c.p, c.e, c.d, CASE WHEN m.n IS NULL THEN c.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS x
  FROM c{r} c LEFT JOIN m{r} m USING (p, e, d))""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT k, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS d, v[i] AS x FROM (SELECT k, v, unnest(range(1, len(v) + 1)) AS i FROM v)),
c0 AS (SELECT p, k AS e, d, x FROM x WHERE k < {entries}),{",".join(steps)},
code AS (SELECT k, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY k),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) AS sha FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN code USING (k), sha
"""


OP12 = _codes_sql()

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER}, {_TERMS}) AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, {_TERMS})) AS term FROM benchmark),
t AS (SELECT k, unnest(w) AS term FROM d),
tf AS (SELECT k, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
m AS (SELECT k, doc_id, 50 + (50 * len(w) * n_docs) // total AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (k) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored JOIN m USING (k) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

SQL: dict[str, str] = {"op1_jaccard_join": OP1, "op2_source_mix": OP2, "op4_vector_file": OP4, "op8_quality_rules": OP8,
                       "op11_license_scan": OP11, "op12_vector_codes": OP12, "op13_lexical_search": OP13}
