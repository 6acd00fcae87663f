"""The registered queries as DuckDB SQL, row by row and without profiles.

Each SQL text is put together from named common table expressions. Formulas differ from the
Spark side on purpose: features by windows over rows, swap costs by brute force, silhouettes from
all pairs, round loops as recursive queries.
"""

from __future__ import annotations

from evenfold.functions.text import NULL_TOKENS
from evenfold.sources.learners import LEARNERS, LEARNERS_DIRTY

SIZE = 10
SEED = 42
N_GROUPS = 5


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def _capital(text: str) -> str:
    return f"(upper({text}[1:1]) || lower({text}[2:]))"


def _title(text: str) -> str:
    runs = f"regexp_extract_all({text}, '\\p{{L}}+|\\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda s: concat(upper(s[1:1]), lower(s[2:]))), '')"


def _clean(source: str, scores: str) -> str:
    gender = _capital(_strip("Gender"))
    return f"""SELECT cohort_id, row_id, Name,
    CASE {gender} WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE {gender} END AS Gender,
    {scores}, {_capital(_strip("Learning_Style"))} AS Learning_Style, {_title(_strip("Diversity"))} AS Diversity
  FROM {source}"""


_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def _token(column: str) -> str:
    return f"CASE WHEN {_strip(column)} NOT IN ({_TOKENS}) THEN {column} END AS {column}"


_TEXT = ("Name", "Gender", "Motivation", "Self_Esteem", "Work_Ethic", "Learning_Style", "Diversity")
_SCORES = ("Motivation", "Self_Esteem", "Work_Ethic")

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def _r6(value: str) -> str:
    return f"round({value}, 6) + 0.0"


# --- people -------------------------------------------------------------------------------
_cte("raw", LEARNERS)
_cte("dirty", f"SELECT cohort_id, row_id, {', '.join(_token(c) for c in _TEXT)} FROM ({LEARNERS_DIRTY}) AS d")
_cte("people", _clean("raw", ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in _SCORES)), "raw")
_cte("sizes", "SELECT cohort_id, count(*) AS n FROM people GROUP BY cohort_id", "people")
_cte("numbered", """SELECT p.*, s.n, row_number() OVER (PARTITION BY p.cohort_id ORDER BY row_id) AS nth
  FROM people p JOIN sizes s USING (cohort_id)""", "people", "sizes")
_cte("stripe", f"""SELECT *, CAST((nth - 1) % greatest(2, n // {SIZE}) AS INT) AS group_id, 'stripe' AS run
  FROM numbered""", "numbered")
_cte("chunk", "SELECT *, CAST((nth - 1) // 5 AS INT) AS group_id, 'chunk' AS run FROM numbered", "numbered")

# --- features -----------------------------------------------------------------------------
_cte("styles", """SELECT cohort_id, Learning_Style AS style,
    2 + row_number() OVER (PARTITION BY cohort_id ORDER BY Learning_Style) AS pos
  FROM (SELECT DISTINCT cohort_id, Learning_Style FROM people)""", "people")
_cte("raw_features", """SELECT cohort_id, row_id, 0 AS pos, Motivation AS x FROM people
  UNION ALL SELECT cohort_id, row_id, 1, Self_Esteem FROM people
  UNION ALL SELECT cohort_id, row_id, 2, Work_Ethic FROM people
  UNION ALL SELECT p.cohort_id, p.row_id, s.pos, CASE WHEN p.Learning_Style = s.style THEN 1.0 ELSE 0.0 END
  FROM people p JOIN styles s USING (cohort_id)""", "people", "styles")
_cte("features", """SELECT cohort_id, row_id, CAST(pos AS INT) AS pos, x, z,
    CAST(round(z * 1000000) AS BIGINT) AS q
  FROM (SELECT *, CASE WHEN min(x) OVER w = max(x) OVER w THEN 0.0
      ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z
    FROM raw_features WINDOW w AS (PARTITION BY cohort_id, pos))""", "raw_features")
_cte("vectors", """SELECT p.*, v.z, v.q FROM people p JOIN (
    SELECT cohort_id, row_id, list(z ORDER BY pos) AS z, list(q ORDER BY pos) AS q
    FROM features GROUP BY cohort_id, row_id) v USING (cohort_id, row_id)""", "people", "features")
_cte("spans", """SELECT cohort_id, max(Motivation) - min(Motivation) AS sm, max(Self_Esteem) - min(Self_Esteem) AS se,
    max(Work_Ethic) - min(Work_Ethic) AS sw FROM people GROUP BY cohort_id""", "people")

_L1 = "CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: abs(a.q[i] - b.q[i]))) AS BIGINT)"
_L2 = "sqrt(list_sum(list_transform(range(1, len(a.z) + 1), lambda i: (a.z[i] - b.z[i]) * (a.z[i] - b.z[i]))))"


def _term(column: str, span: str) -> str:
    return f"CASE WHEN s.{span} = 0 THEN 0.0 ELSE abs(a.{column} - b.{column}) / s.{span} END"


def _same(column: str) -> str:
    return f"CASE WHEN a.{column} IS NOT DISTINCT FROM b.{column} THEN 0.0 ELSE 1.0 END"


_GOWER = "(" + " + ".join(
    [_term("Motivation", "sm"), _term("Self_Esteem", "se"), _term("Work_Ethic", "sw")]
    + [_same(c) for c in ("Gender", "Diversity", "Learning_Style")]) + ") / 6"

# All pairs of people of a cohort, both ways round.
_cte("pairs", f"""SELECT a.cohort_id, a.row_id AS i, b.row_id AS j, {_L1} AS l1, {_L2} AS l2, {_GOWER} AS gower
  FROM vectors a JOIN vectors b ON a.cohort_id = b.cohort_id JOIN spans s ON s.cohort_id = a.cohort_id""",
     "vectors", "spans")
_cte("dist_l1", "SELECT cohort_id, i, j, l1 AS d FROM pairs", "pairs")
_cte("dist_gower", "SELECT cohort_id, i, j, CAST(round(gower * 1000000) AS BIGINT) AS d FROM pairs", "pairs")


def _profile_pairs(value: str, keys: str) -> str:
    return f"""SELECT p.cohort_id, p.i AS id_a, p.j AS id_b, a.n AS people_a, b.n AS people_b, {value} AS dist
  FROM pairs p
  JOIN (SELECT cohort_id, min(row_id) AS id, count(*) AS n FROM people GROUP BY cohort_id, {keys}) a
    ON a.cohort_id = p.cohort_id AND a.id = p.i
  JOIN (SELECT cohort_id, min(row_id) AS id, count(*) AS n FROM people GROUP BY cohort_id, {keys}) b
    ON b.cohort_id = p.cohort_id AND b.id = p.j
  WHERE p.i < p.j"""


_SKILL = "Motivation, Self_Esteem, Work_Ethic, Learning_Style"

# --- first centres ------------------------------------------------------------------------
_DRAW = f"((row_id % 2147483648) * 2654435761 + {SEED} * 40503) % 4294967296"


def _slots(name: str, k: str) -> None:
    _cte(name, f"""SELECT cohort_id, CAST(nth - 1 AS INT) AS slot, row_id FROM (
      SELECT p.cohort_id, row_id, n, row_number() OVER (PARTITION BY p.cohort_id ORDER BY {_DRAW}, row_id) AS nth
      FROM people p JOIN sizes USING (cohort_id)) WHERE nth <= {k}""", "people", "sizes")


_slots("slots", f"greatest(1, n // {SIZE})")
_slots("slots_fixed", str(N_GROUPS))
_slots("slots_evaluate", f"least(greatest(2, n // {SIZE}), n)")

_GAP1 = "list_sum(list_transform(range(1, len(v.q) + 1), lambda i: abs(v.q[i] - c.q[i])))"
_GAP2 = ("list_sum(list_transform(range(1, len(v.q) + 1), "
         "lambda i: CAST(v.q[i] - c.q[i] AS DOUBLE) * CAST(v.q[i] - c.q[i] AS DOUBLE)))")
for _name, _gap in (("assign_euclidean", _GAP2), ("assign_manhattan", _GAP1)):
    _cte(_name, f"""SELECT v.cohort_id, v.row_id, arg_min(s.slot, ({_gap}, s.slot)) AS slot
  FROM vectors v JOIN slots s ON s.cohort_id = v.cohort_id
  JOIN vectors c ON c.cohort_id = s.cohort_id AND c.row_id = s.row_id
  GROUP BY v.cohort_id, v.row_id""", "vectors", "slots")
_cte("centroid_update", """SELECT a.cohort_id, a.slot, f.pos, CAST(round(sum(f.q) / count(*)) AS BIGINT) AS centroid_q
  FROM assign_euclidean a JOIN features f USING (cohort_id, row_id) GROUP BY a.cohort_id, a.slot, f.pos
  UNION ALL
  SELECT s.cohort_id, s.slot, f.pos, f.q FROM slots s JOIN features f USING (cohort_id, row_id)
  WHERE (s.cohort_id, s.slot) NOT IN (SELECT (cohort_id, slot) FROM assign_euclidean)""",
     "assign_euclidean", "features", "slots")


# --- round loops as recursive queries -----------------------------------------------------
def _lloyd(name: str, gap: str, slots: str, cap: int = 300, of: str = "") -> None:
    """``name``: final (cohort_id, row_id, label); ``of``: what the names of the points' tables begin with."""
    _cte(f"{name}_loop", f"""
  SELECT s.cohort_id, 0 AS r, CAST([] AS INT[]) AS labels, list(v.q ORDER BY s.slot) AS centres, true AS active
  FROM {slots} s JOIN {of}vectors v USING (cohort_id, row_id) GROUP BY s.cohort_id
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT * FROM {name}_loop WHERE active AND r < {cap}),
    seats AS (SELECT cohort_id, unnest(range(len(centres))) AS slot, unnest(centres) AS q FROM cur),
    near AS (SELECT v.cohort_id, v.row_id, CAST(arg_min(c.slot, ({gap}, c.slot)) AS INT) AS slot
      FROM {of}vectors v JOIN seats c ON c.cohort_id = v.cohort_id GROUP BY v.cohort_id, v.row_id),
    fresh AS (SELECT cohort_id, list(slot ORDER BY row_id) AS labels FROM near GROUP BY cohort_id),
    sums AS (SELECT n.cohort_id, n.slot, f.pos, CAST(round(sum(f.q) / count(*)) AS BIGINT) AS m
      FROM near n JOIN {of}features f USING (cohort_id, row_id) GROUP BY n.cohort_id, n.slot, f.pos),
    means AS (SELECT cohort_id, slot, list(m ORDER BY pos) AS q FROM sums GROUP BY cohort_id, slot),
    moved AS (SELECT s.cohort_id, list(coalesce(m.q, s.q) ORDER BY s.slot) AS centres
      FROM seats s LEFT JOIN means m USING (cohort_id, slot) GROUP BY s.cohort_id)
    SELECT c.cohort_id, c.r + 1, f.labels, m.centres, f.labels <> c.labels
    FROM cur c JOIN fresh f USING (cohort_id) JOIN moved m USING (cohort_id))""", slots, f"{of}vectors", f"{of}features")
    _cte(name, f"""SELECT n.cohort_id, n.row_id, l.labels[n.nth] AS label FROM {of}numbered n JOIN (
    SELECT cohort_id, arg_max(labels, r) AS labels FROM {name}_loop GROUP BY cohort_id) l USING (cohort_id)""",
         f"{name}_loop", f"{of}numbered")


def _pam(name: str, dist: str, slots: str, cap: int = 200) -> None:
    """``name_medoids``: (cohort_id, slot, row_id); ``name``: final (cohort_id, row_id, label)."""
    near = """SELECT m.cohort_id, d.i, arg_min(m.slot, (d.d, m.slot)) AS n1, min(d.d) AS d1,
        coalesce(list_sort(list(d.d))[2], 1000000000000) AS d2
      FROM {medoids} m JOIN {dist} d ON d.cohort_id = m.cohort_id AND d.j = m.m GROUP BY m.cohort_id, d.i"""
    _cte(f"{name}_loop", f"""
  SELECT cohort_id, 0 AS r, list(row_id ORDER BY slot) AS medoids, true AS active FROM {slots} GROUP BY cohort_id
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT * FROM {name}_loop WHERE active AND r < {cap}),
    seats AS (SELECT cohort_id, unnest(range(len(medoids))) AS slot, unnest(medoids) AS m FROM cur),
    near AS ({near.format(medoids="seats", dist=dist)}),
    now AS (SELECT cohort_id, sum(d1) AS cost FROM near GROUP BY cohort_id),
    tried AS (SELECT s.cohort_id, s.slot, d.j AS cand,
        sum(least(d.d, CASE WHEN n.n1 = s.slot THEN n.d2 ELSE n.d1 END)) AS cost
      FROM seats s JOIN near n ON n.cohort_id = s.cohort_id
      JOIN {dist} d ON d.cohort_id = n.cohort_id AND d.i = n.i GROUP BY s.cohort_id, s.slot, d.j),
    best AS (SELECT t.cohort_id, min((t.slot, t.cand)) AS swap FROM tried t JOIN now USING (cohort_id)
      JOIN cur USING (cohort_id)
      WHERE t.cost < now.cost AND NOT list_contains(cur.medoids, t.cand) GROUP BY t.cohort_id)
    SELECT c.cohort_id, c.r + 1,
      CASE WHEN b.swap IS NULL THEN c.medoids ELSE list_transform(range(len(c.medoids)),
        lambda s: CASE WHEN s = b.swap[1] THEN b.swap[2] ELSE c.medoids[s + 1] END) END,
      b.swap IS NOT NULL
    FROM cur c LEFT JOIN best b USING (cohort_id))""", slots, dist)
    _cte(f"{name}_medoids", f"""SELECT cohort_id, unnest(range(len(medoids))) AS slot, unnest(medoids) AS m FROM (
    SELECT cohort_id, arg_max(medoids, r) AS medoids FROM {name}_loop GROUP BY cohort_id)""", f"{name}_loop")
    _cte(name, f"""SELECT cohort_id, i AS row_id, CAST(n1 AS INT) AS label FROM (
    {near.format(medoids=f"{name}_medoids", dist=dist)})""", f"{name}_medoids", dist)


_lloyd("kmeans_l2", _GAP2, "slots")
_lloyd("kmeans_l1", _GAP1, "slots")
_pam("pam_l1", "dist_l1", "slots")
_pam("pam_gower", "dist_gower", "slots")
_cte("dist_given", """SELECT a.cohort_id, a.row_id AS i, b.row_id AS j, CASE WHEN a.row_id = b.row_id THEN 0 ELSE
    CAST(abs(a.Motivation - b.Motivation) AS BIGINT) * 1000000 + CASE WHEN a.Gender IS NOT DISTINCT FROM b.Gender THEN 0 ELSE 700000 END
    + CASE WHEN a.Diversity IS NOT DISTINCT FROM b.Diversity THEN 0 ELSE 300000 END + (a.row_id + b.row_id) % 97 * 1000 END AS d
  FROM people a JOIN people b ON a.cohort_id = b.cohort_id""", "people")
_pam("pam_given", "dist_given", "slots")
_cte("given_rows", "SELECT run, cohort_id, row_id, group_id FROM stripe UNION ALL SELECT run, cohort_id, row_id, group_id FROM chunk", "stripe", "chunk")
_cte("given_sizes", "SELECT run, cohort_id, group_id, count(*) AS size FROM given_rows GROUP BY ALL", "given_rows")
_cte("given_reach", """SELECT l.run, l.cohort_id, l.row_id, l.group_id AS own, r.group_id AS other, sum(d.d) AS total
  FROM given_rows l JOIN dist_given d ON d.cohort_id = l.cohort_id AND d.i = l.row_id
  JOIN given_rows r ON r.run = l.run AND r.cohort_id = l.cohort_id AND r.row_id = d.j GROUP BY ALL""", "given_rows", "dist_given")
_cte("given_parts", """SELECT e.run, e.cohort_id, e.row_id, max(CASE WHEN own = other THEN size END) AS own_size,
    max(CASE WHEN own = other THEN total / nullif(size - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / size END) AS b
  FROM given_reach e JOIN given_sizes g ON g.run = e.run AND g.cohort_id = e.cohort_id AND g.group_id = e.other GROUP BY ALL""",
     "given_reach", "given_sizes")
_cte("given_silhouette", """SELECT run, cohort_id, avg(CASE WHEN own_size = 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
    ELSE (b - a) / greatest(a, b) END) AS silhouette FROM given_parts GROUP BY ALL""", "given_parts")

_cte("first_medoids", "SELECT cohort_id, slot, row_id AS m FROM slots", "slots")
_cte("medoid_near", """SELECT m.cohort_id, d.i, arg_min(m.slot, (d.d, m.slot)) AS slot, min(d.d) AS d1
  FROM first_medoids m JOIN dist_l1 d ON d.cohort_id = m.cohort_id AND d.j = m.m GROUP BY m.cohort_id, d.i""",
     "first_medoids", "dist_l1")


# --- principal axes as projections --------------------------------------------------------
def _axis(name: str, matrix: str) -> None:
    """``name``: (cohort_id, i, j, v) of the projection on the leading axis of ``matrix``, by squaring it again and again."""
    _cte(f"{name}_loop", f"""
  SELECT cohort_id, 0 AS r, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY cohort_id) AS v FROM {matrix}
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT * FROM {name}_loop WHERE r < 30),
    squared AS (SELECT a.cohort_id, a.r + 1 AS r, a.i, b.j, sum(a.v * b.v) AS v FROM cur a
      JOIN cur b ON b.cohort_id = a.cohort_id AND b.i = a.j GROUP BY a.cohort_id, a.r, a.i, b.j)
    SELECT cohort_id, r, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY cohort_id) FROM squared)""", matrix)
    _cte(name, f"SELECT cohort_id, i, j, v FROM {name}_loop WHERE r = 30", f"{name}_loop")


_cte("covariances", """SELECT a.cohort_id, a.pos AS i, b.pos AS j, covar_samp(a.z, b.z) AS v
  FROM features a JOIN features b ON a.cohort_id = b.cohort_id AND a.row_id = b.row_id GROUP BY ALL""", "features")
_axis("axis1", "covariances")
_cte("values1", "SELECT cohort_id, sum(p.v * c.v) AS value FROM axis1 p JOIN covariances c USING (cohort_id, i, j) GROUP BY ALL", "axis1", "covariances")
_cte("deflated", """SELECT c.cohort_id, c.i, c.j, c.v - value * p.v AS v FROM covariances c JOIN axis1 p USING (cohort_id, i, j)
  JOIN values1 USING (cohort_id)""", "covariances", "axis1", "values1")
_axis("axis2", "deflated")
_cte("explained", """SELECT cohort_id, (any_value(value) + sum(q.v * c.v)) / sum(CASE WHEN i = j THEN c.v END) AS explained
  FROM covariances c JOIN axis2 q USING (cohort_id, i, j) JOIN values1 USING (cohort_id) GROUP BY cohort_id""", "covariances", "axis2", "values1")


def _squared(points: str, keys: str, value: str) -> str:
    """Squared positions of ``points`` (one row per place ``pos``) on both axes."""
    return f"""SELECT {keys}, {_r6(f"sum(a.{value} * p.v * b.{value})")} AS pc1_squared, {_r6(f"sum(a.{value} * q.v * b.{value})")} AS pc2_squared
  FROM {points} a JOIN {points} b USING ({keys}) JOIN axis1 p ON p.cohort_id = a.cohort_id AND p.i = a.pos AND p.j = b.pos
  JOIN axis2 q ON q.cohort_id = a.cohort_id AND q.i = a.pos AND q.j = b.pos GROUP BY {keys}"""


# --- equal sizes --------------------------------------------------------------------------
def _sized(name: str, labels: str, gap: str | None, size: int = SIZE) -> None:
    """``name``: (cohort_id, row_id, group_id); ``name_core``, ``name_centers`` on the way."""
    _cte(f"{name}_core", f"""SELECT cohort_id, row_id, rn, n // {size} AS n_groups,
      CAST(CASE WHEN n < {size} THEN 0 WHEN rn <= n // {size} * {size} THEN (rn - 1) // {size} END AS INT) AS group_id
    FROM (SELECT l.cohort_id, l.row_id, n, row_number() OVER (PARTITION BY l.cohort_id ORDER BY label, l.row_id) AS rn
      FROM {labels} l JOIN sizes USING (cohort_id))""", labels, "sizes")
    _cte(f"{name}_centers", f"""SELECT cohort_id, group_id, pos, CAST(round(sum(q) / count(*)) AS BIGINT) AS q
    FROM {name}_core JOIN features USING (cohort_id, row_id) WHERE group_id IS NOT NULL
    GROUP BY cohort_id, group_id, pos""", f"{name}_core", "features")
    if gap is None:
        _cte(f"{name}_fill", f"""SELECT cohort_id, row_id, CAST((rn - 1 - n_groups * {size}) % n_groups AS INT) AS group_id
      FROM {name}_core WHERE group_id IS NULL""", f"{name}_core")
    else:
        _cte(f"{name}_fill", f"""SELECT k.cohort_id, k.row_id, arg_min(c.group_id, ({gap}, c.group_id)) AS group_id
      FROM {name}_core k JOIN vectors v USING (cohort_id, row_id)
      JOIN (SELECT cohort_id, group_id, list(q ORDER BY pos) AS q FROM {name}_centers GROUP BY cohort_id, group_id) c
        ON c.cohort_id = k.cohort_id
      WHERE k.group_id IS NULL GROUP BY k.cohort_id, k.row_id""", f"{name}_core", f"{name}_centers", "vectors")
    _cte(name, f"""SELECT cohort_id, row_id, group_id FROM {name}_core WHERE group_id IS NOT NULL
    UNION ALL SELECT cohort_id, row_id, group_id FROM {name}_fill""", f"{name}_core", f"{name}_fill")


_cte("start_labels", "SELECT cohort_id, row_id, slot AS label FROM assign_manhattan", "assign_manhattan")
_sized("sized", "start_labels", _GAP1)
_sized("sized_turn", "start_labels", None)
_sized("grown", "pam_l1", _GAP1)


# --- isolation ----------------------------------------------------------------------------
def _isolated(labels: str) -> str:
    return f"""SELECT cohort_id, group_id, CASE WHEN w = 1 THEN 'female_isolated' ELSE 'male_isolated' END AS isolation_type
  FROM (SELECT cohort_id, group_id, count(*) AS n, count(*) FILTER (Gender = 'Female') AS w,
      count(*) FILTER (Gender = 'Male') AS m
    FROM {labels} GROUP BY cohort_id, group_id)
  WHERE n >= 4 AND ((w = 1 AND m > 1) OR (m = 1 AND w > 1))"""


def _lone_categories(labels: str) -> str:
    return f"""SELECT cohort_id, group_id, Diversity, concat(Diversity, '_isolated') AS isolation_type
  FROM (SELECT cohort_id, group_id, Diversity, count(*) AS c,
      sum(count(*)) OVER (PARTITION BY cohort_id, group_id) AS n
    FROM {labels} GROUP BY cohort_id, group_id, Diversity)
  WHERE c = 1 AND n > 1 AND Diversity IS NOT NULL"""


def _swaps(name: str, labels: str, flagged: str, trait: str, rule: str) -> None:
    """``name_log``: swaps; ``name``: (cohort_id, row_id, group_id) after them.

    ``flagged`` gives cohort_id, turn, group_id, isolation_type, wanted. ``rule`` is the
    condition on incoming ``a`` and outgoing ``b``.
    """
    _cte(f"{name}_flagged", flagged, labels)
    _cte(f"{name}_index", f"""SELECT cohort_id, row_id, group_id, Gender, Diversity,
      row_number() OVER (PARTITION BY cohort_id ORDER BY row_id) AS at FROM {labels}""", labels)
    _cte(f"{name}_loop", f"""
  SELECT cohort_id, CAST(0 AS BIGINT) AS r, list(group_id ORDER BY row_id) AS labels, CAST(NULL AS INT) AS group_id,
    CAST(NULL AS VARCHAR) AS isolation_type, CAST(NULL AS BIGINT) AS in_id, CAST(NULL AS INT) AS donor_group,
    CAST(NULL AS BIGINT) AS out_id, CAST(NULL AS BIGINT) AS dist
  FROM {name}_index GROUP BY cohort_id
  UNION ALL
  SELECT * FROM (
    WITH cur AS (SELECT c.cohort_id, c.r, c.labels, f.group_id AS g, f.isolation_type, f.wanted
      FROM {name}_loop c JOIN {name}_flagged f ON f.cohort_id = c.cohort_id AND f.turn = c.r + 1),
    placed AS (SELECT p.cohort_id, p.row_id, p.Gender, p.Diversity, c.g, c.wanted, c.labels[p.at] AS grp, {trait} AS trait
      FROM cur c JOIN {name}_index p ON p.cohort_id = c.cohort_id),
    counted AS (SELECT *, count(*) OVER (PARTITION BY cohort_id, grp, trait) AS held FROM placed),
    options AS (SELECT a.cohort_id, d.d AS dist, a.grp AS donor, a.row_id AS in_id, b.row_id AS out_id
      FROM counted a JOIN counted b ON a.cohort_id = b.cohort_id AND a.grp <> a.g AND b.grp = b.g
        AND a.trait = a.wanted AND ({rule})
      JOIN dist_l1 d ON d.cohort_id = a.cohort_id AND d.i = a.row_id AND d.j = b.row_id),
    best AS (SELECT cohort_id, min((dist, donor, in_id, out_id)) AS s FROM options GROUP BY cohort_id)
    SELECT c.cohort_id, c.r + 1, CASE WHEN b.s IS NULL THEN c.labels ELSE (
        SELECT list(CASE WHEN p.row_id = b.s[3] THEN c.g WHEN p.row_id = b.s[4] THEN b.s[2] ELSE c.labels[p.at] END
          ORDER BY p.row_id) FROM {name}_index p WHERE p.cohort_id = c.cohort_id) END,
      CASE WHEN b.s IS NOT NULL THEN c.g END, CASE WHEN b.s IS NOT NULL THEN c.isolation_type END,
      b.s[3], b.s[2], b.s[4], b.s[1]
    FROM cur c LEFT JOIN best b USING (cohort_id))""", f"{name}_index", f"{name}_flagged", "dist_l1")
    _cte(f"{name}_log", f"""SELECT cohort_id, CAST(r AS INT) AS round, group_id, isolation_type, in_id, donor_group,
      out_id, dist FROM {name}_loop WHERE in_id IS NOT NULL""", f"{name}_loop")
    _cte(name, f"""SELECT p.cohort_id, p.row_id, CAST(l.labels[p.at] AS INT) AS group_id FROM {name}_index p JOIN (
    SELECT cohort_id, arg_max(labels, r) AS labels FROM {name}_loop GROUP BY cohort_id) l USING (cohort_id)""",
         f"{name}_loop", f"{name}_index")


_GENDER_RULE = """a.held > 2 AND b.trait = CASE a.wanted WHEN 'Female' THEN 'Male' ELSE 'Female' END"""
_DIVERSITY_RULE = """(a.held > 2 OR a.held = 1) AND b.trait <> b.wanted AND (b.held > 2 OR b.held = 1)
        AND a.Gender = b.Gender"""


def _gender_flags(labels: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY group_id) AS turn,
    CASE isolation_type WHEN 'female_isolated' THEN 'Female' ELSE 'Male' END AS wanted FROM ({_isolated(labels)})"""


def _diversity_flags(labels: str) -> str:
    return f"""SELECT cohort_id, group_id, isolation_type, Diversity AS wanted,
    row_number() OVER (PARTITION BY cohort_id ORDER BY group_id, Diversity) AS turn FROM ({_lone_categories(labels)})"""


def _with_people(name: str, labels: str, label_column: str = "group_id") -> None:
    _cte(name, f"SELECT p.*, CAST(l.{label_column} AS INT) AS group_id FROM people p JOIN {labels} l USING (cohort_id, row_id)",
         "people", labels)


_swaps("fixed", "chunk", _gender_flags("chunk"), "p.Gender", _GENDER_RULE)
_swaps("mixed", "chunk", _diversity_flags("chunk"), "p.Diversity", _DIVERSITY_RULE)
_with_people("grown_people", "grown")
_swaps("generated", "grown_people", _gender_flags("grown_people"), "p.Gender", _GENDER_RULE)
_lloyd("kmeans_five", _GAP2, "slots_fixed")
_pam("pam_five", "dist_l1", "slots_fixed")
_sized("five_means", "kmeans_five", None)
_sized("five_medoids", "pam_five", None)
_with_people("five_people", "kmeans_five", "label")
_swaps("five_fixed", "five_people", _gender_flags("five_people"), "p.Gender", _GENDER_RULE)
_with_people("five_fixed_people", "five_fixed")
_swaps("five_mixed", "five_fixed_people", _diversity_flags("five_fixed_people"), "p.Diversity", _DIVERSITY_RULE)

# --- scores -------------------------------------------------------------------------------
for _run, (_labels, _gap) in {
    "kmeans_euclidean": ("t_means_l2", _GAP2), "kmeans_manhattan": ("t_means_l1", _GAP1),
    "kmedoids_manhattan": ("t_pam_l1", _GAP1), "kmedoids_gower": ("t_pam_gower", _GAP1),
}.items():
    if "means" in _labels:
        _lloyd(_labels, _GAP2 if _labels.endswith("l2") else _GAP1, "slots_evaluate")
    else:
        _pam(_labels, "dist_l1" if _labels.endswith("l1") else "dist_gower", "slots_evaluate")
    _sized(f"run_{_run}", _labels, _gap)


def _scores(name: str, runs: dict[str, tuple[str, str]]) -> None:
    """``name``: run, cohort_id and all scores; ``runs``: run -> (labels, silhouette distance)."""
    needs = tuple(labels for labels, _ in runs.values())
    union = " UNION ALL ".join(
        f"SELECT '{run}' AS run, '{metric}' AS metric, cohort_id, row_id, group_id FROM {labels}"
        for run, (labels, metric) in runs.items())
    _cte(f"{name}_rows", f"""SELECT l.*, p.Gender, p.Diversity, p.Motivation, p.Self_Esteem, p.Work_Ethic, p.Learning_Style
    FROM ({union}) l JOIN people p USING (cohort_id, row_id)""", "people", *needs)
    _cte(f"{name}_groups", f"""SELECT run, metric, cohort_id, group_id, count(*) AS size FROM {name}_rows
    GROUP BY run, metric, cohort_id, group_id""", f"{name}_rows")
    _cte(f"{name}_summary", f"""SELECT run, metric, cohort_id, CAST(sum(size) AS BIGINT) AS n_samples,
      count(*) AS n_clusters FROM {name}_groups GROUP BY run, metric, cohort_id""", f"{name}_groups")
    _cte(f"{name}_reach", f"""SELECT l.run, l.cohort_id, l.row_id, l.group_id AS own, r.group_id AS other,
      sum(CASE WHEN l.metric = 'gower' THEN p.gower ELSE p.l2 END) AS total
    FROM {name}_rows l JOIN pairs p ON p.cohort_id = l.cohort_id AND p.i = l.row_id
    JOIN {name}_rows r ON r.run = l.run AND r.cohort_id = l.cohort_id AND r.row_id = p.j
    GROUP BY l.run, l.cohort_id, l.row_id, l.group_id, r.group_id""", f"{name}_rows", "pairs")
    _cte(f"{name}_silhouette", f"""SELECT run, cohort_id, avg(CASE WHEN own_size = 1 THEN 0.0
      WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
      SELECT e.run, e.cohort_id, e.row_id,
        max(CASE WHEN own = other THEN g.size END) AS own_size,
        max(CASE WHEN own = other THEN total / nullif(g.size - 1, 0) END) AS a,
        min(CASE WHEN own <> other THEN total / g.size END) AS b
      FROM {name}_reach e JOIN {name}_groups g ON g.run = e.run AND g.cohort_id = e.cohort_id AND g.group_id = e.other
      GROUP BY e.run, e.cohort_id, e.row_id) GROUP BY run, cohort_id""", f"{name}_reach", f"{name}_groups")
    _cte(f"{name}_centers", f"""SELECT run, cohort_id, group_id, pos, avg(z) AS c, count(*) AS n
    FROM {name}_rows JOIN features USING (cohort_id, row_id) GROUP BY run, cohort_id, group_id, pos""",
         f"{name}_rows", "features")
    _cte(f"{name}_inner", f"""SELECT run, cohort_id, row_id, group_id, sqrt(sum((z - c) * (z - c))) AS d
    FROM {name}_rows JOIN features USING (cohort_id, row_id) JOIN {name}_centers USING (run, cohort_id, group_id, pos)
    GROUP BY run, cohort_id, row_id, group_id""", f"{name}_rows", "features", f"{name}_centers")
    _cte(f"{name}_spread", f"""SELECT run, cohort_id, group_id, avg(d) AS s, sum(d * d) AS ss FROM {name}_inner
    GROUP BY run, cohort_id, group_id""", f"{name}_inner")
    _cte(f"{name}_db", f"""SELECT run, cohort_id, avg(worst) AS davies_bouldin FROM (
      SELECT a.run, a.cohort_id, a.group_id,
        max(CASE WHEN gap = 0 THEN 0.0 ELSE (a.s + b.s) / gap END) AS worst
      FROM (SELECT x.run, x.cohort_id, x.group_id AS g, y.group_id AS h, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS gap
        FROM {name}_centers x JOIN {name}_centers y ON x.run = y.run AND x.cohort_id = y.cohort_id AND x.pos = y.pos
          AND x.group_id <> y.group_id
        GROUP BY x.run, x.cohort_id, x.group_id, y.group_id) q
      JOIN {name}_spread a ON a.run = q.run AND a.cohort_id = q.cohort_id AND a.group_id = q.g
      JOIN {name}_spread b ON b.run = q.run AND b.cohort_id = q.cohort_id AND b.group_id = q.h
      GROUP BY a.run, a.cohort_id, a.group_id) GROUP BY run, cohort_id""", f"{name}_centers", f"{name}_spread")
    _cte(f"{name}_ch", f"""SELECT s.run, s.cohort_id, CASE WHEN w.within < 1e-12 THEN 1.0
      ELSE (b.between / (s.n_clusters - 1)) / (w.within / (s.n_samples - s.n_clusters)) END AS calinski_harabasz
    FROM {name}_summary s
    JOIN (SELECT run, cohort_id, sum(ss) AS within FROM {name}_spread GROUP BY run, cohort_id) w
      ON w.run = s.run AND w.cohort_id = s.cohort_id
    JOIN (SELECT run, cohort_id, sum(n * c * c) AS between FROM {name}_centers GROUP BY run, cohort_id) b
      ON b.run = s.run AND b.cohort_id = s.cohort_id""", f"{name}_summary", f"{name}_spread", f"{name}_centers")
    for column, out in (("Gender", "gender_entropy"), ("Diversity", "diversity_entropy")):
        _cte(f"{name}_{out}", f"""SELECT run, cohort_id, group_id, -sum(n / size * ln(n / size + 1e-10)) AS {out}
      FROM (SELECT run, cohort_id, group_id, {column}, count(*) AS n FROM {name}_rows WHERE {column} IS NOT NULL
        GROUP BY run, cohort_id, group_id, {column}) JOIN {name}_groups USING (run, cohort_id, group_id)
      GROUP BY run, cohort_id, group_id""", f"{name}_rows", f"{name}_groups")
    _cte(f"{name}_entropy", f"""SELECT run, cohort_id, group_id, size, coalesce(gender_entropy, 0.0) AS gender_entropy,
      coalesce(diversity_entropy, 0.0) AS diversity_entropy
    FROM {name}_groups LEFT JOIN {name}_gender_entropy USING (run, cohort_id, group_id)
    LEFT JOIN {name}_diversity_entropy USING (run, cohort_id, group_id)""",
         f"{name}_groups", f"{name}_gender_entropy", f"{name}_diversity_entropy")
    _cte(f"{name}_variance", f"""SELECT run, cohort_id, group_id, m, w, e, (m + w + e) / 3 AS mean FROM (
      SELECT run, cohort_id, group_id, var_samp(Motivation) AS m, var_samp(Work_Ethic) AS w, var_samp(Self_Esteem) AS e
      FROM {name}_rows GROUP BY run, cohort_id, group_id)""", f"{name}_rows")

    def scored(value: str) -> str:
        return f"CASE WHEN n_clusters >= 2 AND n_clusters <= n_samples - 1 THEN {value} END AS {value}"

    _cte(name, f"""SELECT run, cohort_id, n_samples, n_clusters, {scored("silhouette")}, {scored("davies_bouldin")},
      {scored("calinski_harabasz")}, mean_gender_entropy
    FROM {name}_summary LEFT JOIN {name}_silhouette USING (run, cohort_id) LEFT JOIN {name}_db USING (run, cohort_id)
    LEFT JOIN {name}_ch USING (run, cohort_id)
    LEFT JOIN (SELECT run, cohort_id, avg(gender_entropy) AS mean_gender_entropy FROM {name}_entropy
      GROUP BY run, cohort_id) USING (run, cohort_id)""",
         f"{name}_summary", f"{name}_silhouette", f"{name}_db", f"{name}_ch", f"{name}_entropy")


_scores("st", {"stripe": ("stripe", "euclidean")})
_scores("sg", {"stripe": ("stripe", "gower")})
_scores("ck", {"chunk": ("chunk", "euclidean")})
_scores("two", {"stripe": ("stripe", "euclidean"), "chunk": ("chunk", "euclidean")})
_scores("four", {
    "kmeans_euclidean": ("run_kmeans_euclidean", "euclidean"),
    "kmeans_manhattan": ("run_kmeans_manhattan", "euclidean"),
    "kmedoids_manhattan": ("run_kmedoids_manhattan", "euclidean"),
    "kmedoids_gower": ("run_kmedoids_gower", "gower"),
})


# --- any vectors: all embeddings as one cohort ---------------------------------------------
VECTOR_GROUPS = 6
_cte("vec_vectors", """SELECT CAST(0 AS BIGINT) AS cohort_id, vec_id AS row_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z,
    list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS q FROM embeddings""")
_cte("vec_features", """SELECT cohort_id, row_id, label, unnest(range(len(q))) AS pos, unnest(z) AS z, unnest(q) AS q FROM vec_vectors""", "vec_vectors")
_cte("vec_numbered", "SELECT cohort_id, row_id, row_number() OVER (PARTITION BY cohort_id ORDER BY row_id) AS nth FROM vec_vectors", "vec_vectors")
_cte("vec_slots", f"""SELECT cohort_id, CAST(row_number() OVER (PARTITION BY cohort_id ORDER BY
      (row_id % 2147483648 * 2654435761 + {SEED * 40503}) % 4294967296, row_id) - 1 AS INT) AS slot, row_id
    FROM vec_vectors QUALIFY slot < {VECTOR_GROUPS}""", "vec_vectors")
_lloyd("vec_means", _GAP2, "vec_slots", of="vec_")
_cte("vec_sizes", "SELECT label, count(*) AS size FROM vec_vectors GROUP BY label", "vec_vectors")
_cte("vec_reach", """SELECT a.row_id, a.label AS own, b.label AS other, sum(list_distance(a.z, b.z)) AS total
    FROM vec_vectors a JOIN vec_vectors b USING (cohort_id) GROUP BY a.row_id, a.label, b.label""", "vec_vectors")
_cte("vec_silhouette", """SELECT avg(CASE WHEN size = 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
    FROM (SELECT row_id, max(CASE WHEN own = other THEN s.size END) AS size,
        max(CASE WHEN own = other AND s.size > 1 THEN total / (s.size - 1) ELSE 0.0 END) AS a, min(CASE WHEN own <> other THEN total / s.size END) AS b
      FROM vec_reach r JOIN vec_sizes s ON s.label = r.other GROUP BY row_id)""", "vec_reach", "vec_sizes")
_cte("vec_centers", """SELECT label, list(c ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(z) AS c FROM vec_features GROUP BY label, pos) GROUP BY label""", "vec_features")
_cte("vec_spread", """SELECT v.label, avg(list_distance(v.z, c.c)) AS s, sum(list_distance(v.z, c.c) ** 2) AS ss
    FROM vec_vectors v JOIN vec_centers c USING (label) GROUP BY v.label""", "vec_vectors", "vec_centers")
_cte("vec_db", """SELECT avg(worst) AS davies_bouldin FROM (
    SELECT a.label, max(CASE WHEN list_distance(a.c, b.c) = 0 THEN 0.0 ELSE (x.s + y.s) / list_distance(a.c, b.c) END) AS worst
    FROM vec_centers a JOIN vec_centers b ON a.label <> b.label JOIN vec_spread x ON x.label = a.label JOIN vec_spread y ON y.label = b.label
    GROUP BY a.label)""", "vec_centers", "vec_spread")
_cte("vec_ch", """SELECT (between / (k - 1)) / (within / (n - k)) AS calinski_harabasz FROM
    (SELECT sum(size * list_distance(c.c, m.c) ** 2) AS between, count(*) AS k, sum(size) AS n FROM vec_centers c JOIN vec_sizes USING (label),
      (SELECT list(c ORDER BY pos) AS c FROM (SELECT pos, avg(z) AS c FROM vec_features GROUP BY pos)) m),
    (SELECT sum(ss) AS within FROM vec_spread)""", "vec_centers", "vec_sizes", "vec_features", "vec_spread")


def _with(select: str, *needs: str) -> str:
    """``select`` behind every expression it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][1]:
                visit(need)
            if name not in ordered:
                ordered.append(name)

    for need in needs:
        visit(need)
    parts = [
        f"{name} AS {'' if name.endswith('_loop') else 'MATERIALIZED '}({CTES[name][0]})" for name in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\n{select}"


def _all(columns: str, source: str) -> str:
    return _with(f"SELECT {columns} FROM {source}", source)


_CORE_PEOPLE = f"cohort_id, row_id, {', '.join(_TEXT)}"
_R_SCORES = f"""{_r6("silhouette")} AS silhouette, {_r6("davies_bouldin")} AS davies_bouldin,
  {_r6("calinski_harabasz")} AS calinski_harabasz, {_r6("mean_gender_entropy")} AS mean_gender_entropy"""


def _rule(name: str) -> str:
    pattern = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
    text = _strip(name)
    number = f"CASE WHEN regexp_matches({text}, '{pattern}') THEN TRY_CAST({text} AS DOUBLE) END"
    return f"""CASE WHEN bool_or({name} IS NOT NULL AND {number} IS NULL) THEN '{name} must be numeric.'
      WHEN NOT bool_and(coalesce({number} BETWEEN 1 AND 4, false)) THEN '{name} contains values outside the 1–4 range.' END"""


def _bands(name: str, better: str, first: float, second: float) -> str:
    return (f"CASE WHEN {name} IS NULL THEN NULL WHEN {name} {better} {first} THEN 'good' "
            f"WHEN {name} {better} {second} THEN 'fair' ELSE 'poor' END AS {name}_band")


def _report() -> str:
    def pad(text: str, width: int) -> str:
        return f"rpad({text}, greatest({width}, length({text}))::INT, ' ')"

    short = "CASE WHEN length(Diversity) > 19 THEN concat(left(Diversity, 17), '..') ELSE Diversity END"
    line = f"concat({pad('Name', 20)}, ' | ', {pad('Gender', 8)}, ' | ', {pad(f'({short})', 20)}, ' | ', {pad('Learning_Style', 10)})"
    rule, bar = "'" + "-" * 65 + "'", "'" + "=" * 65 + "'"
    header = f"'{'Name':<20} | {'Gender':<8} | {'Ethnicity':<20} | {'Style':<10}'"
    return _with(f"""SELECT cohort_id, group_id, CAST(line_no AS INT) AS line_no, line FROM (
  SELECT cohort_id, group_id + 1 AS group_id,
    5 + row_number() OVER (PARTITION BY cohort_id, group_id ORDER BY Name, row_id) AS line_no, {line} AS line FROM chunk
  UNION ALL SELECT cohort_id, g, v.line_no, v.line FROM (
    SELECT cohort_id, group_id + 1 AS g, count(*) AS n FROM chunk GROUP BY cohort_id, group_id) t,
    LATERAL (VALUES (1, ''), (2, concat(' GROUP ', g, ' (', n, ' students)')), (3, {rule}), (4, {header}), (5, {rule}),
      (n + 6, {rule})) AS v(line_no, line)
  UNION ALL SELECT cohort_id, 0, v.line_no, v.line FROM sizes,
    LATERAL (VALUES (1, ''), (2, {bar}), (3, 'FINAL GROUP ASSIGNMENTS REPORT'), (4, {bar})) AS v(line_no, line))""",
                 "chunk", "sizes")


def oracle_sql() -> dict[str, str]:
    usable = " AND ".join(f"{c} IS NOT NULL" for c in (*_SCORES, "Learning_Style"))
    number = ", ".join(f"TRY_CAST({_strip(s)} AS DOUBLE) AS {s}" for s in _SCORES)
    dirty_clean = _clean("dirty", number)
    reason = "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '{c} is missing' END" for c in (*_SCORES, "Learning_Style")
    ) + "], lambda x: x IS NOT NULL), '; ')"
    any_null = " OR ".join(f"{c} IS NULL" for c in _TEXT)
    errors = "list_filter([" + ", ".join(_rule(s) for s in _SCORES) + \
        f", CASE WHEN bool_or({any_null}) THEN 'Data contains missing values.' END], lambda x: x IS NOT NULL)"
    sql = {
        "load_people": _all(_CORE_PEOPLE, "dirty"),
        "load_people_broken": _with("""SELECT CASE WHEN reason IS NULL OR row_id % 17 <> 3 THEN cohort_id END AS cohort_id, row_id,
            CASE WHEN reason IS NULL THEN CASE WHEN row_id % 13 = 5 THEN 'Ann "A", ' || Name WHEN row_id % 23 = 6 THEN 'two' || chr(10) || Name ELSE Name END END AS Name,
            CASE WHEN reason IS NULL THEN Diversity END AS Diversity, reason
          FROM (SELECT *, CASE WHEN row_id % 19 = 4 OR row_id % 29 = 7 THEN 'wrong number of fields'
            WHEN row_id % 17 = 3 THEN 'cohort_id is no whole number' END AS reason FROM dirty)""", "dirty"),
        "validate_people": _with(f"""SELECT cohort_id, len(errors) = 0 AS is_valid, array_to_string(errors, ' | ') AS errors
          FROM (SELECT cohort_id, {errors} AS errors FROM dirty GROUP BY cohort_id)""", "dirty"),
        "missing_values": _with(" UNION ALL ".join(
            f"SELECT cohort_id, '{c}' AS \"column\", row_id FROM dirty WHERE {c} IS NULL" for c in _TEXT), "dirty"),
        "quarantined_people": _with(f"""SELECT cohort_id, row_id, {reason} AS reason FROM ({dirty_clean})
          WHERE NOT ({usable})""", "dirty"),
        "normalize_people": _all(_CORE_PEOPLE, "people"),
        "normalize_dirty_people": _with(f"SELECT {_CORE_PEOPLE} FROM ({dirty_clean})", "dirty"),
        "features": _all("cohort_id, row_id, pos, CAST(x AS DOUBLE) AS value", "features"),
        "standardize": _all(f"cohort_id, row_id, pos, {_r6('z')} AS z, q", "features"),
        "pairwise_manhattan": _with(_profile_pairs("l1", _SKILL), "pairs", "people"),
        "pairwise_euclidean": _with(_profile_pairs("CAST(round(l2 * 1000000) AS BIGINT)", _SKILL), "pairs", "people"),
        "pairwise_gower": _with(_profile_pairs("CAST(round(gower * 1000000) AS BIGINT)", f"{_SKILL}, Gender, Diversity"),
                                "pairs", "people"),
        "feature_covariance": _with(f"""SELECT a.cohort_id, a.pos AS i, b.pos AS j, {_r6("covar_samp(a.z, b.z)")} AS value
          FROM features a JOIN features b ON a.cohort_id = b.cohort_id AND a.row_id = b.row_id
          GROUP BY a.cohort_id, a.pos, b.pos""", "features"),
        "pca_squares": _with(f"""SELECT cohort_id, row_id AS profile_id, n AS weight, pc1_squared, pc2_squared, {_r6("explained")} AS explained
          FROM ({_squared("features", "cohort_id, row_id", "z")}) JOIN explained USING (cohort_id)
          JOIN (SELECT cohort_id, min(row_id) AS row_id, count(*) AS n FROM people GROUP BY cohort_id, {_SKILL}) USING (cohort_id, row_id)""",
          "features", "axis1", "axis2", "explained", "people"),
        "pca_centroids": _with(f"""SELECT cohort_id, group_id, n AS people, pc1_squared, pc2_squared
          FROM ({_squared("st_centers", "cohort_id, group_id, n", "c")})""", "st_centers", "axis1", "axis2"),
        # fixed labels
        "cluster_sizes": _all("cohort_id, group_id, size", "st_groups"),
        "gender_breakdown": _with("""SELECT cohort_id, group_id, Gender AS category, count(*) AS n FROM stripe
          GROUP BY cohort_id, group_id, Gender""", "stripe"),
        "diversity_breakdown": _with("""SELECT cohort_id, group_id, Diversity AS category, count(*) AS n FROM stripe
          GROUP BY cohort_id, group_id, Diversity""", "stripe"),
        "cluster_entropy": _all(f"cohort_id, group_id, size, {_r6('gender_entropy')} AS gender_entropy, "
                                f"{_r6('diversity_entropy')} AS diversity_entropy", "st_entropy"),
        "run_summary": _with(f"""SELECT cohort_id, n_samples, n_clusters, {_r6("m")} AS mean_gender_entropy
          FROM st_summary JOIN (SELECT cohort_id, avg(gender_entropy) AS m FROM st_entropy GROUP BY cohort_id)
          USING (cohort_id)""", "st_summary", "st_entropy"),
        "silhouette_euclidean": _all(f"cohort_id, {_r6('silhouette')} AS silhouette", "st"),
        "silhouette_gower": _all(f"cohort_id, {_r6('silhouette')} AS silhouette", "sg"),
        "davies_bouldin": _all(f"cohort_id, {_r6('davies_bouldin')} AS davies_bouldin", "st"),
        "calinski_harabasz": _all(f"cohort_id, {_r6('calinski_harabasz')} AS calinski_harabasz", "st"),
        "evaluate_clustering": _all(f"run, cohort_id, n_samples, n_clusters, {_R_SCORES}", "two"),
        "best_run": _with(f"""SELECT cohort_id, s[2] AS run, {_r6("s[1]")} AS best_silhouette FROM (
          SELECT cohort_id, max((silhouette, run)) FILTER (WHERE silhouette IS NOT NULL) AS s FROM two GROUP BY cohort_id)""", "two"),
        "skill_variance_by_cluster": _all(
            "cohort_id, group_id, " + ", ".join(
                f"{_r6(f'coalesce({short}, 0.0)')} AS {name}" for short, name in (
                    ("m", "motivation_variance"), ("w", "work_ethic_variance"), ("e", "self_esteem_variance"),
                    ("mean", "mean_skill_variance"))), "ck_variance"),
        "skill_variance_overall": _with(f"""SELECT run, cohort_id,
            CASE WHEN bool_or(mean IS NULL) THEN CAST('NaN' AS DOUBLE) ELSE {_r6("avg(mean)")} END AS overall_mean_variance,
            CASE WHEN bool_or(mean IS NULL) THEN CAST('NaN' AS DOUBLE) ELSE {_r6("stddev_pop(mean)")} END AS overall_std_variance,
            {_r6("avg(mean)")} AS overall_mean_variance_nonsingleton
          FROM two_variance GROUP BY run, cohort_id""", "two_variance"),
        "cluster_balance": _with(f"""SELECT run, cohort_id, group_id, size, {_r6("gender_entropy")} AS gender_entropy,
            {_r6("diversity_entropy")} AS diversity_entropy, {_r6("coalesce(mean, 0.0)")} AS mean_skill_variance
          FROM two_entropy JOIN two_variance USING (run, cohort_id, group_id)""", "two_entropy", "two_variance"),
        "rating_bands": _with(f"""SELECT run, cohort_id, {_bands("silhouette", ">", 0.5, 0)},
            {_bands("davies_bouldin", "<", 1.5, 2.0)}, {_bands("mean_skill_variance", "<", 0.3, 0.5)}
          FROM two JOIN (SELECT run, cohort_id, avg(mean) AS mean_skill_variance FROM two_variance GROUP BY run, cohort_id)
          USING (run, cohort_id)""", "two", "two_variance"),
        "group_members": _with("""SELECT cohort_id, group_id, Name,
            row_number() OVER (PARTITION BY cohort_id, group_id ORDER BY row_id) AS position FROM stripe""", "stripe"),
        "label_centroids": _all(f"cohort_id, group_id, n AS people, pos, {_r6('c')} AS value", "st_centers"),
        "gender_isolation": _with(_isolated("chunk"), "chunk"),
        "diversity_isolation": _with(_lone_categories("chunk"), "chunk"),
        "swap_donors": _with("""SELECT cohort_id, group_id, Gender, count(*) AS held FROM chunk
          WHERE Gender IN ('Female', 'Male') GROUP BY cohort_id, group_id, Gender HAVING count(*) > 2""", "chunk"),
        "best_swaps": _with("""SELECT cohort_id, group_id, s[3] AS in_id, s[2] AS donor_group, s[4] AS out_id, s[1] AS dist
          FROM (SELECT f.cohort_id, f.group_id, min((d.d, a.group_id, a.row_id, b.row_id)) AS s
            FROM fixed_flagged f
            JOIN (SELECT *, count(*) OVER (PARTITION BY cohort_id, group_id, Gender) AS held FROM chunk) a
              ON a.cohort_id = f.cohort_id AND a.group_id <> f.group_id AND a.Gender = f.wanted AND a.held > 2
            JOIN chunk b ON b.cohort_id = f.cohort_id AND b.group_id = f.group_id
              AND b.Gender = CASE f.wanted WHEN 'Female' THEN 'Male' ELSE 'Female' END
            JOIN dist_l1 d ON d.cohort_id = f.cohort_id AND d.i = a.row_id AND d.j = b.row_id
            GROUP BY f.cohort_id, f.group_id)""", "fixed_flagged", "chunk", "dist_l1"),
        "fix_gender_isolation": _all("cohort_id, row_id, group_id", "fixed"),
        "swap_log": _all("cohort_id, round, group_id, isolation_type, in_id, donor_group, out_id, dist", "fixed_log"),
        "fix_diversity_isolation": _all("cohort_id, row_id, group_id", "mixed"),
        # clustering steps
        "group_config": _with(f"""SELECT cohort_id, n, greatest(1, n // {SIZE}) AS k,
          least(greatest(2, n // {SIZE}), n) AS k_evaluate FROM sizes""", "sizes"),
        "init_slots": _all("cohort_id, slot, row_id", "slots"),
        "assign_euclidean": _all("cohort_id, row_id, slot", "assign_euclidean"),
        "assign_manhattan": _all("cohort_id, row_id, slot", "assign_manhattan"),
        "centroid_update": _all("cohort_id, slot, pos, centroid_q", "centroid_update"),
        "kmeans_euclidean": _all("cohort_id, row_id, label", "kmeans_l2"),
        "kmeans_manhattan": _all("cohort_id, row_id, label", "kmeans_l1"),
        "kmeans_vectors": _all("cohort_id, row_id, label", "vec_means"),
        "separation_vectors": _with(f"""SELECT 'label' AS run, CAST(0 AS BIGINT) AS cohort_id, n AS n_samples, k AS n_clusters, {_r6("silhouette")} AS silhouette,
            {_r6("davies_bouldin")} AS davies_bouldin, {_r6("calinski_harabasz")} AS calinski_harabasz
          FROM vec_silhouette, vec_db, vec_ch, (SELECT sum(size) AS n, count(*) AS k FROM vec_sizes)""",
          "vec_silhouette", "vec_db", "vec_ch", "vec_sizes"),
        "medoid_assign": _all("cohort_id, i AS row_id, slot, d1 AS dist", "medoid_near"),
        "medoid_cost": _with("""SELECT cohort_id, CAST(sum(d1) AS BIGINT) AS cost FROM medoid_near GROUP BY cohort_id""",
                             "medoid_near"),
        "medoid_swap_deltas": _with("""SELECT s.cohort_id, s.slot, t.j AS cand,
            CAST(sum(least(t.d, coalesce(o.best, 1000000000000)) - c.d1) AS BIGINT) AS delta
          FROM first_medoids s JOIN dist_l1 t ON t.cohort_id = s.cohort_id
          JOIN (SELECT cohort_id, min(row_id) AS id FROM people
            GROUP BY cohort_id, Motivation, Self_Esteem, Work_Ethic, Learning_Style) p
            ON p.cohort_id = t.cohort_id AND p.id = t.j
          JOIN medoid_near c ON c.cohort_id = t.cohort_id AND c.i = t.i
          LEFT JOIN (SELECT s.cohort_id, s.slot, d.i, min(d.d) AS best FROM first_medoids s
            JOIN first_medoids m ON m.cohort_id = s.cohort_id AND m.slot <> s.slot
            JOIN dist_l1 d ON d.cohort_id = m.cohort_id AND d.j = m.m GROUP BY s.cohort_id, s.slot, d.i) o
            ON o.cohort_id = s.cohort_id AND o.slot = s.slot AND o.i = t.i
          GROUP BY s.cohort_id, s.slot, t.j""", "first_medoids", "dist_l1", "people", "medoid_near"),
        "kmedoids_manhattan": _all("cohort_id, row_id, label", "pam_l1"),
        "kmedoids_gower": _all("cohort_id, row_id, label", "pam_gower"),
        "kmedoids_given_distances": _all("cohort_id, row_id, label", "pam_given"),
        "silhouette_given_distances": _with(f"""SELECT run, cohort_id, CASE WHEN k BETWEEN 2 AND n - 1 THEN {_r6("silhouette")} END AS silhouette
          FROM given_silhouette JOIN (SELECT run, cohort_id, count(*) AS k, sum(size) AS n FROM given_sizes GROUP BY ALL) USING (run, cohort_id)""",
          "given_silhouette", "given_sizes"),
        "kmedoids_no_improving_swap": _with("""SELECT s.cohort_id, CAST(s.slot AS INT) AS slot, t.j AS cand,
            CAST(sum(least(t.d, coalesce(o.best, 1000000000000)) - c.d1) AS BIGINT) AS delta
          FROM pam_l1_medoids s JOIN dist_l1 t ON t.cohort_id = s.cohort_id
          JOIN (SELECT m.cohort_id, d.i, min(d.d) AS d1 FROM pam_l1_medoids m
            JOIN dist_l1 d ON d.cohort_id = m.cohort_id AND d.j = m.m GROUP BY m.cohort_id, d.i) c
            ON c.cohort_id = t.cohort_id AND c.i = t.i
          LEFT JOIN (SELECT s.cohort_id, s.slot, d.i, min(d.d) AS best FROM pam_l1_medoids s
            JOIN pam_l1_medoids m ON m.cohort_id = s.cohort_id AND m.slot <> s.slot
            JOIN dist_l1 d ON d.cohort_id = m.cohort_id AND d.j = m.m GROUP BY s.cohort_id, s.slot, d.i) o
            ON o.cohort_id = s.cohort_id AND o.slot = s.slot AND o.i = t.i
          GROUP BY s.cohort_id, s.slot, t.j
          HAVING sum(least(t.d, coalesce(o.best, 1000000000000)) - c.d1) < 0""", "pam_l1_medoids", "dist_l1"),
        # sizes
        "core_groups": _all("cohort_id, row_id, rn, n_groups, group_id", "sized_core"),
        "group_centers": _all("cohort_id, group_id, pos, q AS centroid_q", "sized_centers"),
        "smart_fill": _all("cohort_id, row_id, group_id", "sized_fill"),
        "round_robin_fill": _all("cohort_id, row_id, group_id", "sized_turn_fill"),
        "enforce_group_size": _all("cohort_id, row_id, group_id", "sized"),
        # reports and pipelines
        "group_assignments": _all(f"group_id + 1 AS Group_ID, {_CORE_PEOPLE}", "chunk"),
        "group_report_lines": _report(),
        "generate_groups": _with(f"""SELECT g.group_id + 1 AS Group_ID, {_CORE_PEOPLE} FROM people
          JOIN generated g USING (cohort_id, row_id)""", "people", "generated"),
        "comparison_table": _with("""SELECT cohort_id,
            CASE WHEN run LIKE 'kmeans%' THEN 'K-Means' ELSE 'K-Medoids' END AS "Algorithm",
            CASE WHEN run LIKE '%euclidean' THEN 'Euclidean' WHEN run LIKE '%gower' THEN 'Gower' ELSE 'Manhattan' END AS "Metric",
            n_clusters AS "N Clusters", printf('%.4f', silhouette) AS "Silhouette Score",
            printf('%.4f', davies_bouldin) AS "Davies-Bouldin", printf('%.2f', calinski_harabasz) AS "Calinski-Harabasz",
            printf('%.4f', mean_gender_entropy) AS "Gender Balance (Mean Entropy)" FROM four""", "four"),
        "tournament_scores": _all(f"run, cohort_id, n_samples, n_clusters, {_R_SCORES}", "four"),
        "form_balanced_groups": _with("""SELECT cohort_id, row_id, Name, group_id + 1 AS "Group" FROM people
          JOIN five_mixed USING (cohort_id, row_id)""", "people", "five_mixed"),
        "compare_metrics": _with("""SELECT 'kmeans_euclidean' AS run, cohort_id, row_id, group_id FROM five_means
          UNION ALL SELECT 'kmedoids_manhattan', cohort_id, row_id, group_id FROM five_medoids""",
                                 "five_means", "five_medoids"),
    }
    return sql
