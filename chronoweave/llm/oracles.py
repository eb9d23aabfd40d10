"""DuckDB statements that the training-data queries are compared with, written another way where there is one."""

_ID = "nullif(regexp_replace(regexp_replace({c}, '\\s+', '', 'g'), '\\.0$', ''), '')"
_CODE = "nullif(upper(regexp_replace({c}, '[\\s.]+', '', 'g')), '')"


def _id(c: str) -> str:
    return _ID.replace("{c}", c)


def _code(c: str) -> str:
    return _CODE.replace("{c}", c)


# p1: earliest ends per patient's sequence, grown token by token through frequent prefixes only.
_P1 = f"""
WITH s AS (SELECT {_id("patient_id")} AS p, row_number() OVER () AS r, combined_full AS t FROM sequences WHERE combined_full IS NOT NULL AND {_id("patient_id")} IS NOT NULL),
n AS (SELECT greatest(10, ceil(0.03 * count(DISTINCT p))) AS least FROM s),
x AS (SELECT p, r, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM s),
b AS (SELECT p, r, tok, sum(CASE WHEN tok = '[VISIT]' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS blk FROM x),
o AS (SELECT DISTINCT p, r, tok, blk FROM b WHERE regexp_matches(tok, '^[CPD]:')),
f1 AS (SELECT tok FROM o GROUP BY tok HAVING count(DISTINCT p) >= (SELECT least FROM n)),
q AS (SELECT o.* FROM o JOIN f1 USING (tok)),
e1 AS (SELECT p, r, tok AS pat, min(blk) AS e FROM q GROUP BY ALL),
a2 AS (SELECT e1.p, e1.r, e1.pat || ' -> ' || q.tok AS pat, min(q.blk) AS e FROM e1 JOIN q ON q.r = e1.r AND q.blk > e1.e GROUP BY ALL),
f2 AS (SELECT pat, count(DISTINCT p) AS k FROM a2 GROUP BY pat HAVING k >= (SELECT least FROM n)),
a3 AS (SELECT c.p, c.r, c.pat || ' -> ' || q.tok AS pat, min(q.blk) AS e FROM (SELECT a2.* FROM a2 JOIN f2 USING (pat)) c JOIN q ON q.r = c.r AND q.blk > c.e GROUP BY ALL),
f3 AS (SELECT pat, count(DISTINCT p) AS k FROM a3 GROUP BY pat HAVING k >= (SELECT least FROM n)),
a4 AS (SELECT c.p, c.r, c.pat || ' -> ' || q.tok AS pat FROM (SELECT a3.* FROM a3 JOIN f3 USING (pat)) c JOIN q ON q.r = c.r AND q.blk > c.e GROUP BY ALL),
f4 AS (SELECT pat, count(DISTINCT p) AS k FROM a4 GROUP BY pat HAVING k >= (SELECT least FROM n)),
f AS (SELECT *, 2 AS len FROM f2 UNION ALL SELECT *, 3 FROM f3 UNION ALL SELECT *, 4 FROM f4)
"""

_P2 = f"""
WITH RECURSIVE rec AS (SELECT DISTINCT {_id("patient_id")} AS p, {_id("index_hadm_id")} AS h FROM samples WHERE {_id("patient_id")} IS NOT NULL AND {_id("index_hadm_id")} IS NOT NULL),
link AS (SELECT DISTINCT a.p AS x, b.p AS y FROM rec a JOIN rec b ON a.h = b.h),
reach AS (SELECT p AS x, p AS y FROM (SELECT DISTINCT p FROM rec) UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
grp AS (SELECT x AS p, min(y) AS g FROM reach GROUP BY x)
SELECT rec.p AS patient_id, rec.h AS index_hadm_id, g AS group_id FROM rec JOIN grp USING (p)
WHERE g IN (SELECT g FROM rec JOIN grp USING (p) GROUP BY g HAVING count(*) > 1)
"""

_P3 = f"""
WITH d AS (SELECT DISTINCT * FROM diagnoses), m AS (SELECT DISTINCT * FROM ndc_to_ingredient),
a AS (SELECT {_code("icd_code")} AS value, count(*) AS n_rows, count(DISTINCT {_id("hadm_id")}) AS n_records FROM d GROUP BY 1),
b AS (SELECT {_id("ingredient_rxcui")} AS value, count(*) AS n_rows, count(DISTINCT map_id) AS n_records FROM m GROUP BY 1),
r AS (
  SELECT 'icd_code' AS field, value, n_rows, n_records, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records * 10 > (SELECT count(DISTINCT {_id("hadm_id")}) FROM diagnoses) THEN 'common' ELSE 'normal' END AS band FROM a WHERE value IS NOT NULL
  UNION ALL
  SELECT 'ingredient_rxcui', value, n_rows, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 40 > (SELECT count(DISTINCT map_id) FROM ndc_to_ingredient) THEN 'common' ELSE 'normal' END FROM b WHERE value IS NOT NULL
)
"""

_P5 = """
WITH e AS (SELECT DISTINCT pattern_id AS i, c FROM (SELECT pattern_id, unnest(_carrier_keys) AS c FROM mined_patterns_train) WHERE c IS NOT NULL AND pattern_id IS NOT NULL),
s AS (SELECT i, count(*) AS n FROM e GROUP BY i HAVING count(*) >= 3),
x AS (SELECT a.i AS a, b.i AS b, count(*) AS k FROM e a JOIN e b ON a.c = b.c AND a.i < b.i GROUP BY ALL)
SELECT x.a AS pattern_id_a, x.b AS pattern_id_b FROM x JOIN s p ON p.i = x.a JOIN s q ON q.i = x.b WHERE 10 * k >= 7 * (p.n + q.n - k)
"""

# p5_links: classes by the sorted sets themselves, links between their smallest ids.
_P5_LINKS = """
WITH e AS (SELECT DISTINCT pattern_id AS i, c FROM (SELECT pattern_id, unnest(_carrier_keys) AS c FROM mined_patterns_train) WHERE c IS NOT NULL AND pattern_id IS NOT NULL),
s AS (SELECT i, count(*) AS n, list_sort(list(c)) AS l FROM e GROUP BY i HAVING count(*) >= 3),
k AS (SELECT i, n, min(i) OVER (PARTITION BY l) AS class_id, count(*) OVER (PARTITION BY l) AS class_size FROM s),
r AS (SELECT e.i, e.c, k.n FROM e JOIN k USING (i) WHERE k.class_id = k.i),
x AS (SELECT a.i AS a, b.i AS b, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS k FROM r a JOIN r b ON a.c = b.c AND a.i < b.i GROUP BY ALL),
m AS (SELECT unnest([a, b]) AS class_id FROM x WHERE 10 * k >= 7 * (p + q - k)),
t AS (SELECT class_id, count(*) AS n_links FROM m GROUP BY class_id)
SELECT i AS id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN t USING (class_id)
"""

_P6 = f"""
WITH d AS (SELECT DISTINCT {_id("hadm_id")} AS b, {_code("icd_code")} AS i FROM diagnoses WHERE {_id("hadm_id")} IS NOT NULL AND {_code("icd_code")} IS NOT NULL),
s AS (SELECT {_id("patient_id")} AS p, {_id("index_hadm_id")} AS v, row_number() OVER () AS r, combined_full AS t FROM sequences WHERE combined_full IS NOT NULL),
x AS (SELECT p, v, r, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM s),
y AS (SELECT p, v, tok, sum(CASE WHEN tok = '[VISIT]' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM x),
z AS (SELECT DISTINCT coalesce(p, '') || '|' || coalesce(v, '') || '|' || k AS b, tok AS i FROM y WHERE k > 0 OR regexp_matches(tok, '^[CPD]:')),
e AS (SELECT 'diagnoses' AS basis, b, i FROM d UNION ALL SELECT 'sequences', b, i FROM z WHERE regexp_matches(i, '^[CPD]:')),
n AS (SELECT 'diagnoses' AS basis, count(DISTINCT b) AS n FROM d UNION ALL SELECT 'sequences', count(DISTINCT b) FROM z),
c AS (SELECT basis, i, count(*) AS n_i FROM e GROUP BY ALL),
ab AS (SELECT f.basis, f.i AS item_a, g.i AS item_b, count(*) AS n_ab FROM e f JOIN e g ON f.basis = g.basis AND f.b = g.b AND f.i < g.i GROUP BY ALL),
r AS (SELECT ab.*, p.n_i AS n_a, q.n_i AS n_b, n.n AS n_baskets FROM ab JOIN n USING (basis) JOIN c p ON p.basis = ab.basis AND p.i = item_a JOIN c q ON q.basis = ab.basis AND q.i = item_b
  WHERE n_ab >= greatest(5, ceil(n.n / 1000)) AND n_ab * n.n >= 5 * p.n_i * q.n_i)
"""

_WORDS = "list_filter(string_split(regexp_replace(translate(lower({s}), '0135', 'oies'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w != '')"
# p7: the same meaning of a name by brute force, every word against every entry, without segments.
_P7 = f"""
WITH k AS (SELECT DISTINCT map_id, trim(drug_name) AS name FROM ndc_to_ingredient WHERE {_id("ingredient_rxcui")} IS NULL AND trim(drug_name) != '' AND map_id IS NOT NULL),
w AS (SELECT name, {_WORDS.format(s="name")} AS ws FROM (SELECT DISTINCT name FROM k)),
e0 AS (SELECT id, {_WORDS.format(s="s")} AS ws FROM (SELECT ingredient_rxcui AS id, ingredient_name AS s FROM ref_ingredients UNION ALL SELECT ingredient_rxcui, unnest(brand_names) FROM ref_ingredients)),
e AS (SELECT DISTINCT id, array_to_string(ws, '') AS s FROM e0 WHERE len(ws) > 0),
i AS (SELECT name, ws, unnest(generate_series(1, len(ws))) AS j FROM w WHERE len(ws) > 0),
u AS (SELECT DISTINCT name, array_to_string(ws[j : j + n - 1], '') AS v, n = 1 AS alone FROM i, (SELECT unnest(generate_series(1, (SELECT max(len(ws)) + 1 FROM e0))) AS n) WHERE j + n - 1 <= len(ws)),
d AS (SELECT v, id, levenshtein(v, s) AS c, length(s) AS n, array_to_string(list_sort(string_split(v, '')), '') AS sv, array_to_string(list_sort(string_split(s, '')), '') AS ss FROM (SELECT DISTINCT v FROM u) JOIN e ON abs(length(v) - length(s)) <= 2),
h AS (SELECT v, id, c FROM d WHERE c <= CASE WHEN n < 5 THEN 0 WHEN n < 7 THEN 1 WHEN n = 7 THEN 2 ELSE 4 END AND (c <= 2 OR (c = 3 AND n >= 8 AND levenshtein(sv, ss) <= 2) OR (c = 4 AND sv = ss))),
p AS (SELECT v, min(id) AS id FROM (SELECT DISTINCT u.v, e.id FROM u JOIN e ON starts_with(e.s, u.v) AND length(e.s) > length(u.v) WHERE alone AND length(v) >= 5) GROUP BY v HAVING count(*) = 1),
m AS (SELECT name, id, CAST(c AS DOUBLE) AS c FROM u JOIN h USING (v) UNION ALL SELECT name, id, 2.5 FROM u JOIN p USING (v) WHERE alone),
best AS (SELECT m.name, min(id) AS id, m.c FROM m JOIN (SELECT name, min(c) AS c FROM m GROUP BY name) USING (name, c) GROUP BY m.name, m.c HAVING count(DISTINCT id) = 1)
SELECT map_id, coalesce(arg_min(id, c), 'NONE') AS ingredient_rxcui FROM k LEFT JOIN best USING (name) GROUP BY map_id
"""

# Passages' runs of 18 words met in documents' runs.
_P8_VERBATIM = r"""
WITH a AS (SELECT doc_id AS k, string_split(trim(regexp_replace(regexp_replace(lower(text), '[''’‘ʼ`´′]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS k, string_split(trim(regexp_replace(regexp_replace(lower(passage), '[''’‘ʼ`´′]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items WHERE passage IS NOT NULL),
x AS (SELECT DISTINCT k, hash(w[i : i + 17]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 16)) AS i FROM a WHERE len(w) >= 18)),
y AS (SELECT DISTINCT k, hash(w[i : i + 17]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 16)) AS i FROM b WHERE len(w) >= 18))
SELECT DISTINCT x.k AS doc_id, y.k AS item_id FROM x JOIN y USING (h)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT pat AS pattern FROM f",
    "p1_support": _P1 + "SELECT pat AS pattern, CAST(len AS INT) AS n_tokens, k AS n_entities, (SELECT count(DISTINCT p) FROM s) AS n_total FROM f",
    "p2_found": _P2,
    "p3_found": _P3 + "SELECT field, value, band FROM r WHERE band != 'normal'",
    "p3_counts": _P3 + "SELECT field, value, n_rows, n_records, band FROM r",
    "p5_found": _P5,
    "p2_checks": f"SELECT count(*) AS n_records, sum(y) AS n_positive, 0 AS divided_group_id, 0 AS divided_patient_id, 0 AS divided_index_hadm_id, true AS as_planned FROM (SELECT p, h, max(CASE WHEN readmit_30d > 0 THEN 1 ELSE 0 END) AS y FROM (SELECT {_id('patient_id')} AS p, {_id('index_hadm_id')} AS h, readmit_30d FROM samples) WHERE p IS NOT NULL OR h IS NOT NULL GROUP BY p, h)",
    "p8_verbatim": _P8_VERBATIM,
    "p9_checks": "SELECT source, true AS as_planned, true AS within_repeats, true AS no_token_twice FROM mix_targets",
    "p5_links": _P5_LINKS,
    "p6_scores": _P6 + "SELECT basis, item_a, item_b, n_ab, n_a, n_b, n_baskets, round(l, 6) AS lift, round(ln(l), 6) AS pmi, round(CASE WHEN n_ab < n_baskets THEN ln(l) / -ln(n_ab / n_baskets) ELSE 1 END, 6) AS npmi FROM (SELECT *, CAST(n_ab AS DOUBLE) * n_baskets / (CAST(n_a AS DOUBLE) * n_b) AS l FROM r)",
    "p6_found": _P6 + "SELECT basis, item_a, item_b FROM r",
    "p7_found": _P7,
}
