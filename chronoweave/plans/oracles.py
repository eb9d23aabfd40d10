"""DuckDB statements equivalent to the queries, over the same parquet tables registered as views."""

from __future__ import annotations

import re


def ident(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '\s+', '', 'g'), '\.0$', ''), '')"


def code(c: str) -> str:
    return rf"nullif(upper(regexp_replace({c}, '[\s.]+', '', 'g')), '')"


#: A mined pattern as text.
_TEXT = "array_to_string(list_transform(pat, lambda s: CASE WHEN len(s) > 1 THEN '{' || array_to_string(s, ', ') || '}' ELSE s[1] END), ' -> ')"
#: Upper tail of chi-square with one degree of freedom, z = sqrt(chi / 2), by the series of the error function, 200 terms in logarithms.
_TAIL = "CASE WHEN chi = 0 THEN 1.0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-chi / 2) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(sqrt(chi / 2)) - (n + 1) * ln(2.0) + ln(sqrt(pi())) - lgamma(n + 1.5) + n * ln(2.0))))) END"


def _grown() -> dict[str, str]:
    """Item-set sequences grown token by token: within the last step or in a later block, frequent ones only."""
    out = {}
    for k in range(1, 5):
        if k > 1:
            out[f"g{k}"] = (
                f"SELECT DISTINCT g.key, list_append(pat[:-2], list_append(pat[-1], i.a)) AS pat, i.a AS last, b FROM g{k - 1}f g JOIN it i ON i.key = g.key AND i.block_idx = b AND i.a > last "
                f"UNION SELECT DISTINCT g.key, list_append(pat, [i.a]), i.a, i.block_idx FROM g{k - 1}f g JOIN it i ON i.key = g.key AND i.block_idx > b"
            )
        out[f"g{k}f"] = f"SELECT * FROM g{k} JOIN (SELECT pat FROM g{k} GROUP BY pat HAVING count(DISTINCT key) >= (SELECT least FROM gleast)) USING (pat)"
    return out


def _aligned(name: str, patterns: str, blocks: str) -> dict[str, str]:
    """Leftmost matches of patterns of up to four steps: name4 has (pattern_id, steps, key, hits)."""
    out = {f"{name}1": f"SELECT pattern_id, steps, key, [min(block_idx)] AS hits FROM {patterns} JOIN {blocks} ON list_has_all(items, steps[1]) GROUP BY pattern_id, steps, key"}
    for k in range(2, 5):
        out[f"{name}{k}"] = (
            f"SELECT * FROM {name}{k - 1} WHERE len(steps) < {k} UNION ALL "
            f"SELECT pattern_id, steps, m.key, list_append(hits, min(block_idx)) FROM {name}{k - 1} m JOIN {blocks} v ON v.key = m.key AND v.block_idx > hits[-1] AND list_has_all(items, steps[{k}]) WHERE len(steps) >= {k} GROUP BY pattern_id, steps, m.key, hits"
        )
    return out


_GROWN = _grown()

#: Named subqueries; a statement gets those it uses, in this order.
PARTS = {
    "vraw": f"SELECT {ident('subject_id')} AS entity, {ident('hadm_id')} AS visit, admittime AS s, CASE WHEN dischtime >= admittime THEN dischtime END AS e, nullif(trim(regexp_replace(upper(admission_type), '[\\s_\\-]+', ' ', 'g')), '') AS kind, loaded_at FROM admissions",
    "v": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit ORDER BY loaded_at DESC NULLS LAST, s DESC NULLS LAST, e DESC NULLS LAST, entity DESC NULLS LAST, kind DESC NULLS LAST) AS rn FROM vraw WHERE entity IS NOT NULL AND visit IS NOT NULL AND s IS NOT NULL) WHERE rn = 1",
    "vl": "SELECT *, lead(s) OVER (PARTITION BY entity ORDER BY s, visit) AS s2, lead(kind) OVER (PARTITION BY entity ORDER BY s, visit) AS k2 FROM v",
    "lab": "SELECT *, CASE WHEN epoch_us(s2) - epoch_us(e) <= 30 * 86400000000 THEN 1 ELSE 0 END AS l_all, CASE WHEN epoch_us(s2) - epoch_us(e) <= 30 * 86400000000 AND NOT coalesce(k2 IN ('ELECTIVE'), false) THEN 1 ELSE 0 END AS l FROM vl",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s, visit) - 1 AS rk, count(*) OVER (PARTITION BY entity) AS n FROM lab",
    "idx": "SELECT entity, visit, CASE WHEN n = 1 THEN 0 ELSE l END AS label, CAST(least(rk + 1, 20) AS INT) AS n_visits, rk FROM ranked WHERE rk = greatest(n - 2, 0)",
    "hist": "SELECT r.entity, r.visit, CAST(r.rk - greatest(0, i.rk - 19) AS INT) AS visit_idx FROM ranked r JOIN idx i USING (entity) WHERE r.rk <= i.rk AND r.rk > i.rk - 20",
    "cond": f"SELECT visit, 'C:' || v || '_' || c AS token, min(seq_num) AS first_rank FROM (SELECT {ident('hadm_id')} AS visit, {code('icd_code')} AS c, coalesce(icd_version, 10) AS v, seq_num FROM diagnoses) WHERE visit IS NOT NULL AND c IS NOT NULL AND NOT starts_with(c, 'Z') GROUP BY ALL",
    "ht": "SELECT h.*, token, first_rank FROM hist h JOIN cond USING (visit)",
    "smp": f"SELECT DISTINCT {ident('index_hadm_id')} AS visit, unnest(flat_tokens) AS token FROM samples WHERE {ident('index_hadm_id')} IS NOT NULL",
    "xw": f"SELECT rxcui, min(ing) AS ingredient FROM (SELECT {ident('rxcui')} AS rxcui, {ident('ingredient_rxcui')} AS ing FROM ndc_to_ingredient) WHERE rxcui IS NOT NULL AND ing IS NOT NULL GROUP BY rxcui HAVING count(DISTINCT ing) = 1",
    "n11": r"SELECT DISTINCT ndc, CASE WHEN regexp_replace(regexp_replace(trim(ndc), '\.0$', ''), '\D', '', 'g') = '' THEN NULL WHEN len(string_split(trim(ndc), '-')) = 3 THEN left(lpad(regexp_replace(split_part(trim(ndc), '-', 1), '\D', '', 'g'), 5, '0') || lpad(regexp_replace(split_part(trim(ndc), '-', 2), '\D', '', 'g'), 4, '0') || lpad(regexp_replace(split_part(trim(ndc), '-', 3), '\D', '', 'g'), 2, '0'), 11) ELSE lpad(left(regexp_replace(regexp_replace(trim(ndc), '\.0$', ''), '\D', '', 'g'), 11), 11, '0') END AS ndc11 FROM ndc_to_ingredient",
    "ttl": f"SELECT 'D' AS stream, code, min(title) AS title FROM (SELECT {code('icd_code')} AS code, left(trim(long_title), 60) AS title FROM d_icd_diagnoses) WHERE code IS NOT NULL AND title IS NOT NULL AND title != '' GROUP BY code",
    "dn0": f"SELECT {ident('ingredient_rxcui')} AS rxcui, trim(ingredient_name) AS n, map_id FROM ndc_to_ingredient WHERE trim(ingredient_name) != ''",
    "dn": "SELECT rxcui, upper(left(arg_min(n, {'m': map_id, 'n': upper(left(n, 1)) || lower(substring(n, 2))}), 1)) || lower(substring(arg_min(n, {'m': map_id, 'n': upper(left(n, 1)) || lower(substring(n, 2))}), 2)) AS name FROM dn0 WHERE rxcui IS NOT NULL GROUP BY rxcui",
    "acute": "SELECT *, coalesce(kind IN ('EMERGENCY', 'URGENT'), false) AS is_acute FROM v",
    "recent": "SELECT a.visit, count(b.visit) AS n_recent FROM acute a LEFT JOIN acute b ON a.entity = b.entity AND b.is_acute AND epoch_us(b.s) >= epoch_us(a.s) - 183 * 86400000000 AND epoch_us(b.s) < epoch_us(a.s) GROUP BY a.visit",
    "dx": f"SELECT {ident('hadm_id')} AS visit, {code('icd_code')} AS c, coalesce(icd_version, 10) AS v FROM diagnoses WHERE {ident('hadm_id')} IS NOT NULL AND {code('icd_code')} IS NOT NULL",
    "dxv": "SELECT visit, arg_max(v, {'n': n, 'v': -v}) AS v FROM (SELECT visit, v, count(*) AS n FROM dx GROUP BY ALL) GROUP BY visit",
    "pre": "SELECT unnest($PREFIXES) AS p",
    "cci": "SELECT visit, sum(w) AS weight, array_to_string(list_sort(list(cat)), ',') AS categories FROM (SELECT DISTINCT d.visit, p.cat AS cat, p.w AS w FROM dx d JOIN dxv USING (visit) JOIN (SELECT p.v AS pv, p.p AS pp, p.c AS cat, p.w AS w FROM pre) p ON p.pv = dxv.v AND starts_with(d.c, p.pp)) GROUP BY visit",
    "risk0": "SELECT a.*, (epoch_us(e) - epoch_us(s)) / 86400e6 AS days, coalesce(weight, 0) AS weight, n_recent FROM acute a LEFT JOIN cci USING (visit) JOIN recent USING (visit)",
    "risk": "SELECT *, l + a + c + e1 AS score FROM (SELECT entity, visit, days, weight, CASE WHEN days IS NULL THEN 6 WHEN days < 1 THEN 0 WHEN days = 1 THEN 1 WHEN days = 2 THEN 2 WHEN days = 3 THEN 3 WHEN days <= 6 THEN 4 WHEN days <= 13 THEN 5 ELSE 6 END AS l, CASE WHEN is_acute THEN 3 ELSE 0 END AS a, CASE WHEN weight >= 4 THEN 5 ELSE weight END AS c, least(n_recent, 4) AS e1 FROM risk0)",
    "ppl": f"SELECT {ident('subject_id')} AS entity, min(gender) AS gender, max(anchor_age) AS age FROM patients WHERE {ident('subject_id')} IS NOT NULL GROUP BY 1",
    "coh": "SELECT i.*, gender, age, score, days FROM idx i LEFT JOIN ppl USING (entity) LEFT JOIN risk USING (visit)",
    "seq": f"SELECT concat_ws('|', {ident('patient_id')}, {ident('index_hadm_id')}) AS key, max(readmission) AS y, max(n_visits) AS n_visits, max(combined_full) AS t FROM sequences WHERE combined_full IS NOT NULL GROUP BY 1",
    "tok0": "SELECT key, y, n_visits, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM seq",
    "tok1": "SELECT *, sum(CASE WHEN token = '[VISIT]' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) - 1 AS visit_idx FROM tok0",
    "tok": "SELECT * FROM tok1 WHERE regexp_matches(token, '^[CPD]:')",
    "tt": "SELECT count(*) FILTER (y = 1) AS t1, count(*) FILTER (y = 0) AS t0 FROM (SELECT DISTINCT key, y FROM tok WHERE y IS NOT NULL)",
    "w": "SELECT token, a AS n_pos, b AS n_neg, ln(((a + 0.5) * ((t0 - b) + 0.5)) / ((b + 0.5) * ((t1 - a) + 0.5))) AS weight FROM (SELECT token, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS b FROM (SELECT DISTINCT key, y, token FROM tok WHERE y IS NOT NULL) GROUP BY token), tt",
    "att": "SELECT tok.*, weight * (CAST(visit_idx + 1 AS DOUBLE) / greatest(1, n_visits)) AS attr, left(token, 1) AS stream FROM tok JOIN w USING (token)",
    "m0": "SELECT *, coalesce(sum(abs(attr)) OVER (PARTITION BY key ORDER BY abs(attr) DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(abs(attr)) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY abs(attr) DESC, pos) AS rn FROM att",
    "mk": "SELECT *, before / (total + 1e-12) < 0.8 AND rn <= 50 AS is_salient FROM m0",
    "rs": "SELECT *, CASE WHEN upto <= 0.6 * total THEN 1 ELSE 0 END AS c FROM (SELECT *, sum(abs(attr)) OVER (PARTITION BY key ORDER BY abs(attr) DESC, pos) AS upto FROM m0)",
    "ch": "SELECT DISTINCT key, token FROM mk WHERE is_salient",
    "bl": "SELECT key, y, visit_idx, list_sort(list_distinct(list(token))) AS items FROM mk JOIN ch USING (key, token) WHERE visit_idx >= 0 GROUP BY key, y, visit_idx",
    "blk": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY visit_idx) - 1 AS block_idx FROM bl",
    "it": "SELECT DISTINCT key, block_idx, unnest(items) AS a FROM blk",
    "sp": "SELECT key, a, min(block_idx) AS f, max(block_idx) AS l FROM it GROUP BY ALL",
    "pr": "SELECT x.a || ' -> ' || y.a AS pattern_id, x.a AS a, y.a AS b, count(*) AS support FROM sp x JOIN sp y ON x.key = y.key AND x.f < y.l GROUP BY ALL",
    "ep": "SELECT pattern_id AS pattern, support FROM pr UNION ALL SELECT a, count(DISTINCT key) FROM it GROUP BY a UNION ALL SELECT '{' || p.a || ', ' || q.a || '}', count(DISTINCT p.key) FROM it p JOIN it q ON p.key = q.key AND p.block_idx = q.block_idx AND p.a < q.a GROUP BY 1",
    "gleast": "SELECT greatest(1, ceil(0.02 * count(DISTINCT key))) AS least FROM blk",
    "g1": "SELECT DISTINCT key, [[a]] AS pat, a AS last, block_idx AS b FROM it",
    **_GROWN,
    "gs": "SELECT pat, support FROM (SELECT pat, count(DISTINCT key) AS support FROM (SELECT pat, key FROM g1f UNION ALL SELECT pat, key FROM g2f UNION ALL SELECT pat, key FROM g3f UNION ALL SELECT pat, key FROM g4f) GROUP BY pat)",
    "pat": f"SELECT {_TEXT} AS pattern_id, pat AS steps, len(pat) AS n_steps, len(flatten(pat)) AS n_tokens, support FROM gs",
    "vb": "SELECT key, visit_idx AS block_idx, list_sort(list_distinct(list(token))) AS items FROM tok WHERE visit_idx >= 0 GROUP BY ALL",
    "turned": "SELECT pattern_id, list_reverse(steps) AS steps FROM pat WHERE n_steps >= 2 AND len(list_distinct(flatten(steps))) >= 2",
    **_aligned("al", "pat", "blk"),
    **_aligned("rv", "turned", "blk"),
    **_aligned("oc", "pat", "vb"),
    "car": "SELECT pattern_id, key, steps, hits FROM al4",
    "ct": "SELECT pattern_id, key, block_idx, unnest(items) AS token FROM (SELECT pattern_id, key, unnest(hits) AS block_idx, unnest(steps) AS items FROM car)",
    "ot": "SELECT pattern_id, key, visit_idx, unnest(items) AS token FROM (SELECT pattern_id, key, unnest(hits) AS visit_idx, unnest(steps) AS items FROM oc4)",
    "tots": "SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM seq",
    "sc0": "SELECT pattern_id, count(*) AS n_present, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS b FROM car JOIN seq USING (key) WHERE y IS NOT NULL GROUP BY pattern_id",
    "sc": "SELECT *, ((a + 0.5) * (n0 - b + 0.5)) / ((b + 0.5) * (n1 - a + 0.5)) AS odds_ratio, a / greatest(n1, 1) AS prev_pos, b / greatest(n0, 1) AS prev_neg, a / greatest(n1, 1) - b / greatest(n0, 1) AS prev_diff FROM sc0, tots",
    "bs": "SELECT m.key, block_idx, m.token, sum(attr) AS attr_sum FROM mk m JOIN blk USING (key, visit_idx) WHERE is_salient AND visit_idx >= 0 GROUP BY ALL",
    "ins": "SELECT ct.pattern_id, ct.key, coalesce(sum(attr_sum), 0) AS score FROM ct LEFT JOIN bs USING (key, block_idx, token) GROUP BY ALL",
    "st": "SELECT pattern_id, odds_ratio, count(*) AS n_carriers, avg(score) AS attr_mean, median(score) AS attr_median, avg(abs(score)) AS attr_abs_mean, coalesce(avg(score) FILTER (CASE WHEN odds_ratio > 1 THEN score > 0 ELSE score < 0 END), 0) AS conditional_impact, count(*) FILTER (CASE WHEN odds_ratio > 1 THEN score > 0 ELSE score < 0 END) AS n_concordant FROM ins JOIN sc USING (pattern_id) GROUP BY pattern_id, odds_ratio",
    "sim": "SELECT a, b FROM (SELECT x.pattern_id AS a, y.pattern_id AS b, any_value(p.n) AS n_a, any_value(q.n) AS n_b, count(*) AS n_both FROM car x JOIN car y ON x.key = y.key AND x.pattern_id < y.pattern_id JOIN (SELECT pattern_id, count(*) AS n FROM car GROUP BY 1) p ON p.pattern_id = x.pattern_id JOIN (SELECT pattern_id, count(*) AS n FROM car GROUP BY 1) q ON q.pattern_id = y.pattern_id GROUP BY ALL) WHERE n_both / (n_a + n_b - n_both) >= 0.2",
    "rk": "SELECT pattern_id, row_number() OVER (ORDER BY abs(round(attr_mean, 9)) DESC, pattern_id) AS r FROM st",
    "near": "SELECT r, list(o) AS near FROM (SELECT greatest(x.r, y.r) AS r, least(x.r, y.r) AS o FROM sim JOIN rk x ON x.pattern_id = a JOIN rk y ON y.pattern_id = b) GROUP BY r",
    "led": "SELECT p.pattern_id, o.pattern_id AS leader FROM (SELECT r, CASE WHEN list_contains(leaders, r) THEN r ELSE list_min(list_intersect(leaders, near)) END AS l FROM rk LEFT JOIN near USING (r), (WITH RECURSIVE one AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT one.r + 1, CASE WHEN coalesce(list_has_any(leaders, near), false) THEN leaders ELSE list_append(leaders, one.r + 1) END FROM one LEFT JOIN near ON near.r = one.r + 1 WHERE one.r < (SELECT max(r) FROM rk)) SELECT leaders FROM one ORDER BY r DESC LIMIT 1)) a JOIN rk p ON p.r = a.r JOIN rk o ON o.r = a.l",
    "so": "SELECT key, y, round(1 / (1 + exp(-sum(attr))), 9) AS score FROM att GROUP BY key, y",
    "cv0": "SELECT score AS s, sum(y) AS p, sum(1 - y) AS n FROM so WHERE y IS NOT NULL GROUP BY score",
    "cv": "SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM cv0",
    "nv": "SELECT DISTINCT key, visit_idx, token FROM tok WHERE visit_idx >= 0",
    "fa": "SELECT key, visit_idx, token, arg_min(attr, pos) AS attr FROM att GROUP BY ALL",
}


def statement(sql: str) -> str:
    """The statement with the named parts it needs."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for n in PARTS:
            if n not in need and re.search(rf"(?:FROM|JOIN|,)\s+{n}\b(?!\.)", text):
                need.add(n)
                todo.append(PARTS[n])
    if not need:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in need) + "\n" + sql


_CHI = "CASE WHEN {r1} = 0 OR {r2} = 0 OR {k1} = 0 OR {k2} = 0 THEN 0 ELSE power(abs({a} - CAST({r1} AS DOUBLE) * {k1} / {n}) - least(0.5, abs({a} - CAST({r1} AS DOUBLE) * {k1} / {n})), 2) * power({n}, 3) / (CAST({r1} AS DOUBLE) * {r2} * {k1} * {k2}) END"
_CARRIED = _CHI.format(a="a", r1="(a + b)", r2="(n1 + n0 - a - b)", k1="n1", k2="n0", n="CAST(n1 + n0 AS DOUBLE)")
_GIVEN = _CHI.format(a="a", r1="(a + b)", r2="(n1 + n0 - a - b)", k1="n1", k2="n0", n="CAST(n1 + n0 AS DOUBLE)")
_QUART = "SELECT '{v}' AS variable, label, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, quantile_cont(CAST({v} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({v} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({v} AS DOUBLE), 0.75) AS q3 FROM coh WHERE {v} IS NOT NULL GROUP BY label"

RAW = {
    "visits": "SELECT entity, visit, CAST(floor(epoch(s)) AS BIGINT) AS start_s, CAST(floor(epoch(e)) AS BIGINT) AS end_s, kind FROM v",
    "label_30d": "SELECT visit, l_all AS label FROM lab",
    "label_30d_unplanned": "SELECT visit, l AS label FROM lab",
    "index_visit": "SELECT entity, visit, label, n_visits FROM idx",
    "token_union": "SELECT token, count(*) AS n_visits FROM (SELECT visit, token FROM cond UNION SELECT visit, token FROM smp WHERE regexp_matches(token, '^[CPD]:')) GROUP BY token",
    "frequency_ceiling": "SELECT token, count(*) AS n_visits FROM smp WHERE starts_with(token, 'D:') GROUP BY token HAVING count(*) <= 0.1 * (SELECT count(DISTINCT visit) FROM smp)",
    "excluded_names": "SELECT source, count(*) AS n FROM (SELECT DISTINCT * FROM ndc_to_ingredient) WHERE NOT coalesce(contains(lower(drug_name), 'patch') OR contains(lower(drug_name), 'syrup'), false) GROUP BY source",
    "first_occurrence": "SELECT entity, count(*) AS n, sum(m) AS idx_sum FROM (SELECT entity, token, min(visit_idx) AS m FROM ht GROUP BY ALL) GROUP BY entity",
    "chronic_filter": "SELECT entity, count(*) AS n FROM (SELECT *, min(visit_idx) OVER (PARTITION BY entity, token) AS m, regexp_replace(token, '^C:(9|10)_', '') AS c FROM ht) WHERE NOT (starts_with(c, 'C5') OR starts_with(c, 'E6')) OR visit_idx = m OR first_rank = 1 GROUP BY entity",
    "crosswalk": "SELECT rxcui, ingredient FROM xw",
    "harmonized_codes": f"SELECT r.map_id, coalesce(xw.ingredient, r.code) AS code FROM (SELECT DISTINCT map_id, {ident('rxcui')} AS code FROM ndc_to_ingredient) r LEFT JOIN xw ON xw.rxcui = r.code",
    "drug_map_tokens": f"SELECT DISTINCT CAST(m.map_id AS VARCHAR) AS visit, 'D:RX_' || k.rx AS token FROM ndc_to_ingredient m JOIN n11 USING (ndc) JOIN (SELECT ndc11, min({ident('ingredient_rxcui')}) AS rx FROM ndc_to_ingredient JOIN n11 USING (ndc) WHERE ndc11 IS NOT NULL AND {ident('ingredient_rxcui')} IS NOT NULL GROUP BY 1) k USING (ndc11) WHERE source = 'ndc_api'",
    "vocabulary": "SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INT) AS id FROM (SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 2) UNION ALL SELECT * FROM (VALUES ('[PAD]', NULL, 0), ('[CLS]', NULL, 1), ('[VISIT]', NULL, 2))",
    "framed_sequences": "SELECT entity, array_to_string(CASE WHEN len(t) > 24 THEN list_concat(t[1:1], t[-23:]) ELSE list_concat(t, list_transform(range(24 - len(t)), lambda x: '[PAD]')) END, ' ') AS tokens FROM (SELECT entity, list_concat(['[CLS]'], flatten(list(list_concat(['[VISIT]'], t) ORDER BY visit_idx))) AS t FROM (SELECT entity, visit_idx, list_sort(list_distinct(list(token))) AS t FROM ht GROUP BY ALL) GROUP BY entity)",
    "split_by_entity": "SELECT entity, CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT entity, CAST('0x' || left(md5('42:' || entity), 8) AS BIGINT) % 100 AS b FROM v)",
    "split_stored": "SELECT CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT CAST('0x' || left(md5('42:' || entity), 8) AS BIGINT) % 100 AS b FROM v) GROUP BY 1",
    "entity_subsample": "SELECT entity FROM (SELECT DISTINCT entity FROM v) ORDER BY CAST('0x' || left(md5('42:' || entity), 8) AS BIGINT), entity LIMIT 50",
    "title_dictionary": "SELECT stream, code, title FROM ttl",
    "drug_dictionary": "SELECT rxcui, name FROM dn",
    "token_labels": r"SELECT token, stream, version, code, CASE WHEN length(label) > 30 THEN left(label, 29) || '…' ELSE label END AS label, canonical FROM (SELECT t.*, CASE WHEN length(trim(title)) > 0 THEN trim(title) || ' (' || t.code || ')' ELSE token END AS label, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS canonical FROM (SELECT DISTINCT token, left(token, 1) AS stream, TRY_CAST(nullif(regexp_extract(token, '^[CP]:(9|10)_', 1), '') AS INT) AS version, regexp_replace(token, '^[CPD]:(?:(?:9|10|RX)_)?', '') AS code FROM tok) t LEFT JOIN (SELECT 'C' AS stream, code, title FROM ttl UNION ALL SELECT 'D', rxcui, name FROM dn) n ON n.stream = t.stream AND n.code = t.code)",
    "short_titles": r"SELECT code, CASE WHEN title = 'Acute injury of airway' THEN 'Airway injury' ELSE trim(regexp_replace(replace(replace(CASE WHEN contains(title, 'Congenital') THEN replace(title, 'Congenital', 'Cong.') WHEN contains(title, 'Chronic') THEN replace(title, 'Chronic', 'Chr.') WHEN contains(title, 'Recurrent') THEN replace(title, 'Recurrent', 'Rec.') ELSE title END, ', unspecified', ''), 'connective tissue', 'conn. tissue'), '\s+', ' ', 'g')) END AS short_title FROM ttl",
    "ndc_normalized": "SELECT ndc, ndc11 FROM n11",
    "pattern_text": "SELECT DISTINCT pattern_id, array_to_string(list_transform(k, lambda s: CASE WHEN len(s) > 1 THEN '{' || array_to_string(s, ', ') || '}' ELSE s[1] END), ' -> ') AS text, len(list_distinct(flatten(k))) AS n_distinct, len(k) AS n_steps, true AS same, array_to_string(list_transform(list_reverse(k), lambda s: CASE WHEN len(s) > 1 THEN '{' || array_to_string(s, ', ') || '}' ELSE s[1] END), ' -> ') AS reversed FROM (SELECT pattern_id, list_transform(pattern_key, lambda s: list_sort(s)) AS k FROM mined_patterns_train)",
    "pattern_filters": "SELECT DISTINCT pattern_id, pattern FROM mined_patterns_train WHERE len(pattern_key) >= 2 AND len(list_distinct(flatten(pattern_key))) >= 2 AND n_admissions_present >= 5",
    "emergency_lookback": "SELECT visit, n_recent FROM recent",
    "emergency_lookback_table": "SELECT visit, n_recent FROM recent",
    "comorbidity": "SELECT visit, weight, categories FROM cci",
    "risk_index": "SELECT visit, score, l, a, c, e1 AS e, weight, round(days, 6) AS days FROM risk",
    "risk_components_by_label": "SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(days), 6) AS mean_days FROM coh GROUP BY label",
    "risk_auroc": "SELECT round(sum(n * (tp - p + p / 2.0)) / (max(tp) * max(fp)), 6) AS auroc FROM (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, sum(l1) AS p, sum(1 - l1) AS n FROM (SELECT score, lab.l AS l1 FROM lab JOIN risk USING (visit)) GROUP BY score))",
    "cohort_quartiles": " UNION ALL ".join(_QUART.format(v=v) for v in ("age", "n_visits", "score")),
    "cohort_levels": "SELECT label, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY label), 6) AS percent FROM (SELECT label, coalesce(gender, 'missing') AS level, count(*) AS n FROM coh GROUP BY ALL)",
    "cohort_summary": "SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(*) FILTER (label = 1) AS n_pos, round(avg(label), 6) AS pos_rate, round(avg(CASE WHEN n_visits > 1 THEN 1.0 ELSE 0 END), 6) AS multi_visit_share FROM idx",
    "key_coverage": f"SELECT count(*) AS n_rows, count(v.visit) AS n_covered, round(100.0 * count(v.visit) / count(*), 6) AS percent FROM (SELECT {ident('patient_id')} AS p, {ident('index_hadm_id')} AS h FROM samples) s LEFT JOIN v ON v.entity = s.p AND v.visit = s.h",
    "upserted_map": "SELECT drug_name, map_id, source FROM (SELECT *, row_number() OVER (PARTITION BY drug_name ORDER BY CASE WHEN source = 'drugname_api' THEN 1 ELSE 0 END DESC, map_id DESC, ingredient_rxcui DESC NULLS LAST) AS r FROM ndc_to_ingredient WHERE drug_name IS NOT NULL AND source IN ('ndc_api', 'drugname_api')) WHERE r = 1",
    "pending_keys": "SELECT drug_name FROM ndc_to_ingredient WHERE source = 'drugname_api' AND drug_name IS NOT NULL EXCEPT SELECT drug_name FROM ndc_to_ingredient WHERE source = 'ndc_api'",
    "same_keys": "SELECT NOT EXISTS (SELECT visit FROM v EXCEPT SELECT visit FROM dx) AND NOT EXISTS (SELECT " + ident("hadm_id") + " FROM diagnoses WHERE " + ident("hadm_id") + " IS NOT NULL EXCEPT SELECT visit FROM v) AS same",
    "finite_rows": "SELECT count(*) AS n FROM coh WHERE age IS NOT NULL AND score IS NOT NULL AND days IS NOT NULL",
    "token_weights": "SELECT token, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(weight, 6) AS weight FROM w",
    "attribution_totals": "SELECT key, count(*) AS n, round(sum(attr), 6) AS net, round(sum(abs(attr)), 6) AS mass FROM att GROUP BY key",
    "mass_selection": "SELECT key, pos, token FROM mk WHERE is_salient",
    "reselected_tokens": "SELECT key, count(*) AS n, sum(pos) AS pos_sum FROM (SELECT *, sum(c) OVER (PARTITION BY key) + 1 AS k FROM rs) WHERE rn <= k AND total >= 1e-12 GROUP BY key",
    "salient_blocks": "SELECT key, block_idx, visit_idx, array_to_string(items, ',') AS items FROM blk",
    "visit_token_sums": "SELECT token, count(*) AS n, round(sum(s), 6) AS attr_sum FROM (SELECT key, visit_idx, token, sum(attr) AS s FROM att GROUP BY ALL) GROUP BY token",
    "block_token_sums": "SELECT token, count(*) AS n, round(sum(attr_sum), 6) AS attr_sum FROM bs GROUP BY token",
    "token_importance": "SELECT token, n_present, round(m, 6) AS attr_mean, round(n_present / total, 6) AS prevalence, round(m * n_present / total, 6) AS population_mean FROM (SELECT token, count(*) AS n_present, avg(s) AS m FROM (SELECT token, split_part(key, '|', 1) AS e, sum(attr) AS s FROM att GROUP BY ALL) GROUP BY token HAVING count(*) >= 10), (SELECT CAST(count(DISTINCT split_part(key, '|', 1)) AS DOUBLE) AS total FROM att)",
    "occurrence_means": "SELECT token, count(*) AS n_occurrences, round(avg(attr), 6) AS attr_mean, round(avg(abs(attr)), 6) AS attr_abs_mean FROM att GROUP BY token",
    "stream_pivot": 'SELECT y, round(avg(s) FILTER (stream = \'C\'), 6) AS "C", round(avg(s) FILTER (stream = \'D\'), 6) AS "D", round(avg(s) FILTER (stream = \'P\'), 6) AS "P" FROM (SELECT key, y, stream, sum(abs(attr)) AS s FROM att WHERE y IS NOT NULL GROUP BY ALL) GROUP BY y',
    "entity_token_matrix": "SELECT y, key, token, round(arg_max(attr, pos), 6) AS attr FROM att WHERE (y, key) IN (SELECT (y, key) FROM (SELECT y, key, row_number() OVER (PARTITION BY y ORDER BY round(sum(abs(attr)), 9) DESC, key) AS r FROM att WHERE y IS NOT NULL GROUP BY y, key) WHERE r <= 10) AND token IN (SELECT token FROM att WHERE y IS NOT NULL GROUP BY token ORDER BY round(sum(abs(attr)), 9) DESC, token LIMIT 8) GROUP BY y, key, token",
    "net_over_visits": "SELECT key, visit_idx, round(net, 6) AS net, round(sum(net) OVER (PARTITION BY key ORDER BY visit_idx), 6) AS running_net, lead_token, round(lead_attr, 6) AS lead_attr FROM (SELECT key, visit_idx, sum(attr) AS net, arg_max(token, {'a': abs(attr), 'p': -pos}) AS lead_token, arg_max(attr, {'a': abs(attr), 'p': -pos}) AS lead_attr FROM att GROUP BY key, visit_idx)",
    "score_histogram": "SELECT CAST(least(39, floor(score * 40)) AS INT) AS bin, count(*) AS n FROM so GROUP BY 1",
    "score_spread": "SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg(CASE WHEN score < 0.05 THEN 1.0 ELSE 0 END), 6) AS share_low, round(avg(CASE WHEN score > 0.95 THEN 1.0 ELSE 0 END), 6) AS share_high FROM so",
    "compression": "SELECT round(avg(f), 6) AS mean_full, round(avg(s), 6) AS mean_salient, round(avg(s) / avg(f), 6) AS ratio FROM (SELECT key, count(*) AS f, count(*) FILTER (is_salient) AS s FROM mk GROUP BY key)",
    "scaled_attributions": "SELECT stream, round(avg(x), 6) AS mean_scaled FROM (SELECT stream, attr / (max(abs(attr)) OVER (PARTITION BY key) + 1e-12) AS x FROM att) GROUP BY stream",
    "episodes_len2": "SELECT pattern, support FROM ep WHERE support >= ceil(0.02 * (SELECT count(DISTINCT key) FROM blk))",
    "episode_pairs": "SELECT pattern, support FROM ep WHERE support >= ceil(2 * (SELECT count(DISTINCT key) FROM blk) / 100)",
    "episodes_len4": f"SELECT {_TEXT} AS pattern, support FROM gs",
    "pattern_pvalues": f"SELECT pattern_id, n_present, CAST(a AS BIGINT) AS n_present_pos, CAST(b AS BIGINT) AS n_present_neg, n1 AS n_total_pos, n0 AS n_total_neg, round(odds_ratio, 6) AS odds_ratio, round(ln(odds_ratio), 6) AS log_or, round(chi, 6) AS chi2, round(prev_pos, 6) AS prev_pos, round(prev_neg, 6) AS prev_neg, round(prev_diff, 6) AS prev_diff, round(p, 6) AS p, round(least(1, p * count(*) OVER ()), 6) AS p_bonferroni, least(1, p * count(*) OVER ()) < 0.05 AS significant FROM (SELECT *, {_TAIL} AS p FROM (SELECT *, {_CARRIED} AS chi FROM sc))",
    "ngram_support": "WITH ev AS (SELECT key, y, list(token ORDER BY pos) AS t FROM tok GROUP BY key, y), s AS (SELECT DISTINCT key, y, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' -> ' || t[i + 1]))) AS ngram FROM ev), n AS (SELECT y, count(*) AS n FROM ev GROUP BY y), f AS (SELECT DISTINCT ngram FROM (SELECT ngram, y, count(*) AS k FROM s WHERE y IS NOT NULL GROUP BY ngram, y) JOIN n USING (y) WHERE k >= greatest(1, ceil(0.02 * n.n))) SELECT ngram, count(*) AS n_keys FROM s JOIN f USING (ngram) GROUP BY ngram",
    "episode_carriers": "SELECT pattern_id, key, hits[1] AS first_block, hits[-1] AS last_block FROM car",
    "pattern_scores": f"SELECT pattern_id, n_present, CAST(a AS BIGINT) AS n_present_pos, CAST(b AS BIGINT) AS n_present_neg, n1 AS n_total_pos, n0 AS n_total_neg, round(odds_ratio, 6) AS odds_ratio, round(ln(odds_ratio), 6) AS log_or, round({_CARRIED}, 6) AS chi2, round(prev_pos, 6) AS prev_pos, round(prev_neg, 6) AS prev_neg, round(prev_diff, 6) AS prev_diff, n_steps, n_tokens FROM sc JOIN pat USING (pattern_id)",
    "table_statistics": f"SELECT DISTINCT pattern_id, round(((a + 0.5) * (n0 - b + 0.5)) / ((b + 0.5) * (n1 - a + 0.5)), 6) AS odds_ratio, round({_GIVEN}, 6) AS chi2 FROM (SELECT pattern_id, n_present_readmit1 AS a, n_present_readmit0 AS b, n_total_readmit1 AS n1, n_total_readmit0 AS n0 FROM mined_patterns_train WHERE n_present_readmit1 IS NOT NULL)",
    "capped_patterns": "SELECT pattern_id, n_steps, round(o, 6) AS odds_ratio FROM (SELECT *, row_number() OVER (PARTITION BY n_steps ORDER BY o DESC, pattern_id) AS u, row_number() OVER (PARTITION BY n_steps ORDER BY o, pattern_id) AS d FROM (SELECT pattern_id, n_steps, round(odds_ratio, 9) AS o FROM sc JOIN pat USING (pattern_id))) WHERE u <= 5 OR d <= 5",
    "capped_by_prevalence": "SELECT pattern_id, round(x, 6) AS prev_diff FROM (SELECT *, row_number() OVER (PARTITION BY n_steps, x > 0 ORDER BY abs(x) DESC, pattern_id) AS u FROM (SELECT pattern_id, n_steps, round(prev_diff, 9) AS x FROM sc JOIN pat USING (pattern_id))) WHERE u <= 5",
    "balanced_patterns": "SELECT pattern_id, round(x, 6) AS attr_mean, u AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sign(x) ORDER BY abs(x) DESC, pattern_id) AS u FROM (SELECT pattern_id, round(attr_mean, 9) AS x FROM st) WHERE x != 0) WHERE u <= 5",
    "odds_extremes": "SELECT pattern_id, round(o, 6) AS odds_ratio, CASE WHEN o > 1 THEN 'above' ELSE 'below' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY o > 1 ORDER BY CASE WHEN o > 1 THEN -o ELSE o END, pattern_id) AS u FROM (SELECT pattern_id, round(odds_ratio, 9) AS o FROM sc) WHERE o != 1) WHERE u <= 5",
    "pooled_patterns": "WITH g AS (SELECT pattern_id, y, count(*) AS n FROM car JOIN seq USING (key) WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT pattern_id FROM g WHERE y = 1), q AS (SELECT pattern_id FROM g WHERE y = 0) SELECT side, n FROM (SELECT 'a' AS side, count(*) AS n FROM p WHERE pattern_id NOT IN (FROM q) UNION ALL SELECT 'b', count(*) FROM q WHERE pattern_id NOT IN (FROM p)) WHERE n > 0 UNION ALL SELECT 'pooled', count(DISTINCT pattern_id) FROM g",
    "instance_scores": "SELECT pattern_id, key, round(score, 6) AS score FROM ins",
    "pattern_stats": "SELECT pattern_id, round(odds_ratio, 6) AS odds_ratio, n_carriers, round(attr_mean, 6) AS attr_mean, round(attr_median, 6) AS attr_median, round(attr_abs_mean, 6) AS attr_abs_mean, round(conditional_impact, 6) AS conditional_impact, n_concordant FROM st",
    "occurrence_scores": "SELECT pattern_id, key, round(sum(attr), 6) AS score, count(*) AS n_matched FROM ot JOIN fa USING (key, visit_idx, token) GROUP BY ALL",
    "matched_positions": "SELECT pattern_id, key, array_to_string(list_sort(list(pos)), ',') AS positions FROM (SELECT DISTINCT ot.pattern_id, ot.key, tok.pos FROM ot JOIN tok USING (key, visit_idx, token)) GROUP BY pattern_id, key",
    "order_contrast": "SELECT pattern_id, count(f) AS n_forward, count(r) AS n_reversed, count(f + r) AS n_both, count(f) - count(f + r) AS n_forward_only, count(r) - count(f + r) AS n_reversed_only, round(avg(score) FILTER (f = 1), 6) AS mean_forward, round(avg(score) FILTER (r = 1), 6) AS mean_reversed, round(avg(score) FILTER (f = 1 AND r IS NULL), 6) AS mean_forward_only, round(avg(score) FILTER (r = 1 AND f IS NULL), 6) AS mean_reversed_only, round(avg(score) FILTER (f = 1 AND r IS NULL) - avg(score) FILTER (r = 1 AND f IS NULL), 6) AS mean_diff FROM (SELECT coalesce(x.pattern_id, z.pattern_id) AS pattern_id, coalesce(x.key, z.key) AS key, f, r FROM (SELECT pattern_id, key, 1 AS f FROM car JOIN turned USING (pattern_id)) x FULL JOIN (SELECT pattern_id, key, 1 AS r FROM rv4) z ON x.pattern_id = z.pattern_id AND x.key = z.key) LEFT JOIN so USING (key) GROUP BY pattern_id",
    "token_means_in_patterns": "SELECT pattern_id, token, round(avg(attr_sum), 6) AS attr_mean FROM ct JOIN bs USING (key, block_idx, token) GROUP BY ALL",
    "explanations": "SELECT key, 'token' AS kind, rn AS rank, token AS name, round(x, 6) AS value FROM (SELECT key, token, round(attr, 9) AS x, row_number() OVER (PARTITION BY key ORDER BY abs(round(attr, 9)) DESC, pos) AS rn FROM att) WHERE rn <= 5 UNION ALL SELECT key, 'pattern', r, pattern_id, round(v, 6) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(v, 9) DESC, pattern_id) AS r FROM (SELECT x.pattern_id, x.key, x.mass / (t.total + 1e-12) AS v FROM (SELECT ct.pattern_id, ct.key, coalesce(sum(abs(attr_sum)), 0) AS mass FROM ct LEFT JOIN bs USING (key, block_idx, token) GROUP BY ALL) x JOIN (SELECT key, sum(abs(round(attr, 9))) AS total FROM att GROUP BY key) t ON t.key = x.key)) WHERE r <= 5",
    "carrier_similarity": "WITH s AS (SELECT pattern_id, count(*) AS n FROM car GROUP BY 1) SELECT a, b, n_a, n_b, n_both, round(n_both / (n_a + n_b - n_both), 6) AS similarity FROM (SELECT x.pattern_id AS a, y.pattern_id AS b, any_value(p.n) AS n_a, any_value(q.n) AS n_b, count(*) AS n_both FROM car x JOIN car y ON x.key = y.key AND x.pattern_id < y.pattern_id JOIN s p ON p.pattern_id = x.pattern_id JOIN s q ON q.pattern_id = y.pattern_id GROUP BY ALL) WHERE n_both / (n_a + n_b - n_both) >= 0.2",
    "auroc": "SELECT round(sum(n * (tp - p + p / 2.0)) / (max(tp) * max(fp)), 6) AS auroc FROM cv",
    "average_precision": "SELECT round(sum(p * tp / (tp + fp)) / max(tp), 6) AS average_precision FROM cv",
    "roc_curve": "SELECT round(s, 6) AS threshold, tp, fp, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM cv",
    "class_weight": "SELECT round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 6) AS pos_weight FROM seq",
    "performance_report": "SELECT (SELECT count(*) FROM so WHERE y = 1) AS n_pos, (SELECT count(*) FROM so WHERE y = 0) AS n_neg, (SELECT count(*) FROM so WHERE y IS NULL) AS n_unknown, round(sum(n * (tp - p + p / 2.0)) / (max(tp) * max(fp)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / max(tp), 6) AS average_precision, count(*) AS n_points FROM cv",
    "entity_report": "SELECT key, token, round(x, 6) AS attr, row_number() OVER (PARTITION BY key ORDER BY x DESC, pos) AS rank FROM (SELECT key, token, pos, round(attr, 9) AS x, row_number() OVER (PARTITION BY key ORDER BY abs(round(attr, 9)) DESC, pos) AS r FROM att) WHERE r <= 5",
    "fallback_patterns": "SELECT pattern_id, round(x, 6) AS pseudo, u AS rank FROM (SELECT *, row_number() OVER (PARTITION BY x > 0 ORDER BY abs(x) DESC, pattern_id) AS u FROM (SELECT pattern_id, CASE WHEN round(odds_ratio, 9) > 1 THEN round(odds_ratio, 9) ELSE -1 / round(odds_ratio, 9) END AS x FROM sc)) WHERE u <= 5",
    "conditional_report": "SELECT pattern_id, side, round(x, 6) AS conditional_impact, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(x) DESC, pattern_id) AS r FROM (SELECT pattern_id, CASE WHEN odds_ratio > 1 THEN 'risk' ELSE 'protective' END AS side, round(conditional_impact, 9) AS x FROM st WHERE n_concordant >= 5)) WHERE r <= 5",
    "presence_matrix": "WITH p AS (SELECT pattern_id FROM car GROUP BY 1 ORDER BY count(*) DESC, pattern_id LIMIT 10), o AS (SELECT pattern_id, key FROM car WHERE pattern_id IN (FROM p)), k AS (SELECT key FROM o GROUP BY 1 ORDER BY count(*) DESC, key LIMIT 30) SELECT p.pattern_id, k.key, CASE WHEN o.key IS NULL THEN 0 ELSE 1 END AS present FROM p CROSS JOIN k LEFT JOIN o ON o.pattern_id = p.pattern_id AND o.key = k.key",
    "importance_panel": "SELECT kind, name, round(value, 6) AS value, row_number() OVER (ORDER BY abs(value) DESC, kind, name) AS rank FROM (SELECT 'token' AS kind, token AS name, round(avg(s), 9) AS value FROM (SELECT token, split_part(key, '|', 1) AS e, sum(attr) AS s FROM att GROUP BY ALL) GROUP BY token HAVING count(*) >= 10 UNION ALL SELECT 'pattern', pattern_id, round(attr_mean, 9) FROM st) ORDER BY abs(value) DESC, kind, name LIMIT 20",
    "imputed_patterns": "WITH r AS (SELECT sc.pattern_id, sc.odds_ratio > 1 AS g, CASE WHEN n_carriers % 2 = 0 THEN conditional_impact END AS x FROM sc JOIN st USING (pattern_id)) SELECT pattern_id, round(coalesce(x, median(x) OVER (PARTITION BY g), 0), 6) AS conditional_impact FROM r",
    "union_of_tops": "SELECT key, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))[1:6], ',') AS tokens FROM (SELECT key, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(list(token ORDER BY ra) FILTER (ra <= 4), lambda x: [x])), lambda u, x: CASE WHEN list_contains(u, x[1]) THEN u ELSE list_concat(u, x) END) AS a, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(list(token ORDER BY rb) FILTER (rb <= 4), lambda x: [x])), lambda u, x: CASE WHEN list_contains(u, x[1]) THEN u ELSE list_concat(u, x) END) AS b FROM (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY round(attr, 9) DESC, pos) AS ra, row_number() OVER (PARTITION BY key ORDER BY abs(round(attr, 9)) DESC, pos) AS rb FROM att) GROUP BY key)",
    "encoded_sequences": "WITH voc AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INT) AS id FROM (SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 2) UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[CLS]', 1), ('[VISIT]', 2))) SELECT key AS entity, array_to_string(list(CAST(id AS VARCHAR) ORDER BY pos), ' ') AS ids FROM tok1 JOIN voc USING (token) GROUP BY key",
    "flat_sequences": "WITH q AS (SELECT key, token, pos FROM tok), lim AS (SELECT ceil(0.1 * count(*)) AS least FROM seq), e1 AS (SELECT key, token AS pattern, min(pos) AS e FROM q GROUP BY ALL), f1 AS (SELECT pattern FROM e1 GROUP BY 1 HAVING count(*) >= (SELECT least FROM lim)), e2 AS (SELECT x.key, x.pattern || ' -> ' || q.token AS pattern, min(q.pos) AS e FROM (SELECT * FROM e1 JOIN f1 USING (pattern)) x JOIN q ON q.key = x.key AND q.pos > x.e GROUP BY ALL), f2 AS (SELECT pattern, count(*) AS support FROM e2 GROUP BY 1 HAVING count(*) >= (SELECT least FROM lim)), e3 AS (SELECT x.key, x.pattern || ' -> ' || q.token AS pattern FROM (SELECT e2.* FROM e2 JOIN f2 USING (pattern)) x JOIN q ON q.key = x.key AND q.pos > x.e GROUP BY ALL), f3 AS (SELECT pattern, count(*) AS support FROM e3 GROUP BY 1 HAVING count(*) >= (SELECT least FROM lim)) SELECT * FROM f2 UNION ALL SELECT * FROM f3",
    "ngrams_scored": f"WITH ev AS (SELECT key, y, list(token ORDER BY pos) AS t FROM tok WHERE y IS NOT NULL GROUP BY key, y), s AS (SELECT DISTINCT key, y, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' -> ' || t[i + 1]))) AS ngram FROM ev), n AS (SELECT y, count(*) AS n FROM ev GROUP BY y), f AS (SELECT DISTINCT ngram FROM (SELECT ngram, y, count(*) AS k FROM s GROUP BY ngram, y) JOIN n USING (y) WHERE k >= greatest(1, ceil(0.02 * n.n))), z AS (SELECT ngram AS pattern_id, count(*) AS n_present, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS b FROM s JOIN f USING (ngram) GROUP BY ngram) SELECT pattern_id, n_present, round(((a + 0.5) * (n0 - b + 0.5)) / ((b + 0.5) * (n1 - a + 0.5)), 6) AS odds_ratio, round({_CARRIED}, 6) AS chi2 FROM z, tots WHERE n_present >= greatest(1, ceil(0.02 * (n1 + n0)))",
    "characteristics": "WITH l AS (SELECT key, count(*) AS f, count(*) FILTER (is_salient) AS k FROM mk GROUP BY key), m AS (SELECT avg(f) AS a, stddev_samp(f) AS b, avg(k) AS c, stddev_samp(k) AS d FROM l), s AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, avg(n_visits) AS v, stddev_samp(n_visits) AS w FROM seq) SELECT unnest(['entities', 'positive', 'negative', 'visits', 'length', 'salient length', 'salient share']) AS name, unnest([CAST(n AS VARCHAR), CAST(p AS VARCHAR), CAST(q AS VARCHAR), printf('%.1f (%.1f)', v, w), printf('%.1f (%.1f)', a, b), printf('%.1f (%.1f)', c, d), printf('%.1f%%', 100 * c / a)]) AS value FROM s, m",
    "session_episodes": "WITH z AS (SELECT user_id AS u, event_type AS a, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)), i AS (SELECT DISTINCT u, k, a FROM z WHERE a IS NOT NULL), e AS (SELECT a AS pattern, count(DISTINCT u) AS support FROM i GROUP BY a UNION ALL SELECT x.a || ' -> ' || y.a, count(DISTINCT x.u) FROM i x JOIN i y ON x.u = y.u AND x.k < y.k GROUP BY 1 UNION ALL SELECT '{' || x.a || ', ' || y.a || '}', count(DISTINCT x.u) FROM i x JOIN i y ON x.u = y.u AND x.k = y.k AND x.a < y.a GROUP BY 1) SELECT pattern, support FROM e WHERE support >= ceil(0.5 * (SELECT count(DISTINCT u) FROM z))",
    "rounded_ranking": "SELECT pattern_id, row_number() OVER (ORDER BY round_even(CAST(abs(x) AS DECIMAL(18, 9)), 2) DESC, n_steps DESC, abs(x) DESC, pattern_id) AS rank FROM (SELECT pattern_id, n_steps, round(attr_mean, 9) AS x FROM st JOIN pat USING (pattern_id))",
    "leader_clusters": "SELECT pattern_id, leader FROM led",
    "cluster_report": "WITH z AS (SELECT leader, count(*) AS cluster_size, sum(n_carriers) AS cluster_total, any_value(lm) AS leader_mean FROM (SELECT led.*, st.n_carriers, o.attr_mean AS lm FROM led JOIN st USING (pattern_id) JOIN st o ON o.pattern_id = led.leader) GROUP BY leader), y AS (SELECT *, row_number() OVER (ORDER BY abs(leader_mean) DESC, leader) AS cluster_id FROM z) SELECT cluster_id, pattern_id = leader AS is_leader, pattern_id, round(attr_mean, 6) AS attr_mean, n_carriers AS n_present, round(odds_ratio, 6) AS odds_ratio, cluster_size, cluster_total, leader AS leader_pattern, round(leader_mean, 6) AS leader_mean, CASE WHEN leader_mean > 0 THEN 'risk' ELSE 'protective' END AS direction FROM led JOIN st USING (pattern_id) JOIN y USING (leader)",
    "excluded_tokens": "SELECT count(*) AS n FROM tok WHERE token NOT IN ('C:10_C5860', 'D:RX_450958')",
    "flat_positions": "WITH ev AS (SELECT key, token, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM tok), f AS (SELECT key, min(pos) AS p FROM ev WHERE token = 'C:10_C5860' GROUP BY key), g AS (SELECT ev.key, f.p, min(pos) AS q FROM ev JOIN f ON f.key = ev.key AND token = 'C:10_E612' AND pos > f.p GROUP BY ev.key, f.p), u AS (SELECT x.key, min(x.pos) AS p, arg_min(y.pos, x.pos) AS q FROM ev x JOIN ev y ON x.key = y.key AND y.i = x.i + 1 AND x.token = 'C:10_C5860' AND y.token = 'C:10_E612' GROUP BY x.key) SELECT 'gapped' AS kind, key, p AS first_pos, q AS last_pos FROM g UNION ALL SELECT 'unbroken', key, p, q FROM u UNION ALL SELECT 'ordered', key, p, q FROM g",
    "event_sessions": "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tokens FROM (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 6 * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, k",
}


def oracles() -> dict[str, str]:
    from chronoweave.operators.risk import prefix_rows

    rows = ", ".join(f"{{'v': {v}, 'p': '{p}', 'c': '{c}', 'w': {w}}}" for v, p, c, w in prefix_rows())
    out = {}
    for name, sql in RAW.items():
        inner = re.match(r"WITH (.*)$", sql, re.S)
        full = statement(sql)
        if inner and full != sql:  # the statement's own WITH joins the named parts
            full = full[: full.rindex("\nWITH ")] + ",\n" + inner[1]
        out[name] = full.replace("$PREFIXES", f"[{rows}]")
    return out
