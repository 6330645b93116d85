"""The registered queries as plain SQL over the same tables, pair by pair and without any shortcut."""

from __future__ import annotations

from kinweave import config as settings
from kinweave.config import JARO_WINKLER, ResolverConfig
from kinweave.plans import catalog
from kinweave.sources import rdf, requests, views


def _norm(column: str) -> str:
    return f"NULLIF(regexp_replace(strip_accents(lower({column})), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


def _found(column: str, pattern: str) -> str:
    return f"NULLIF(regexp_extract({column}, '{pattern}', 1), '')"


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


PARTS = f"""mentions AS (
  SELECT 'p' || p_partkey AS mention_id, p_partkey AS seq, p_name AS legal_name, p_brand AS country_code,
         p_type AS nuts_code, CAST(p_size AS VARCHAR) AS post_code, {_norm("p_name")} AS name
  FROM part)"""
PAGES = f"""raw AS (
  SELECT 'g' || page_id AS mention_id, page_id AS seq, {_found("html", views.TITLE_PATTERN)} AS legal_name,
         {_found("url", views.LANGUAGE_PATTERN)} AS country_code, {_found("url", views.DOMAIN_PATTERN)} AS nuts_code,
         {_found("url", views.PATH_NUMBER_PATTERN)} AS post_code, {_found("url", views.HOST_PATTERN)} AS post_name
  FROM pages),
mentions AS (SELECT *, {_norm("legal_name")} AS name FROM raw)"""
DOCUMENTS = f"""mentions AS (
  SELECT 'd' || doc_id AS mention_id, doc_id AS seq, lang AS country_code, {_norm("text")} AS name FROM documents)"""
SUBMISSIONS = """incoming AS (
  SELECT 'v' || conv_id AS mention_id, conv_id, turn, text, role FROM conversations),
stored AS (SELECT * FROM incoming WHERE turn = 0 AND role = 'user')"""

SIMILAR = "l.country_code = r.country_code AND jaro_winkler_similarity(l.name, r.name) >= 0.8"


def _judged_turns(repeated: str) -> str:
    return f"""WITH {SUBMISSIONS},
sent AS (
  SELECT mention_id, turn, text, role FROM incoming
  UNION ALL SELECT mention_id, turn + {catalog.REPLAYED}, text, role FROM incoming WHERE turn = 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY turn) AS n,
         first_value(role) OVER (PARTITION BY mention_id ORDER BY turn) AS first_role,
         first_value(text) OVER (PARTITION BY mention_id ORDER BY turn) AS first_text FROM sent)
SELECT mention_id, turn, CASE WHEN n = 1 THEN 'new'
  WHEN role IS NOT DISTINCT FROM first_role AND text IS NOT DISTINCT FROM first_text THEN '{repeated}' ELSE 'conflict' END AS guard
FROM numbered"""


def _level(comparison: settings.Comparison) -> str:
    l, r = f"l.{comparison.field}", f"r.{comparison.field}"
    cases = [f"WHEN {r} IS NULL THEN -1", f"WHEN {l} IS NULL THEN 0", f"WHEN {l} = {r} THEN {len(comparison.thresholds) + 1}"]
    if comparison.kind == JARO_WINKLER:
        for position, threshold in enumerate(comparison.thresholds):
            cases.append(f"WHEN jaro_winkler_similarity({l}, {r}) >= {threshold} THEN {len(comparison.thresholds) - position}")
    return f"CASE {' '.join(cases)} ELSE 0 END AS gamma_{comparison.field}"


def _levels(config: ResolverConfig) -> str:
    return ", ".join(_level(c) for c in config.comparisons)


def _weight(config: ResolverConfig) -> str:
    terms = [_double(config.model.prior_weight)]
    for c in config.comparisons:
        cases = " ".join(
            f"WHEN {p.level} THEN {_double(p.weight)}" for p in config.model.parameters[c.field]
        )
        terms.append(f"CASE gamma_{c.field} WHEN -1 THEN CAST(0 AS DOUBLE) {cases} END")
    return " + ".join(terms)


def _gammas(config: ResolverConfig) -> str:
    return ", ".join(f"gamma_{c.field}" for c in config.comparisons)


PROBABILITY = "1.0::DOUBLE / (1.0::DOUBLE + pow(2.0::DOUBLE, -w))"


def _mention_links(view: str, config: ResolverConfig) -> str:
    """Links between mentions, later one left."""
    return f"""{view},
graded AS (
  SELECT l.mention_id AS ml, r.mention_id AS mr, l.seq AS sl, r.seq AS sr, {_levels(config)}
  FROM mentions l JOIN mentions r ON l.seq > r.seq AND {SIMILAR}),
links AS (SELECT * FROM (SELECT *, {_weight(config)} AS w FROM graded) WHERE w >= {config.match_weight_threshold})"""


def _profile_grades(view: str, config: ResolverConfig, fields: str, condition: str = SIMILAR, extra: str = "") -> str:
    """Graded pairs of profiles, for both directions that occur."""
    return f"""{view},
profiles AS (
  SELECT {fields}, min(seq) AS first_seq, max(seq) AS last_seq FROM mentions GROUP BY {fields}),
graded AS (
  SELECT l.first_seq AS new_profile, r.first_seq AS stored_profile, {extra} {_levels(config)}
  FROM profiles l JOIN profiles r ON r.first_seq < l.last_seq AND ({condition}))"""


PARTS_FIELDS = "name, legal_name, country_code, nuts_code, post_code"
PAGES_FIELDS = "name, legal_name, country_code, nuts_code, post_code, post_name"
MULTIRULE_FIELDS = "legal_name, country_code, post_name"


def _clusters(config: ResolverConfig) -> str:
    return f"""best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ml ORDER BY w DESC, sr) AS n FROM links) WHERE n = 1),
parents AS (
  SELECT m.mention_id, m.seq, CASE WHEN {PROBABILITY} >= {config.threshold} THEN b.mr END AS parent
  FROM mentions m LEFT JOIN best b ON b.ml = m.mention_id),
clusters AS (
  SELECT mention_id, seq, mention_id AS cluster_id FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT p.mention_id, p.seq, c.cluster_id FROM parents p JOIN clusters c ON p.parent = c.mention_id)"""


def _stored(top_n: int) -> str:
    return f"""stored_links AS (
  SELECT ml AS mention_id_l, mr AS mention_id_r, CAST({PROBABILITY} AS REAL) AS match_probability
  FROM (SELECT *, row_number() OVER (PARTITION BY ml ORDER BY w DESC, sr) AS n FROM links) WHERE n <= {top_n})"""


def _candidates(top_n: int) -> str:
    return f"""per_level AS (
  SELECT l.ml AS mention_id, c.cluster_id, CAST({PROBABILITY} AS REAL) AS p, min(l.sr) AS first_seq
  FROM links l JOIN clusters c ON c.mention_id = l.mr GROUP BY ALL),
linked AS (
  SELECT * EXCLUDE n FROM (
    SELECT *, row_number() OVER (PARTITION BY mention_id, cluster_id ORDER BY p DESC) AS n FROM per_level) WHERE n = 1),
offers AS (
  SELECT * FROM linked
  UNION ALL
  SELECT c.mention_id, c.cluster_id, NULL, c.seq FROM clusters c
  WHERE NOT EXISTS (SELECT 1 FROM linked k WHERE k.mention_id = c.mention_id AND k.cluster_id = c.cluster_id)),
candidates AS (
  SELECT mention_id, cluster_id, round(CAST(coalesce(p, 0) AS DOUBLE), 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY p DESC NULLS LAST, first_seq) AS rank FROM offers)
  WHERE rank <= {top_n})"""


def _with(body: str, select: str) -> str:
    return f"WITH RECURSIVE {body}\n{select}"


def _variant(l: str = "l", r: str = "r") -> str:
    return (
        f"{l}.seq < {r}.seq AND {l}.country_code = {r}.country_code AND {l}.name <> {r}.name "
        f"AND {l}.post_code = {r}.post_code AND jaro_winkler_similarity({l}.name, {r}.name) >= 0.95"
    )


EXACT = "l.seq < r.seq AND l.country_code = r.country_code AND l.name = r.name"


def _or(rules: list[list[str]]) -> str:
    return " OR ".join("(" + " AND ".join(f"l.{f} = r.{f}" for f in rule) + ")" for rule in rules)


def _first_rule(rules: list[list[str]]) -> str:
    cases = " ".join(
        f"WHEN {' AND '.join(f'l.{f} = r.{f}' for f in rule)} THEN {number}" for number, rule in enumerate(rules)
    )
    return f"CASE {cases} END"


def _first_rule_query(view: str, rules: list[list[str]]) -> str:
    keys = " UNION ALL ".join(f"SELECT {number} AS match_key" for number in range(len(rules)))
    return f"""WITH {view},
keyed AS (SELECT *, NULLIF(left(name, 4), '') AS prefix FROM mentions),
found AS (
  SELECT {_first_rule(rules)} AS match_key, count(*) AS pairs
  FROM keyed l JOIN keyed r ON l.seq < r.seq AND ({_or(rules)}) GROUP BY 1)
SELECT k.match_key, coalesce(f.pairs, 0) AS pairs FROM ({keys}) k LEFT JOIN found f USING (match_key)"""


def _blocks(fields: str) -> str:
    return f"""WITH {PARTS}
SELECT {fields}, count(*) AS mentions, arg_min(mention_id, seq) AS first_mention,
       count(*) * (count(*) - 1) // 2 AS pairs
FROM mentions GROUP BY {fields}"""


def _similar_names(view: str) -> str:
    return f"""WITH {view},
vals AS (SELECT country_code, name, min(seq) AS first_seq, count(*) AS n FROM mentions
         WHERE name IS NOT NULL GROUP BY country_code, name)
SELECT l.country_code, l.name AS l_name, r.name AS r_name,
       round(jaro_winkler_similarity(l.name, r.name), 9) AS similarity, l.n * r.n AS pairs
FROM vals l JOIN vals r ON l.first_seq < r.first_seq AND {SIMILAR}"""


def _pages_variants() -> str:
    parts = [
        f"SELECT '{name}' AS variant, count(*) AS pairs FROM keyed l JOIN keyed r ON l.seq < r.seq AND ({_or(rules)})"
        for name, rules in catalog.EQUALITY_VARIANTS.items()
    ]
    parts.append(f"SELECT 'name_similarity', count(*) FROM keyed l JOIN keyed r ON l.seq < r.seq AND {SIMILAR}")
    return f"""WITH {PAGES},
keyed AS (SELECT *, NULLIF(left(name, 4), '') AS prefix FROM mentions)
SELECT variant, pairs, round(pairs / (SELECT count(*) FROM mentions), 6) AS pairs_per_mention
FROM ({" UNION ALL ".join(parts)})"""


def _blocking_recall() -> str:
    rows = [
        f"SELECT '{rule}' AS rule, reference, count(*) FILTER (WHERE {rule}) AS admitted, "
        "count(*) FILTER (WHERE found) AS reference_pairs FROM refs GROUP BY reference"
        for rule in ("prefix", "post_code", "nuts_code")
    ]
    agree = ", ".join(f"l.{c} = r.{c} AS {c}" for c in ("prefix", "post_code", "nuts_code"))
    return f"""WITH {PARTS},
keyed AS (SELECT *, NULLIF(left(name, 4), '') AS prefix FROM mentions),
refs AS (
  SELECT 'exact' AS reference, true AS found, {agree} FROM keyed l JOIN keyed r ON {EXACT}
  UNION ALL SELECT 'variant', true, {agree} FROM keyed l JOIN keyed r ON {_variant()}
  UNION ALL SELECT 'exact', false, false, false, false UNION ALL SELECT 'variant', false, false, false, false)
SELECT *, round(admitted / NULLIF(reference_pairs, 0), 6) AS recall FROM ({" UNION ALL ".join(rows)})"""


def _model_report() -> str:
    config = catalog.parts_config()
    rows = []
    for c in config.comparisons:
        labels = ["exact", *[f">= {t}" for t in c.thresholds], "else"]
        for label, p in zip(labels, config.model.parameters[c.field]):
            rows.append(
                f"('{c.field}', {p.level}, '{label}', {_double(float(p.m))}, {_double(float(p.u))}, "
                f"round({_double(p.weight)}, 6), '{p.source}')"
            )
    seen = " UNION ALL ".join(f"SELECT '{c.field}' AS field, gamma_{c.field} AS level FROM kept" for c in config.comparisons)
    return f"""WITH {_profile_grades(PARTS, config, PARTS_FIELDS)},
kept AS (SELECT * FROM (SELECT *, {_weight(config)} AS w FROM graded) WHERE w >= {config.match_weight_threshold}),
observed AS (SELECT field, level, count(*) AS links FROM ({seen}) GROUP BY field, level),
params(field, level, label, m, u, weight, source) AS (VALUES {", ".join(rows)})
SELECT p.*, coalesce(o.links, 0) AS links FROM params p LEFT JOIN observed o USING (field, level)"""


def _text(value: str) -> str:
    """SQL string literal with line breaks."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _escaped(column: str) -> str:
    value = f"replace({column}, '\\', '\\\\')"
    for code, letter in (('34', '"'), ("10", "n"), ("13", "r"), ("9", "t")):
        value = f"replace({value}, chr({code}), '\\{letter}')"
    return value


def _page_content() -> str:
    def quoted(column: str) -> str:
        return f"""'"' || {_escaped(f"coalesce({column}, '')")} || '"'"""

    optional = ", ".join(
        f"CASE WHEN coalesce({c}, '') <> '' THEN '{p} ' || {quoted(c)} END"
        for c, p in requests.ADDRESS_PREDICATES.items()
        if c != "thoroughfare"
    )
    address = f"concat_ws({_text(' ;' + chr(10) + '        ')}, 'epo:hasCountryCode ' || {quoted('country_code')}, {optional})"
    return (
        f"{_text(requests.PREFIX_HEADER + chr(10) + 'epd:ent')} || mention_id || "
        f"{_text(' a org:Organization ;' + chr(10) + '    epo:hasLegalName ')} || {quoted('legal_name')} || "
        f"{_text(' ;' + chr(10) + '    cccev:registeredAddress [' + chr(10) + '        ')} || {address} || "
        f"{_text(chr(10) + '    ] .')}"
    )


SUPPLIERS = f"""mentions AS (
  SELECT sha256('{catalog.SOURCE_ID}' || 's' || s_suppkey || 'ORGANISATION') AS mention_id, 's' || s_suppkey AS request_id,
         s_suppkey * 8 AS seq, s_name AS legal_name, n_name AS country_code, r_name AS nuts_code,
         NULL::VARCHAR AS post_code, NULL::VARCHAR AS post_name, NULL::VARCHAR AS thoroughfare, {_norm("s_name")} AS name, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MESSAGES = """messages AS (
  SELECT seq AS arrival_seq, request_id, mention_id, 'new' AS guard FROM mentions
  UNION ALL SELECT seq + 1, request_id, mention_id, 'repeat' FROM mentions WHERE s_acctbal > 5000
  UNION ALL SELECT seq + 2, request_id, mention_id, 'conflict' FROM mentions WHERE s_acctbal < 0
  UNION ALL SELECT seq + 3, NULL, NULL, 'broken' FROM mentions WHERE s_acctbal > 9000
  UNION ALL SELECT seq + 4, request_id, NULL, 'odd' FROM mentions WHERE s_acctbal BETWEEN 3000 AND 4000
  UNION ALL SELECT seq + 5, request_id, NULL, 'odd' FROM mentions WHERE s_acctbal BETWEEN 6000 AND 7000)"""
REQUERY_COUNTS = """sides AS (
  SELECT mention_id_l AS mention_id, mention_id_r AS other, match_probability AS p FROM stored_links
  UNION ALL SELECT mention_id_r, mention_id_l, match_probability FROM stored_links),
offered AS (
  SELECT s.mention_id, c.cluster_id, s.p, c.seq FROM sides s JOIN clusters c ON c.mention_id = s.other
  UNION ALL SELECT mention_id, cluster_id, CAST(0 AS REAL), seq FROM clusters),
best_offer AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id, cluster_id ORDER BY p DESC, seq) AS n FROM offered) WHERE n = 1),
again AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY p DESC, seq, cluster_id) AS rank FROM best_offer) WHERE rank <= 100),
later AS (
  SELECT mention_id, count(*) AS n, arg_min(cluster_id, rank) AS top_cluster, round(CAST(arg_min(p, rank) AS DOUBLE), 6) AS top_score,
         sha256(string_agg(cluster_id, ',' ORDER BY rank)) AS order_digest FROM again GROUP BY 1),
firsts AS (
  SELECT mention_id, count(*) AS n, arg_min(cluster_id, rank) AS top_cluster, arg_min(score, rank) AS top_score,
         sha256(string_agg(cluster_id, ',' ORDER BY rank)) AS order_digest FROM candidates GROUP BY 1)"""


def _em_train(config: ResolverConfig) -> str:
    """The training rounds as a recursion over one row: all m, the share of matches, and the last change."""
    u_of, m_start, columns = {}, [], []
    for c in config.comparisons:
        start = settings.default_parameters(c.levels)[0]
        for level, value in zip(c.levels, start):
            columns.append((c.field, level, f"m_{c.field}_{level}"))
            m_start.append(f"{_double(value)} AS m_{c.field}_{level}")
    params = [(c.field, p.level, p.m, p.u, p.source) for c in config.comparisons for p in config.model.parameters[c.field]]
    labels = {c.field: dict(zip(c.levels, ["exact", *[f">= {t}" for t in c.thresholds], "else"])) for c in config.comparisons}

    def levels_of(table: str, field: str) -> str:
        return f"SELECT '{field}' AS field, gamma_{field} AS level, sum(pairs) AS n FROM {table} WHERE gamma_{field} <> -1 GROUP BY 2"

    fields = [c.field for c in config.comparisons]
    random_ = " UNION ALL ".join(levels_of("random_patterns", f) for f in fields)
    seen = " UNION ALL ".join(levels_of("patterns", f) for f in fields)
    hand = ", ".join(f"('{f}', {n}, '{labels[f][n]}', {_double(float(m))}, {_double(float(u))}, '{s}')" for f, n, m, u, s in params)
    own_u = " * ".join(
        f"CASE gamma_{f} WHEN -1 THEN 1 ELSE (SELECT u FROM u WHERE u.field = '{f}' AND u.level = p.gamma_{f}) END" for f in fields
    )
    own_m = " * ".join(
        "CASE gamma_" + f + " WHEN -1 THEN 1 " + " ".join(f"WHEN {n} THEN s.{name}" for g, n, name in columns if g == f) + " END" for f in fields
    )
    sums = ", ".join(
        f"coalesce(sum(w) FILTER (WHERE gamma_{f} = {n}), 0) / NULLIF(sum(w) FILTER (WHERE gamma_{f} <> -1), 0) AS new_{name}" for f, n, name in columns
    )
    kept = ", ".join(f"any_value({name}) AS {name}" for _, _, name in columns)
    moved = ", ".join(f"coalesce(new_{name}, {name}) AS {name}" for _, _, name in columns)
    change = ", ".join(f"abs(coalesce(new_{name}, {name}) - {name})" for _, _, name in columns)
    last = " UNION ALL ".join(f"SELECT '{f}' AS field, {n} AS level, {name} AS m FROM last" for f, n, name in columns)
    return f"""WITH RECURSIVE {PARTS},
sample AS (SELECT * FROM mentions ORDER BY mention_id LIMIT 200),
graded AS (SELECT {_levels(config)}, l.country_code = r.country_code AS same FROM sample l JOIN sample r ON l.mention_id < r.mention_id),
random_patterns AS (SELECT {_gammas(config)}, count(*) AS pairs FROM graded GROUP BY ALL),
patterns AS (SELECT {_gammas(config)}, count(*) AS pairs FROM graded WHERE same GROUP BY ALL),
hand(field, level, label, m, u, source) AS (VALUES {hand}),
observed AS (SELECT field, level, n / sum(n) OVER (PARTITION BY field) AS u FROM ({random_})),
seen AS ({seen}),
u AS (SELECT h.field, h.level, coalesce(o.u, h.u) AS u FROM hand h LEFT JOIN observed o USING (field, level)),
weighed AS (SELECT *, {own_u} AS other FROM patterns p),
rounds AS (
  SELECT 0 AS round, 1.0::DOUBLE AS change, {_double(float(config.model.prior))} AS prior, {", ".join(m_start)}
  UNION ALL
  SELECT round + 1, greatest(abs(new_prior - prior), {change}), new_prior, {moved} FROM (
    SELECT any_value(round) AS round, any_value(prior) AS prior, sum(w) / sum(pairs) AS new_prior, {kept}, {sums} FROM (
      SELECT p.*, s.*, p.pairs * s.prior * {own_m} / (s.prior * {own_m} + (1 - s.prior) * other) AS w
      FROM weighed p, rounds s WHERE s.round < 25 AND s.change >= 1e-4) HAVING count(*) > 0)),
last AS (SELECT * FROM rounds ORDER BY round DESC LIMIT 1),
trained AS ({last}),
result AS (
  SELECT h.field, h.level, h.label, s.level IS NOT NULL AND t.m > 0 AS learned, o.u IS NOT NULL AS counted, h.source,
         CASE WHEN s.level IS NOT NULL AND t.m > 0 THEN t.m ELSE h.m END AS m, coalesce(o.u, h.u) AS u
  FROM hand h JOIN trained t USING (field, level) LEFT JOIN seen s USING (field, level) LEFT JOIN observed o USING (field, level))
SELECT field, level, label, round(m, 6) AS m, round(u, 6) AS u, round(log2(m / u), 6) AS weight,
       CASE WHEN learned OR counted THEN 'trained' ELSE source END AS source FROM result"""


def sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    parts, pages, multi = catalog.parts_config(), catalog.pages_config(), settings.multirule()
    part_links = _mention_links(PARTS, parts)
    part_clusters = f"{part_links},\n{_clusters(parts)}"
    page_clusters = f"{_mention_links(PAGES, pages)},\n{_clusters(pages)}"
    supplier_clusters = f"{_mention_links(SUPPLIERS, settings.shipped())},\n{_clusters(settings.shipped())}"
    rules = [["country_code"], ["post_name"], ["legal_name"]]
    kept = f"(SELECT *, {_weight(parts)} AS w FROM graded)"
    stages = ", ".join(
        f"round(coalesce(sum(CASE WHEN event_type = '{e}' THEN value END), 0), 4) AS {e}_ms" for e in catalog.EVENT_TYPES
    )
    merged = f"""{part_clusters},
together AS (
  SELECT l.mention_id AS a, r.mention_id AS b, l.cluster_id, l.name AS ln, r.name AS rn
  FROM (SELECT m.*, c.cluster_id FROM mentions m JOIN clusters c USING (mention_id)) l
  JOIN (SELECT m.*, c.cluster_id FROM mentions m JOIN clusters c USING (mention_id)) r
    ON l.cluster_id = r.cluster_id AND l.seq < r.seq)"""
    recalls = f"""{part_clusters},
owned AS (SELECT m.*, c.cluster_id FROM mentions m JOIN clusters c USING (mention_id)),
refs AS (
  SELECT 'exact' AS reference, l.cluster_id = r.cluster_id AS same FROM owned l JOIN owned r ON {EXACT}
  UNION ALL
  SELECT 'variant', l.cluster_id = r.cluster_id FROM owned l JOIN owned r ON {_variant()}),
recall AS (
  SELECT n.reference, count(*) FILTER (WHERE same) AS together, count(same) AS reference_pairs
  FROM (SELECT 'exact' AS reference UNION ALL SELECT 'variant') n LEFT JOIN refs r ON n.reference = r.reference
  GROUP BY 1)"""
    return {
        "mention_id": "SELECT c_custkey, sha256(c_mktsegment || CAST(c_custkey AS VARCHAR) || 'ORGANISATION') AS mention_id FROM customer",
        "normalise_name": f"SELECT 'd' || doc_id AS mention_id, {_norm('text')} AS name FROM documents",
        "queue_wait": """SELECT o_orderkey, CASE WHEN taken IS NOT NULL THEN
  round(greatest((epoch_us(taken) - epoch_us(o_orderdate)) / 1000.0, 0.0), 3) END AS queue_wait_ms
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS taken FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
        "block_equality": _blocks("country_code"),
        "block_compound": _blocks("country_code, nuts_code"),
        "block_multirule": _first_rule_query(PAGES, rules),
        "block_prefix_address": _first_rule_query(PAGES, catalog.PREFIX_ADDRESS_RULES),
        "block_name_similarity": _similar_names(PARTS),
        "jaro_winkler": _similar_names(PAGES),
        "dedupe_pairs": f"""WITH {DOCUMENTS}
SELECT arg_min(mention_id, seq) AS first_mention, count(*) AS mentions, count(*) * (count(*) - 1) // 2 AS pairs
FROM mentions WHERE name IS NOT NULL GROUP BY country_code, name HAVING count(*) > 1""",
        "compare_levels": f"WITH {_profile_grades(PAGES, pages, PAGES_FIELDS)}\nSELECT * FROM graded",
        "match_weight": f"""WITH {_profile_grades(PARTS, parts, PARTS_FIELDS)}
SELECT new_profile, stored_profile, round(w, 6) AS match_weight FROM {kept} WHERE w >= -10""",
        "match_probability": f"""WITH {_profile_grades(PARTS, parts, PARTS_FIELDS)}
SELECT {_gammas(parts)}, count(*) AS links, round({PROBABILITY}, 9) AS match_probability
FROM {kept} WHERE w >= -10 GROUP BY {_gammas(parts)}, w""",
        "score_threshold": f"""WITH {_profile_grades(PAGES, pages, PAGES_FIELDS)}
SELECT {_gammas(pages)}, w >= -10 AS kept, count(*) AS pairs
FROM (SELECT *, {_weight(pages)} AS w FROM graded) GROUP BY ALL""",
        "multirule_links": f"""WITH {_profile_grades(PAGES, multi, MULTIRULE_FIELDS, _or(rules), f"{_first_rule(rules)} AS match_key,")}
SELECT new_profile, stored_profile, match_key, round(w, 6) AS match_weight
FROM (SELECT *, {_weight(multi)} AS w FROM graded) WHERE w >= -10""",
        "model_report": _model_report(),
        "best_match": _with(
            part_clusters, f"SELECT ml AS mention_id, mr AS best_id, round({PROBABILITY}, 6) AS best_score FROM best"
        ),
        "greedy_clusters": _with(part_clusters, "SELECT mention_id, cluster_id FROM clusters"),
        "resolve_incremental": _with(part_clusters, "SELECT mention_id, cluster_id FROM clusters"),
        "cluster_members": _with(
            part_clusters,
            """SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) AS members,
  row_number() OVER (PARTITION BY cluster_id ORDER BY seq) AS position, mention_id FROM clusters""",
        ),
        "state_snapshot": _with(
            f"{part_clusters},\n{_stored(100)}",
            """SELECT (SELECT count(*) FROM mentions) AS mention_count, (SELECT count(*) FROM stored_links) AS similarity_count,
  (SELECT count(DISTINCT cluster_id) FROM clusters) AS cluster_count""",
        ),
        "run_counters": _with(
            f"{part_clusters},\n{_stored(100)}",
            """SELECT (SELECT count(*) FROM mentions) AS mentions,
  (SELECT count(*) FROM clusters WHERE cluster_id <> mention_id) AS joins,
  (SELECT count(*) FROM stored_links) AS stored_links""",
        ),
        "top_links": _with(
            part_links,
            f"""SELECT ml AS mention_id_l, mr AS mention_id_r, round({PROBABILITY}, 6) AS match_probability, rank
FROM (SELECT *, row_number() OVER (PARTITION BY ml ORDER BY w DESC, sr) AS rank FROM links) WHERE rank <= 5""",
        ),
        "rank_candidates": _with(f"{part_clusters},\n{_candidates(3)}", "SELECT * FROM candidates"),
        "top_candidate": _with(
            f"{part_clusters},\n{_candidates(100)}", "SELECT mention_id, cluster_id, score FROM candidates WHERE rank = 1"
        ),
        "resolve_batch": _with(
            f"{page_clusters},\n{_candidates(100)}",
            """SELECT k.mention_id, c.cluster_id AS own_cluster, k.cluster_id, k.score, k.rank
FROM candidates k JOIN clusters c USING (mention_id)""",
        ),
        "requery_candidates": _with(
            f"""{part_clusters},
{_stored(5)},
sides AS (
  SELECT mention_id_l AS mention_id, mention_id_r AS other, match_probability AS p FROM stored_links
  UNION ALL SELECT mention_id_r, mention_id_l, match_probability FROM stored_links),
offers AS (
  SELECT s.mention_id, c.cluster_id, s.p, c.seq FROM sides s JOIN clusters c ON c.mention_id = s.other
  UNION ALL SELECT mention_id, cluster_id, CAST(0 AS REAL), seq FROM clusters),
scored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id, cluster_id ORDER BY p DESC, seq) AS n FROM offers) WHERE n = 1)""",
            """SELECT mention_id, cluster_id, round(CAST(p AS DOUBLE), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY p DESC, seq, cluster_id) AS rank FROM scored) WHERE rank <= 5""",
        ),
        "links_either_side": _with(
            f"{part_links},\n{_stored(100)}",
            """SELECT mention_id, count(*) AS links, round(CAST(max(p) AS DOUBLE), 6) AS best FROM (
  SELECT mention_id_l AS mention_id, match_probability AS p FROM stored_links
  UNION ALL SELECT mention_id_r, match_probability FROM stored_links) GROUP BY 1""",
        ),
        "clusters_for": _with(
            f"{part_clusters},\n{_stored(100)}",
            "SELECT mention_id, cluster_id FROM clusters WHERE mention_id IN (SELECT mention_id_r FROM stored_links)",
        ),
        "cluster_lookup": _with(
            part_clusters,
            """SELECT a.mention_id, c.cluster_id, CASE WHEN c.cluster_id IS NULL THEN 'The mention was never resolved' END AS lookup_error
FROM (SELECT DISTINCT 'p' || conv_id * 25 AS mention_id FROM conversations) a LEFT JOIN clusters c USING (mention_id)""",
        ),
        "cluster_listing": _with(
            part_clusters, "SELECT c.cluster_id, m.mention_id, m.legal_name FROM clusters c JOIN mentions m USING (mention_id)"
        ),
        "conflict_guard": f"""WITH {SUBMISSIONS}
SELECT i.mention_id, i.turn FROM incoming i JOIN stored s USING (mention_id)
WHERE i.text IS DISTINCT FROM s.text OR i.role IS DISTINCT FROM s.role""",
        "idempotent_split": f"""WITH {SUBMISSIONS}
SELECT mention_id, turn, CASE WHEN mention_id IN (SELECT mention_id FROM stored) THEN 'stored' ELSE 'new' END AS state FROM incoming""",
        "in_batch_guard": _judged_turns("repeat"),
        "stream_guard": _judged_turns("seen"),
        "random_pair_levels": f"""WITH {PARTS},
sample AS (SELECT * FROM mentions ORDER BY mention_id LIMIT 200),
graded AS (SELECT {_levels(parts)} FROM sample l JOIN sample r ON l.mention_id < r.mention_id)
SELECT {_gammas(parts)}, count(*) AS pairs FROM graded GROUP BY ALL""",
        "em_train": _em_train(parts),
        "model_files": f"SELECT *, 'persisted' AS origin, CAST(NULL AS VARCHAR) AS problem FROM (\n{_em_train(parts)})",
        "corpus_growth": f"""WITH {PARTS},
grown AS (
  SELECT c AS cycle, country_code, seq + c * (SELECT max(seq) + 1 FROM mentions) AS seq, CASE WHEN c = 0 THEN legal_name ELSE
    translate(substr(md5(mention_id || '-' || c), 1, 8), '0123456789', 'ghijklmnop') || ' ' || legal_name END AS legal_name
  FROM mentions, (SELECT unnest([0, 1, 2]) AS c))
SELECT cycle, country_code, count(*) AS mentions, min(seq) AS first_seq, count(DISTINCT legal_name) AS names FROM grown GROUP BY 1, 2""",
        "request_errors": """SELECT c_custkey AS arrival_seq, CASE WHEN c_mktsegment <> 'FURNITURE' THEN CAST(c_custkey AS VARCHAR) END AS request_id,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'ValueError' ELSE 'ProcessingError' END AS error_type,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'No mapping is configured for entity type VEHICLE'
    WHEN 'HOUSEHOLD' THEN 'No mapping is configured for entity type PERSON' WHEN 'BUILDING' THEN 'The message has no type'
    WHEN 'MACHINERY' THEN 'Unsupported message type RebuildRequest'
    ELSE 'The message identifies no mention: it needs request_id, source_id and entity_type' END AS error_detail FROM customer""",
        "mention_files": """SELECT 's' || s_suppkey AS mention_id, s_suppkey AS arrival_seq, s_name AS legal_name, n_name AS country_code, r_name AS nuts_code
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "training_sample": f"""WITH {PARTS}
SELECT mention_id, seq AS arrival_seq, legal_name, country_code, nuts_code, post_code FROM mentions ORDER BY mention_id LIMIT 200""",
        "gamma_patterns": f"""WITH {PARTS},
sample AS (SELECT * FROM mentions ORDER BY mention_id LIMIT 200),
graded AS (
  SELECT {_levels(parts)} FROM sample l JOIN sample r ON l.country_code = r.country_code AND l.mention_id < r.mention_id)
SELECT {_gammas(parts)}, count(*) AS pairs FROM graded GROUP BY ALL""",
        "pairs_per_mention": _pages_variants(),
        "reference_pairs": f"""WITH {PARTS}
SELECT 'exact' AS reference, count(*) AS pairs FROM mentions l JOIN mentions r ON {EXACT}
UNION ALL SELECT 'variant', count(*) FROM mentions l JOIN mentions r ON {_variant()}""",
        "blocking_recall": _blocking_recall(),
        "cluster_recall": _with(
            recalls, "SELECT *, round(together / NULLIF(reference_pairs, 0), 6) AS recall FROM recall"
        ),
        "unrelated_merges": _with(
            merged, "SELECT cluster_id, count(*) AS unrelated FROM together WHERE jaro_winkler_similarity(ln, rn) < 0.8 GROUP BY 1"
        ),
        "co_clustered_pairs": _with(
            part_clusters,
            """SELECT cluster_id, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs
FROM clusters GROUP BY 1 HAVING count(*) > 1""",
        ),
        "evaluate_variant": _with(
            f"{recalls},\n{merged.split(part_clusters + ',')[1]},\n{_stored(100)}",
            f"""SELECT 'mentions' AS measure, count(*) AS value FROM mentions
UNION ALL SELECT 'joins', count(*) FROM clusters WHERE cluster_id <> mention_id
UNION ALL SELECT 'stored_links', count(*) FROM stored_links
UNION ALL SELECT 'admitted_pairs', count(*) FROM graded
UNION ALL SELECT 'merged_pairs', count(*) FROM together
UNION ALL SELECT 'unrelated_pairs', count(*) FROM together WHERE jaro_winkler_similarity(ln, rn) < 0.8
UNION ALL SELECT reference || '_pairs', reference_pairs FROM recall
UNION ALL SELECT reference || '_together', together FROM recall""",
        ),
        "request_render": f"""WITH {PAGES},
bodies AS (SELECT mention_id, seq, {_page_content()} AS content FROM mentions)
SELECT mention_id AS request_id, seq AS arrival_seq, CAST(to_json({{'type': '{requests.REQUEST_TYPE}', 'entity_mention': {{
  'identifiedBy': {{'request_id': mention_id, 'source_id': '{catalog.SOURCE_ID}', 'entity_type': 'ORGANISATION'}},
  'content': content, 'content_type': '{requests.CONTENT_TYPE}'}}, 'timestamp': '2024-01-01T00:00:00Z',
  'ere_request_id': mention_id || ':01'}}) AS VARCHAR) AS raw FROM bodies""",
        "request_parse": f"""WITH {PAGES}
SELECT seq AS arrival_seq, mention_id AS request_id, '{catalog.SOURCE_ID}' AS source_id, 'ORGANISATION' AS entity_type,
  mention_id || ':01' AS ere_request_id, sha256({_page_content()}) AS content_hash FROM mentions""",
        "rdf_prefix_resolve": f"""SELECT c_custkey, CASE c_mktsegment
  {" ".join(f"WHEN '{segment}' THEN '{rdf.NAMESPACES[prefix]}'" for segment, prefix in catalog.SEGMENT_PREFIXES.items() if prefix in rdf.NAMESPACES)}
  END || c_name AS iri FROM customer""",
        "rdf_property_path": f"""WITH {PAGES}
SELECT seq AS request_key, country_code, coalesce(legal_name, '') AS legal_name, nuts_code, post_code, post_name,
  NULL::VARCHAR AS thoroughfare, NULL::VARCHAR AS mapping_error FROM mentions""",
        "rdf_ntriples": f"""WITH told AS (
  SELECT doc_id, 2 AS line, 'urn:doc:' || doc_id AS s, '{rdf.NAMESPACES["epo"]}hasLegalName' AS p, text AS o, 'literal' AS o_kind,
    length(text) >= 200 AS good FROM documents
  UNION ALL SELECT doc_id, 3, 'urn:doc:' || doc_id, 'urn:lang', lang, 'literal', true FROM documents
  UNION ALL SELECT doc_id, 4, '_:b' || doc_id, 'urn:source', 'urn:' || source, 'iri', true FROM documents
)
SELECT doc_id AS request_key, line, CASE WHEN good THEN s END AS s, CASE WHEN good THEN p END AS p,
  CASE WHEN good THEN md5(o) END AS o_md5, CASE WHEN good THEN o_kind END AS o_kind,
  CASE WHEN NOT good THEN 'Line ' || line || ' is not valid N-Triples' END AS error
FROM told WHERE o IS NOT NULL""",
        "process_requests": _with(
            f"{supplier_clusters},\n{_candidates(100)},\n{_stored(100)},\n{REQUERY_COUNTS},\n{MESSAGES}",
            f"""SELECT m.arrival_seq, coalesce(m.request_id || ':01', 'unknown') AS ere_request_id,
  CASE WHEN guard IN ('new', 'repeat') THEN '{requests.RESPONSE_TYPE}' ELSE '{requests.ERROR_TYPE}' END AS type,
  CASE guard WHEN 'conflict' THEN 'ConflictError' WHEN 'broken' THEN 'ProcessingError' WHEN 'odd' THEN 'ValueError' END AS error_type,
  CASE guard WHEN 'new' THEN f.n WHEN 'repeat' THEN l.n END AS candidates,
  CASE guard WHEN 'new' THEN f.top_cluster WHEN 'repeat' THEN l.top_cluster END AS top_cluster,
  CASE guard WHEN 'new' THEN f.top_score WHEN 'repeat' THEN l.top_score END AS top_score,
  CASE guard WHEN 'new' THEN f.order_digest WHEN 'repeat' THEN l.order_digest END AS order_digest
FROM messages m LEFT JOIN firsts f USING (mention_id) LEFT JOIN later l USING (mention_id)""",
        ),
        "stream_replay": _with(
            f"{supplier_clusters},\n{_candidates(100)},\n{_stored(100)},\n{REQUERY_COUNTS},\n{MESSAGES}",
            f"""SELECT m.arrival_seq, coalesce(m.request_id || ':01', 'unknown') AS ere_request_id,
  CASE WHEN guard IN ('new', 'repeat') THEN '{requests.RESPONSE_TYPE}' ELSE '{requests.ERROR_TYPE}' END AS type,
  CASE guard WHEN 'conflict' THEN 'ConflictError' WHEN 'broken' THEN 'ProcessingError' WHEN 'odd' THEN 'ValueError' END AS error_type,
  CASE guard WHEN 'new' THEN f.n END AS candidates, CASE guard WHEN 'new' THEN f.top_cluster END AS top_cluster,
  CASE guard WHEN 'new' THEN f.top_score END AS top_score, CASE guard WHEN 'new' THEN f.order_digest END AS order_digest,
  CASE guard WHEN 'new' THEN c.cluster_id END AS cluster_id
FROM messages m LEFT JOIN firsts f USING (mention_id) LEFT JOIN clusters c USING (mention_id)""",
        ),
        "lifecycle_events": _with(
            f"{supplier_clusters},\n{_stored(100)},\n{MESSAGES},\n"
            f"""tops AS (SELECT ml, max({PROBABILITY}) AS p FROM links GROUP BY 1)""",
            """SELECT event, guard, decision, count(*) AS events, CAST(sum(n) AS BIGINT) AS stored_links, round(max(p), 6) AS best_score FROM (
  SELECT 'dequeued' AS event, NULL AS guard, NULL AS decision, NULL AS n, NULL::DOUBLE AS p FROM messages
  UNION ALL SELECT 'responded', NULL, NULL, NULL, NULL FROM messages
  UNION ALL SELECT 'parsed', NULL, NULL, NULL, NULL FROM messages WHERE guard NOT IN ('broken', 'odd')
  UNION ALL SELECT 'guard', guard, NULL, NULL, NULL FROM messages WHERE guard NOT IN ('broken', 'odd')
  UNION ALL SELECT 'persisted', NULL, NULL, NULL, NULL FROM clusters
  UNION ALL SELECT 'clustered', NULL, CASE WHEN cluster_id = mention_id THEN 'new' ELSE 'join' END, NULL, NULL FROM clusters
  UNION ALL SELECT 'scored', NULL, NULL, (SELECT count(*) FROM stored_links s WHERE s.mention_id_l = c.mention_id), t.p
    FROM clusters c LEFT JOIN tops t ON t.ml = c.mention_id) GROUP BY ALL""",
        ),
        "latency_summary": """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT count(*) AS records, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(coalesce(stddev_samp(value), 0), 6) AS stdev_ms, max(CASE WHEN i = n // 2 THEN value END) AS median_ms,
  max(CASE WHEN i = CAST(floor(0.95::DOUBLE * n) AS BIGINT) THEN value END) AS p95_ms,
  max(CASE WHEN i = CAST(floor(0.99::DOUBLE * n) AS BIGINT) THEN value END) AS p99_ms FROM v""",
        "report_files": """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT count(*) AS records, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(coalesce(stddev_samp(value), 0), 6) AS stdev_ms, max(CASE WHEN i = n // 2 THEN value END) AS median_ms,
  max(CASE WHEN i = CAST(floor(0.95::DOUBLE * n) AS BIGINT) THEN value END) AS p95_ms,
  max(CASE WHEN i = CAST(floor(0.99::DOUBLE * n) AS BIGINT) THEN value END) AS p99_ms,
  (SELECT count(event_id) FROM events) AS read_records, (SELECT count(DISTINCT event_type) FROM events) AS read_types,
  (SELECT max(value) FROM events) AS read_max_ms FROM v""",
        "growth_profile": f"""WITH v AS (
  SELECT *, CAST(floor(event_id / {catalog.WINDOW}) AS BIGINT) AS window_no FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY value) AS i, count(*) OVER (PARTITION BY window_no) AS n FROM v)
SELECT window_no AS "window", count(*) AS records, round(avg(value), 6) AS mean_ms,
  max(CASE WHEN i = greatest(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), 1) THEN value END) AS p95_ms,
  count(*) FILTER (WHERE event_type = 'click') AS clicks FROM r GROUP BY window_no""",
        "batch_summary": f"""SELECT user_id AS batch_id, count(*) AS batch_size, CAST(sum(octet_length(encode(props))) AS BIGINT) AS payload_bytes,
  round(sum(value), 4) AS total_ms, {stages} FROM events GROUP BY 1""",
    }
