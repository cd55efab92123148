"""Queries over profiles, drafts, adoption and risk controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import q_scan as S
from fixtures.q_scan import sql_rows
from fixtures.registry import joined, query
from fleetlens import values as V
from fleetlens.control_table import packaged_controls
from fleetlens.operators import code_scan as code, discovery, drafts as D, line_scan, profiles as P, risk
from fleetlens.sources.sinks import draft_listing

# --- profiles ---------------------------------------------------------------------------


@query(
    "profile_catalog_columns",
    """SELECT backend, table_name AS name, concat('postgres://', backend, '/', table_name) AS source_file, 'postgres' AS orm,
  string_agg(concat(column_name, ':', data_type, CASE WHEN coalesce(character_maximum_length, 0) <> 0 THEN concat('(', character_maximum_length, ')')
    WHEN coalesce(numeric_precision, 0) <> 0 THEN concat('(', numeric_precision, ')') ELSE '' END, '|nullable=', is_nullable), ',' ORDER BY ordinal_position) AS fields, 'high' AS confidence
FROM catalog_columns WHERE table_schema = 'public' AND table_type = 'BASE TABLE' GROUP BY 1, 2""",
)
def _(t):
    text = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"], F.lit("|"), f["note"])), ",")
    return P.profile_catalog_columns(t.catalog_columns).withColumn("fields", text)


@query(
    "profile_json_documents",
    """SELECT x.collection, x.field, array_to_string(list_sort(list(DISTINCT x.type)), '|') AS type, 'medium' AS confidence, concat('Inferred from ', any_value(x.n), ' sampled documents') AS note
FROM (SELECT s.collection, s.n, v.field, CASE WHEN v.field = 'value' THEN CASE seq % 4 WHEN 0 THEN 'float' WHEN 1 THEN 'int' WHEN 2 THEN 'NoneType' ELSE 'str' END ELSE v.type END AS type, v.nested, s.seq
  FROM (SELECT *, count(*) OVER (PARTITION BY collection) AS n FROM json_documents WHERE NOT starts_with(collection, 'system.')) s
  CROSS JOIN (VALUES ('id', 'int', FALSE), ('kind', 'str', FALSE), ('value', '', FALSE), ('ok', 'bool', FALSE), ('tags', 'list', FALSE), ('props', 'dict', FALSE), ('props.k', 'int', FALSE),
    ('nested', 'dict', TRUE), ('nested.deep', 'dict', TRUE), ('nested.deep.x', 'int', TRUE)) v(field, type, nested)) x
WHERE NOT nested OR seq % 5 = 0 GROUP BY 1, 2""",
)
def _(t):
    return P.profile_json_documents(t.json_documents)


@query(
    "profile_key_patterns",
    """WITH sampled AS (SELECT backend, array_to_string(list_transform(string_split(key, ':'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+|[0-9a-fA-F-]{36}|[0-9a-fA-F]{24}') THEN '*' ELSE p END), ':') AS name
  FROM cache_keys),
counted AS (SELECT backend, name, count(*) AS n FROM sampled GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY backend ORDER BY n DESC, name) AS INTEGER) AS rank FROM counted)
SELECT backend, rank, name, concat('redis://', backend) AS source_file, 'redis' AS orm, n, concat('Sampled ', n, ' keys matching this pattern') AS note, 'medium' AS confidence FROM ranked""",
)
def _(t):
    return P.profile_key_patterns(t.cache_keys)


@query(
    "profile_topics",
    """SELECT backend, topic, 0 AS part, 0 AS pos, 'partitions' AS field, concat('int(', partitions, ')') AS type, NULL AS note FROM topics WHERE NOT starts_with(topic, '__')
UNION ALL SELECT s.backend, t.topic, CASE WHEN ends_with(s.subject, '-value') THEN 1 ELSE 2 END, v.pos, CASE WHEN v.pos = 0 THEN json_extract_string(s.schema, '$.fields[0].name') ELSE v.field END, v.type,
  concat('From schema registry (', regexp_extract(s.subject, '-(value|key)$'), ')')
FROM (SELECT * FROM topic_schemas WHERE json_valid(schema) AND contains(schema, '"record"')) s JOIN topics t ON t.backend = s.backend AND t.topic = regexp_replace(s.subject, '-(value|key)$', '') AND NOT starts_with(t.topic, '__')
CROSS JOIN (VALUES (0, 'id', 'long'), (1, 'opt', 'null|string'), (2, 'list', 'array'), (3, 'odd', 'complex'), (4, 'bare', 'unknown')) v(pos, field, type)""",
)
def _(t):
    return P.profile_topics(t.topics, t.topic_schemas)


# --- drafts --------------------------------------------------------------------------------

_LANG_RANK = "list_position(['.py', '.ts', '.js', '.rb', '.go', '.java', '.prisma'], regexp_extract(source_file, '[.][a-z]+$'))"


def _models(t):
    return code.models(t.code_corpus)


def _routes(t):
    return code.routes(t.code_corpus)


def _components(t):
    return code.components(t.code_corpus)


def _found(t, *kinds: str):
    """Facts of some kinds for queries that use them several times: one pass over the texts, written once."""
    return discovery.discover(t.code_corpus, staged=True, kinds=kinds)


def _conf(cols: str = "confidence") -> str:
    return f"TRUE AS _draft, {cols} AS _confidence"


@query(
    "draft_schemas",
    f"""SELECT project, concat(orm, '_', lower(name), '_draft') AS artifact, name AS model_name, source_file, line, orm, {_conf()},
  CASE WHEN fields = '' THEN '' ELSE regexp_replace(concat(fields, ','), ',', ':high,', 'g') END AS fields FROM ({S.MODELS_SQL}) m""",
)
def _(t):
    text = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"], F.lit(":"), f["_confidence"], F.lit(","))), "")
    return D.draft_schemas(_models(t)).withColumn("fields", text)


# where a model of a file comes in the order of discovery
_MODEL_STEP = "CASE orm WHEN 'typeorm' THEN 0 WHEN 'sequelize' THEN CASE confidence WHEN 'high' THEN 1 ELSE 2 END WHEN 'mongoose' THEN 3 WHEN 'drizzle' THEN 4 WHEN 'sequel' THEN 1 ELSE 0 END"


@query(
    "draft_backends",
    f"""SELECT project, concat(orm, '_backend') AS id, CASE orm {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ORM_BACKEND.items())} ELSE 'unknown' END AS type,
  concat('Backend detected from ', orm, ' model definitions') AS description, TRUE AS _draft, first(confidence ORDER BY {_LANG_RANK}, source_file, {_MODEL_STEP}, line) AS _confidence, concat('Detected ', count(*), ' ', orm, ' models') AS _note
FROM ({S.MODELS_SQL}) m GROUP BY project, orm""",
)
def _(t):
    return D.draft_backends(_models(t))


@query(
    "draft_connection_hints",
    f"""SELECT project, name AS env_var, backend_hint, path AS source_file, line, {_conf()} FROM ({S.ENV_VARS_SQL}) e""",
)
def _(t):
    return D.draft_connection_hints(line_scan.env_vars(t.code_corpus))


_SNAKE = "regexp_replace(lower(CASE WHEN regexp_matches(name, '^[A-Z]') THEN substr(regexp_replace(name, '([A-Z])', '_\\1', 'g'), 2) ELSE regexp_replace(name, '([A-Z])', '_\\1', 'g') END), '[^a-z0-9_]', '_', 'g')"


@query(
    "draft_contracts",
    f"""SELECT project, {_SNAKE} AS component_id, name, type, source_file, public_methods AS interface, 'low' AS access, 'low' AS authority, dependencies, {_conf()} FROM ({S.COMPONENTS_SQL}) c""",
)
def _(t):
    return D.draft_contracts(_components(t)).select(
        "project", "component_id", "name", "type", "source_file", F.array_join(F.transform("interface", lambda m: m["method"]), ",").alias("interface"),
        F.col("data_access._confidence").alias("access"), F.col("authority._confidence").alias("authority"), joined("dependencies"), "_draft", "_confidence",
    )


def _node(col: str) -> str:
    stem = f"regexp_replace(regexp_extract({col}, '[^/]*$'), '[.][^.]*$', '')"
    return f"regexp_replace(lower(regexp_replace({stem}, '({'|'.join(V.NODE_SUFFIXES)})$', '')), '[^a-z0-9_]', '_', 'g')"


_ROUTE_STEP = "CASE framework WHEN 'gin' THEN 1 ELSE 0 END"
_ROUTE_NODES = f"""SELECT project, name, first(struct_pack(framework, source_file, n, listed) ORDER BY lang_rank, source_file, step, line) AS b FROM (
  SELECT project, framework, source_file, {_node('source_file')} AS name, {_LANG_RANK} AS lang_rank, min({_ROUTE_STEP}) AS step, min(line) AS line, count(*) AS n,
    string_agg(concat(method, ' ', route), ',' ORDER BY line) AS listed FROM ({S.ROUTES_SQL}) r GROUP BY project, framework, source_file) g GROUP BY 1, 2"""
# class lists come before other lists of a file
_COMPONENT_STEP = "CASE note WHEN 'CommonJS module.exports detected' THEN 1 ELSE 0 END"
_COMPONENT_NODES = f"""SELECT * FROM (SELECT project, lower(name) AS node, type, source_file, confidence, dependencies, {_LANG_RANK} AS lang_rank, {_COMPONENT_STEP} AS step, line,
  row_number() OVER (PARTITION BY project, lower(name) ORDER BY {_LANG_RANK}, source_file, {_COMPONENT_STEP}, line) AS rn FROM ({S.COMPONENTS_SQL}) c) x
  WHERE rn = 1 AND (project, node) NOT IN (SELECT (project, name) FROM rn)"""


@query(
    "draft_topology_nodes",
    f"""WITH rn AS ({_ROUTE_NODES}), cn AS ({_COMPONENT_NODES})
SELECT project, 0 AS phase, name, 'service' AS type, 'http' AS protocol, b.framework AS framework, b.source_file AS source_file, TRUE AS _draft, 'high' AS _confidence,
  concat('Detected ', b.n, ' ', b.framework, ' routes') AS _note, b.listed AS routes FROM rn
UNION ALL SELECT project, 1, node, type, NULL, NULL, source_file, TRUE, confidence, NULL, '' FROM cn""",
)
def _(t):
    text = F.array_join(F.transform("routes", lambda r: F.concat(r["method"], F.lit(" "), r["path"])), ",")
    found = _found(t, "routes", "components")
    return D.draft_topology_nodes(found["routes"], found["components"]).withColumn("routes", text)


@query(
    "draft_topology_edges",
    f"""WITH rn AS ({_ROUTE_NODES}), cn AS ({_COMPONENT_NODES}),
w AS (SELECT project, node, lang_rank, source_file, step, line, unnest(string_split(lower(dependencies), ',')) AS dep, generate_subscripts(string_split(dependencies, ','), 1) - 1 AS pos FROM cn WHERE dependencies <> '')
SELECT w.project, w.node AS "from", w.dep AS "to", CAST(w.pos AS INTEGER) AS pos, TRUE AS _draft, 'medium' AS _confidence, 'Inferred from constructor parameter' AS _note FROM w
WHERE EXISTS (SELECT 1 FROM rn WHERE rn.project = w.project AND rn.name = w.dep)
  OR EXISTS (SELECT 1 FROM cn WHERE cn.project = w.project AND cn.node = w.dep AND (cn.lang_rank, cn.source_file, cn.step, cn.line) <= (w.lang_rank, w.source_file, w.step, w.line))""",
)
def _(t):
    found = _found(t, "routes", "components")
    return D.draft_topology_edges(found["routes"], found["components"])


@query(
    "draft_component_map",
    f"""SELECT project, replace(lower(name), ' ', '_') AS name, type, source_file, dependencies, {_conf()} FROM ({S.COMPONENTS_SQL}) c""",
)
def _(t):
    return D.draft_component_map(_components(t)).withColumn("dependencies", F.array_join("dependencies", ","))


_TIERS = f"(SELECT project, list_sort(list(DISTINCT classification_hint)) AS tiers FROM ({S.SENSITIVE_SQL}) s GROUP BY 1) t"


@query(
    "draft_constraints",
    f"""SELECT project, 'C001' AS id, 'Sensitive data handling' AS boundary, concat('Fields classified as ', array_to_string(tiers, ', '), ' must be protected') AS condition,
  'Unprotected access to classified fields' AS violation, 'must' AS severity, {_conf("'low'")}, 'Inferred from field name patterns — human must confirm classifications' AS _note FROM {_TIERS}""",
)
def _(t):
    return D.draft_constraints(line_scan.scan_sensitive_fields(t.code_corpus))


@query(
    "draft_trust_policy",
    f"""SELECT p.project, 0.15::DOUBLE AS floor, coalesce(array_to_string(t.tiers, ','), 'PUBLIC') AS classifications, {_conf("'low'")} FROM projects p LEFT JOIN {_TIERS} ON t.project = p.project""",
)
def _(t):
    return D.draft_trust_policy(t.projects, line_scan.scan_sensitive_fields(t.code_corpus)).withColumn(
        "classifications", F.array_join("classifications", ",")
    )


@query(
    "draft_schema_hints",
    f"""WITH {S._TOKENS}, terms AS (SELECT t.term AS lookup, t.tier FROM ({sql_rows(S._TERM_ROWS)}) t(tier, tier_ord, pos, term)),
hits AS (SELECT project, path, line, min(pos) AS pos, arg_min(tok, pos) AS field_name, any_value(terms.lookup) AS lookup, any_value(terms.tier) AS tier
  FROM tok JOIN terms ON lower(tok.tok) = terms.lookup WHERE regexp_full_match(tok.tok, '[A-Za-z_][A-Za-z0-9_]*') GROUP BY project, path, line, terms.lookup)
SELECT project, 'storage_backend' AS hint, name AS subject, backend_hint AS value, {_conf()}, NULL AS _note FROM ({S.ENV_VARS_SQL}) e
UNION ALL SELECT project, 'field', field_name, tier, TRUE, 'low', concat('Matched pattern: ', lookup) FROM hits""",
)
def _(t):
    return D.draft_schema_hints(line_scan.env_vars(t.code_corpus), line_scan.scan_sensitive_fields(t.code_corpus))


def _first_sql(kind: str, text: str, sql: str, step: str) -> str:
    return f"""SELECT project, '{kind}' AS section, CAST(place AS INTEGER) AS place, {text} AS text FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_LANG_RANK}, source_file, {step}, line) AS place FROM ({sql}) s) x"""


_AT = "concat(source_file, ':', line)"
# two routes or models may stand on one line: the pattern order decides, then the position
_OVERVIEW = " UNION ALL ".join(
    [
        _first_sql("components", f"concat('**', name, '** (', type, ') — ', {_AT})", S.COMPONENTS_SQL, _COMPONENT_STEP),
        _first_sql("routes", f"concat('`', method, ' ', route, '` — ', framework, ' (', {_AT}, ')')", S.ROUTES_SQL, _ROUTE_STEP),
        _first_sql("models", f"concat('**', name, '** (', orm, ') — ', {_AT})", S.MODELS_SQL, _MODEL_STEP + ", CASE WHEN name LIKE 'Doc%' THEN 0 ELSE 1 END"),
    ]
    + [f"SELECT project, 'total_{k}', 0, CAST(count(*) AS VARCHAR) FROM ({q}) s GROUP BY 1" for k, q in
       [("components", S.COMPONENTS_SQL), ("models", S.MODELS_SQL), ("routes", S.ROUTES_SQL), ("pact_keys", S.KEYS_SQL)]]
)


@query("draft_overview", _OVERVIEW)
def _(t):
    return D.draft_overview(_found(t, "components", "models", "routes", "pact_keys"))


@query(
    "draft_manifest",
    f"""SELECT project, key AS pact_key, split_part(key, ':', 2) AS component_id, split_part(key, ':', 3) AS method_id, path AS source_file, line, CAST(NULL AS VARCHAR) AS contract_path, CAST(NULL AS VARCHAR) AS test_path, {_conf()} FROM ({S.KEYS_SQL}) k""",
)
def _(t):
    return D.draft_manifest(line_scan.scan_pact_keys(t.code_corpus))


_OWNER = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'unknown' END"
_ADOPT = f"""SELECT project, {_OWNER} AS tool, path, coalesce(json_extract_string(body, '$._confidence'), 'low') AS confidence,
  CASE WHEN coalesce(json_extract_string(body, '$._confidence'), 'low') NOT IN ('high', 'medium') THEN 'SKIP confidence' WHEN contains(body, '"classification"') THEN 'SKIP classification' ELSE 'WOULD ADOPT' END AS decision
FROM draft_files WHERE json_extract_string(body, '$._draft') = 'true'"""


@query("adopt_candidates", _ADOPT)
def _(t):
    return D.adopt_candidates(t.draft_files, floor="medium")


@query(
    "adopt_summary",
    f"SELECT project, count(*) FILTER (WHERE decision = 'WOULD ADOPT') AS adopted, count(*) FILTER (WHERE decision <> 'WOULD ADOPT') AS skipped FROM ({_ADOPT}) a GROUP BY 1",
)
def _(t):
    return D.adopt_summary(D.adopt_candidates(t.draft_files, floor="medium"))


@query("drafts_by_tool", f"SELECT project, {_OWNER} AS tool, path FROM draft_files")
def _(t):
    return draft_listing(t.draft_files)


# --- risk ------------------------------------------------------------------------------------

_STOP = S.sql_list(V.RISK_STOP_WORDS)
_ABSENT = " OR ".join(f"contains(lower(description), '{p}')" for p in V.RISK_ABSENCE_PHRASES)
_BASE = f"""concat(upper(framework), '-', coalesce(nullif(array_to_string(list_filter(regexp_extract_all(upper(replace(description, 'ß', 'SS')), '[A-Z0-9]+'), lambda w: NOT list_contains([{_STOP}], w))[1:4], '-'), ''), 'NEW-RISK'))"""
RISK_SQL = f"""SELECT risk_id, framework, {_BASE} AS base_id, substr(description, 1, 96) AS title, description, 'Project Risk' AS family, 'Project-defined' AS framework_ref, 'must' AS severity, 'source_grep' AS method,
  CASE WHEN {_ABSENT} THEN 'none_of' ELSE 'any_of' END AS mode,
  coalesce(list_reduce(regexp_extract_all(description, '[A-Za-z0-9_]+'), lambda a, w: CASE WHEN length(w) > length(a) THEN w ELSE a END, ''), '') AS pattern,
  CASE WHEN {_ABSENT} THEN 'source_pattern_absent' ELSE 'source_pattern_present' END AS assertion FROM risk_texts"""
RISK_SQL = f"SELECT * REPLACE (CASE WHEN pattern = '' THEN regexp_replace(title, '([.])', '\\\\\\1', 'g') ELSE pattern END AS pattern) FROM ({RISK_SQL}) r"


@query("risk_controls", RISK_SQL)
def _(t):
    return risk.risk_controls(t.risk_texts)


_IDS = [c["id"] for c in packaged_controls()]
# ids that are taken: the packaged ones and every eleventh drafted base, some with a suffix
_TAKEN = f"""SELECT id FROM ({sql_rows((i,) for i in _IDS)}) v(id) UNION SELECT DISTINCT CASE WHEN length(base_id) % 4 = 0 THEN concat(base_id, '-2') WHEN length(base_id) % 4 = 1 THEN base_id ELSE concat(base_id, '-3') END FROM b"""


@query(
    "risk_id_collision",
    f"""WITH b AS (SELECT risk_id, {_BASE} AS base_id FROM risk_texts), taken AS ({_TAKEN}),
numbered AS (SELECT risk_id, base_id, row_number() OVER (PARTITION BY base_id ORDER BY risk_id) AS k FROM b),
used AS (SELECT n.base_id, CASE WHEN t.id = n.base_id THEN 1 ELSE CAST(substr(t.id, length(n.base_id) + 2) AS BIGINT) END AS n
  FROM (SELECT DISTINCT base_id FROM b) n JOIN taken t ON t.id = n.base_id OR (starts_with(t.id, concat(n.base_id, '-')) AND regexp_full_match(substr(t.id, length(n.base_id) + 2), '[1-9][0-9]*'))),
sizes AS (SELECT base_id, max(k) AS m FROM numbered GROUP BY 1),
free AS (SELECT base_id, f, row_number() OVER (PARTITION BY base_id ORDER BY f) AS k FROM (SELECT s.base_id, unnest(range(1, s.m + (SELECT count(*) FROM used u WHERE u.base_id = s.base_id) + 1)) AS f FROM sizes s) r
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.base_id = r.base_id AND u.n = r.f))
SELECT n.risk_id, n.base_id, CASE WHEN f.f = 1 THEN n.base_id ELSE concat(n.base_id, '-', f.f) END AS id FROM numbered n JOIN free f ON f.base_id = n.base_id AND f.k = n.k""",
)
def _(t):
    drafted = risk.risk_controls(t.risk_texts)
    n = F.length("base_id") % 4
    ours = drafted.select(
        F.when(n == 0, F.concat("base_id", F.lit("-2"))).when(n == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("-3"))).alias("id")
    )
    packaged = t.spark.createDataFrame([(i,) for i in _IDS], "id string")
    return risk.risk_id_collision(drafted, packaged.unionByName(ours).distinct())
