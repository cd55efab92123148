"""Queries over registries, contracts, topologies, manifests: the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.registry import query
from fleetlens import values as V
from fleetlens.operators import checks as K
from fleetlens.sources import documents as D
from fleetlens.sources.corpus import source_files

SHOWN = ["project", "tool", "check_id", "target", "severity", "status", "message"]

# the source files the checks read
SOURCES_SQL = """SELECT * FROM code_corpus WHERE (starts_with(path, 'src/') OR starts_with(path, 'lib/') OR starts_with(path, 'app/'))
  AND NOT list_has_any(string_split(path, '/'), ['node_modules', '.venv', 'dist', 'build'])"""
PY_SQL = f"SELECT * FROM ({SOURCES_SQL}) s WHERE lang = 'python'"


def _check(tool: str, check_id: str, target: str, severity: str, status: str, message: str, source: str, where: str = "TRUE", o1: str = "''", o2: str = "0") -> str:
    """One check as SQL; o1 and o2 order rows of the same check id."""
    return f"""SELECT project, '{tool}' AS tool, {check_id} AS check_id, {target} AS target, {severity} AS severity, {status} AS status, {message} AS message,
  {o1} AS o1, CAST({o2} AS BIGINT) AS o2 FROM {source} WHERE {where}"""


SQL: dict[str, str] = {}

SQL["chk_contract_valid_yaml"] = _check("pact", "'contract_valid_yaml'", "path", "'FAIL'", "'FAIL'", "'Invalid YAML'", "contracts", "NOT parse_ok", "path")
_DA = "CASE WHEN NOT list_contains(keys, 'data_access') THEN {0} WHEN length(trim(rationale)) < 10 THEN {1} ELSE {2} END"
SQL["chk_contract_data_access"] = _check(
    "pact",
    _DA.format("'contract_has_data_access'", "'contract_data_access_rationale_not_vague'", "'contract_has_data_access'"),
    "path",
    _DA.format("'FAIL'", "'WARN'", "'FAIL'"),
    _DA.format("'FAIL'", "'WARN'", "'PASS'"),
    _DA.format("'missing data_access field'", "'data_access.rationale is vague'", "'data_access present'"),
    "contracts", "parse_ok", "path",
)
_AU = "CASE WHEN list_contains(keys, 'authority') THEN {0} ELSE {1} END"
SQL["chk_contract_authority"] = _check(
    "pact", "'contract_has_authority'", "path", "'FAIL'", _AU.format("'PASS'", "'FAIL'"),
    _AU.format("'authority present'", "'missing authority field'"), "contracts", "parse_ok", "path",
)
SQL["chk_source_has_pact_key"] = _check(
    "pact", "'source_has_pact_key'", "path", "'FAIL'", "'FAIL'", "'no PACT key found in any method'", f"({PY_SQL}) p",
    f"NOT regexp_matches(content, '{V.PACT_KEY_FORMAT}') AND (contains(content, 'class ') OR contains(content, 'def '))", "path",
)
SQL["chk_source_event_handler"] = _check(
    "pact", "'source_has_event_handler'", "path", "'FAIL'", "'FAIL'", "'no event_handler parameter'", f"({PY_SQL}) p",
    "contains(content, 'class ') AND NOT contains(content, 'event_handler')", "path",
)
SQL["chk_source_log_handler"] = _check(
    "pact", "'source_has_log_handler'", "path", "'WARN'", "'WARN'", "'event_handler present but log_handler missing'", f"({PY_SQL}) p",
    "contains(content, 'class ') AND contains(content, 'event_handler') AND NOT contains(content, 'log_handler')", "path",
)
SQL["chk_topology_exists_valid"] = (
    _check("baton", "'baton_yaml_exists'", "'baton.yaml'", "'INFO'", "'INFO'", "'no baton.yaml found'", "projects", "project NOT IN (SELECT project FROM topologies)")
    + " UNION ALL "
    + _check("baton", "'baton_yaml_valid'", "path", "'FAIL'", "'FAIL'", "'Invalid YAML'", "topologies", "NOT parse_ok")
)
_OLD = "CASE WHEN TRY_CAST(string_split(version, '.') AS INTEGER[]) IS NULL THEN version < '2.0' ELSE TRY_CAST(string_split(version, '.') AS INTEGER[]) < [2, 0] END"
SQL["chk_topology_version"] = _check(
    "baton", "'baton_yaml_version_current'", "path", "'FAIL'", f"CASE WHEN {_OLD} THEN 'FAIL' ELSE 'PASS' END",
    f"CASE WHEN {_OLD} THEN concat('version ', version, ', requires 2.0') ELSE concat('version ', version) END", "topologies", "parse_ok",
)


def _node(check_id: str, message: str, where: str) -> str:
    return _check("baton", f"'{check_id}'", "concat('node: ', name)", "'WARN'", "'WARN'", f"'{message}'", "topology_nodes", where, "''", "pos")


SQL["chk_node_data_access"] = _node("all_nodes_have_data_access", "data_access not declared", "NOT list_contains(keys, 'data_access')")
SQL["chk_node_authority"] = _node("all_nodes_have_authority_declared", "authority not declared", "NOT list_contains(keys, 'authority')")
SQL["chk_node_openapi"] = _node("openapi_spec_present_for_http_nodes", "no openapi_spec configured", "protocol = 'http' AND NOT list_contains(keys, 'openapi_spec')")
SQL["chk_global_sections"] = " UNION ALL ".join(
    _check("baton", f"'{cid}'", "path", f"'{level}'", f"'{level}'", f"'{message}'", "topologies", f"parse_ok AND NOT list_contains(global_keys, '{key}')")
    for key, cid, level, message in [
        ("arbiter", "arbiter_endpoint_configured", "INFO", "arbiter endpoint not configured"),
        ("ledger", "ledger_endpoint_configured", "INFO", "ledger endpoint not configured"),
        ("audit_channel", "audit_channel_port_configured", "WARN", "audit_channel not configured"),
    ]
)
_SCHEMAS = "(SELECT project, schema_path, sum(CASE WHEN is_dict AND NOT list_contains(keys, 'classification') THEN 1 ELSE 0 END)::BIGINT AS missing, count(*) AS n FROM registry_fields GROUP BY 1, 2) s"
_LEVEL = "CASE WHEN missing > n // 2 THEN 'FAIL' ELSE 'WARN' END"
SQL["chk_fields_classified"] = _check(
    "ledger", "'all_fields_have_classification'", "schema_path", f"CASE WHEN missing = 0 THEN 'FAIL' ELSE {_LEVEL} END",
    f"CASE WHEN missing = 0 THEN 'PASS' ELSE {_LEVEL} END",
    "CASE WHEN missing = 0 THEN 'all fields have classification' ELSE concat(missing, ' fields missing classification') END", _SCHEMAS, "TRUE", "schema_path",
)


def _field(check_id: str, level: str, message: str, where: str) -> str:
    return _check("ledger", f"'{check_id}'", "concat(schema_path, ':', name)", f"'{level}'", f"'{level}'", f"'{message}'", "registry_fields", "is_dict AND " + where, "schema_path", "pos")


_HAS = "list_contains(annotations, '{0}')"
SQL["chk_annotation_conflict"] = _field("no_annotation_conflicts", "FAIL", "field is both gdpr_erasable and immutable", f"{_HAS.format('gdpr_erasable')} AND {_HAS.format('immutable')}")
SQL["chk_erasure_method"] = _field("gdpr_erasable_has_erasure_method", "WARN", "gdpr_erasable field has no erasure_method", f"{_HAS.format('gdpr_erasable')} AND NOT list_contains(keys, 'erasure_method')")
SQL["chk_audit_retention"] = _field("audit_fields_have_retention_policy", "WARN", "audit field has no retention_policy", f"{_HAS.format('audit_field')} AND NOT list_contains(keys, 'retention_policy')")
SQL["chk_registry_exists"] = (
    _check("ledger", "'ledger_registry_exists'", "'.ledger/registry/'", "'INFO'", "'INFO'", "'no ledger registry found'", "projects", "project NOT IN (SELECT project FROM artifacts WHERE kind = 'registry')")
    + " UNION ALL "
    + _check("arbiter", "'arbiter_registry_exists'", "'.arbiter/registry/'", "'INFO'", "'INFO'", "'no arbiter registry found'", "projects", "project NOT IN (SELECT project FROM artifacts WHERE kind = 'arbiter')")
)
_HOLDERS = "(SELECT DISTINCT project FROM artifacts WHERE kind = 'arbiter') h"


def _first(kind: str) -> str:
    return f"(SELECT project AS p, arg_min(path, location_rank) AS path, arg_min(body, location_rank) AS body FROM artifacts WHERE kind = '{kind}' GROUP BY 1) a"


SQL["chk_access_graph"] = _check(
    "arbiter", "CASE WHEN path IS NOT NULL AND NOT json_valid(body) THEN 'access_graph_valid' ELSE 'access_graph_exists' END", "coalesce(path, 'access_graph.json')", "'FAIL'",
    "CASE WHEN path IS NULL OR NOT json_valid(body) THEN 'FAIL' ELSE 'PASS' END",
    "CASE WHEN path IS NULL THEN 'not found — run pact build first' WHEN json_valid(body) THEN 'present and readable' ELSE 'Invalid JSON' END",
    f"{_HOLDERS} LEFT JOIN {_first('access_graph')} ON a.p = h.project",
)
SQL["chk_trust_ledger"] = _check(
    "arbiter", "CASE WHEN json_valid(body) THEN 'trust_ledger_readable' ELSE 'trust_ledger_valid' END", "path", "'FAIL'",
    "CASE WHEN json_valid(body) THEN 'PASS' ELSE 'FAIL' END", "CASE WHEN json_valid(body) THEN 'present and readable' ELSE 'Invalid JSON' END",
    f"{_HOLDERS} JOIN {_first('trust_ledger')} ON a.p = h.project",
)
SQL["chk_manifest_exists_valid"] = (
    _check("sentinel", "'sentinel_manifest_exists'", "'.sentinel/manifest.json'", "'INFO'", "'INFO'", "'no sentinel manifest found'", "projects", "project NOT IN (SELECT project FROM manifests)")
    + " UNION ALL "
    + _check("sentinel", "'sentinel_manifest_valid'", "path", "'FAIL'", "'FAIL'", "'Invalid JSON'", "manifests", "NOT parse_ok")
)


def _entry(what: str, where: str) -> str:
    return _check("sentinel", f"'all_manifest_entries_have_{what}'", "coalesce(pact_key, 'unknown')", "'FAIL'", "'FAIL'", f"'missing {what}'", "manifest_entries", where, "''", "pos")


SQL["chk_manifest_contract_path"] = _entry("contract_path", "contract_path IS NULL")
SQL["chk_manifest_test_path"] = _entry("test_path", "test_path IS NULL")
SQL["chk_manifest_source_path"] = _entry("source_path", "NOT list_has_any(keys, ['source_path', 'source_file'])")
SQL["chk_source_keys_in_manifest"] = _check(
    "sentinel", "'all_source_pact_keys_in_manifest'", "path", "'WARN'", "'WARN'", "concat(n, ' PACT keys in source not in manifest')",
    f"""(SELECT k.project, any_value(m.path) AS path, count(DISTINCT k.key) AS n FROM (SELECT project, unnest(regexp_extract_all(content, '{V.PACT_KEY_FORMAT}')) AS key FROM ({PY_SQL}) p) k
  JOIN manifests m ON m.project = k.project AND m.parse_ok
  WHERE NOT EXISTS (SELECT 1 FROM manifest_entries e WHERE e.project = k.project AND e.pact_key = k.key) GROUP BY 1) x""",
)
SQL["chk_integrations_configured"] = " UNION ALL ".join(
    _check(
        "sentinel", f"'{cid}'", f"'stack.{col}'", "'INFO'", f"CASE WHEN {col} IS NULL THEN 'INFO' ELSE 'PASS' END",
        f"CASE WHEN {col} IS NULL THEN '{label} not configured' ELSE '{label} configured' END", "project_config",
        "project IN (SELECT project FROM manifests WHERE parse_ok)",
    )
    for cid, col, label in [("pact_configured", "pact_project_dir", "Pact project"), ("arbiter_configured", "arbiter_registry", "Arbiter registry")]
)
ALL_CHECKS_SQL = " UNION ALL ".join(SQL.values())


def shown(sql: str) -> str:
    return f"SELECT {', '.join(SHOWN)} FROM ({sql}) c"


def check_tables(t) -> dict:
    return {
        "projects": t.projects,
        "contracts": t.contracts,
        "sources": source_files(t.code_corpus),
        "topologies": t.topologies,
        "topology_nodes": t.topology_nodes,
        "registry_fields": t.registry_fields,
        "artifacts": t.artifacts,
        "manifests": t.manifests,
        "manifest_entries": t.manifest_entries,
        "project_config": t.project_config,
    }


_INPUTS = {
    "chk_contract_valid_yaml": ["contracts"],
    "chk_contract_data_access": ["contracts"],
    "chk_contract_authority": ["contracts"],
    "chk_source_has_pact_key": ["sources"],
    "chk_source_event_handler": ["sources"],
    "chk_source_log_handler": ["sources"],
    "chk_topology_exists_valid": ["projects", "topologies"],
    "chk_topology_version": ["topologies"],
    "chk_node_data_access": ["topology_nodes"],
    "chk_node_authority": ["topology_nodes"],
    "chk_node_openapi": ["topology_nodes"],
    "chk_global_sections": ["topologies"],
    "chk_fields_classified": ["registry_fields"],
    "chk_annotation_conflict": ["registry_fields"],
    "chk_erasure_method": ["registry_fields"],
    "chk_audit_retention": ["registry_fields"],
    "chk_registry_exists": ["projects", "artifacts"],
    "chk_access_graph": ["artifacts"],
    "chk_trust_ledger": ["artifacts"],
    "chk_manifest_exists_valid": ["projects", "manifests"],
    "chk_manifest_contract_path": ["manifest_entries"],
    "chk_manifest_test_path": ["manifest_entries"],
    "chk_manifest_source_path": ["manifest_entries"],
    "chk_source_keys_in_manifest": ["sources", "manifests", "manifest_entries"],
    "chk_integrations_configured": ["project_config", "manifests"],
}


def _register(name: str) -> None:
    def build(t):
        args = [source_files(t.code_corpus) if i == "sources" else getattr(t, i) for i in _INPUTS[name]]
        return getattr(K, name)(*args).select(*SHOWN)

    query(name, shown(SQL[name]))(build)


for _name in _INPUTS:
    _register(_name)


@query(
    "chk_pact_key_format",
    shown(
        _check(
            "pact", "'pact_key_format_valid'", "path", "'FAIL'", "'FAIL'", "concat('malformed PACT key: ', key)",
            f"(SELECT project, path, unnest(regexp_extract_all(content, '(PACT:[a-z]+)[0-9]*:[a-z]+', 1)) AS key FROM ({PY_SQL}) p) k",
        )
    ),
)
def _(t):
    return K.chk_pact_key_format(source_files(t.code_corpus), r"(PACT:[a-z]+)[0-9]*:[a-z]+", 1).select(*SHOWN)


@query("run_checks", shown(ALL_CHECKS_SQL))
def _(t):
    return K.run_checks(check_tables(t)).select(*SHOWN)


# --- readers over YAML and JSON texts -----------------------------------------------


@query(
    "registry_read",
    """SELECT project, path AS schema_path, CAST(pos AS BIGINT) AS pos, name, classification, annotations, keys, is_dict FROM (
  SELECT project, path, lower(regexp_extract(content, 'name: ([a-zA-Z]+)\\n    class', 1)) AS n, content, unnest([0, 1, 2, 3, 4]) AS pos FROM registry_yaml WHERE content LIKE '%justtext%') x
  JOIN (VALUES (0, 'gdpr_erasable,encrypted_at_rest,immutable', 'annotations,classification,immutable,name', TRUE), (1, '', '', FALSE), (2, '', 'erasure_method,flag,name', TRUE), (3, '{name: no},audit_field', 'annotations,audit_field,gdpr_erasable,name', TRUE), (4, '', '', FALSE)) v(p, annotations, keys, is_dict) ON v.p = x.pos,
  LATERAL (SELECT CASE pos WHEN 0 THEN n WHEN 2 THEN 'acct' WHEN 3 THEN 'texts' END AS name, CASE pos WHEN 0 THEN 'PII' END AS classification) y
UNION ALL SELECT project, path, NULL, NULL, NULL, '', '', FALSE FROM registry_yaml WHERE content = 'fields: []'""",
)
def _(t):
    rows = D.registry_read(t.registry_yaml)
    return rows.withColumn("keys", F.array_join(F.array_sort("keys"), ",")).withColumn("annotations", F.array_join("annotations", ","))


@query(
    "contracts_read",
    """SELECT project, path, k <> 5 AS parse_ok, CASE k WHEN 0 THEN 'authority,data_access' WHEN 1 THEN 'id' WHEN 2 THEN 'data_access' WHEN 3 THEN 'data_access' WHEN 6 THEN 'data_access,extra' ELSE '' END AS keys,
  CASE k WHEN 0 THEN regexp_extract(content, 'reads .* orders') WHEN 3 THEN NULL ELSE '' END AS rationale
FROM (SELECT *, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % 7 AS k FROM contracts_yaml) c WHERE k <> 4""",
)
def _(t):
    return D.contracts_read(t.contracts_yaml).withColumn("keys", F.array_join(F.array_sort("keys"), ","))


_TOPOLOGY = "SELECT *, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS k FROM topology_yaml"


@query(
    "topology_read",
    f"""SELECT project, path AS item, CASE WHEN k % 9 = 8 THEN '1.0' ELSE concat(k % 3, '.0') END AS version, CASE WHEN k % 9 = 8 THEN '' ELSE 'arbiter' END AS keys FROM ({_TOPOLOGY}) t
UNION ALL SELECT project, concat('n', k), 'http', 'authority,name,protocol' FROM ({_TOPOLOGY}) t WHERE k % 9 <> 8
UNION ALL SELECT project, 'unknown', '', 'data_access' FROM ({_TOPOLOGY}) t WHERE k % 9 <> 8""",
)
def _(t):
    topologies, nodes = D.topology_read(t.topology_yaml)
    sort = lambda c: F.array_join(F.array_sort(c), ",").alias("keys")
    return topologies.select("project", F.col("path").alias("item"), "version", sort("global_keys")).unionByName(
        nodes.select("project", F.col("name").alias("item"), F.col("protocol").alias("version"), sort("keys"))
    )


@query(
    "manifest_read",
    """WITH m AS (SELECT project, path, content, json_valid(replace(content, 'NaN', '0')) AS ok FROM manifest_json)
SELECT project, path AS item, ok, '' AS keys, NULL AS test_path FROM m
UNION ALL SELECT project, regexp_extract(content, 'PACT:a:[0-9]+'), TRUE, 'contract_path,pact_key,source_file', NULL FROM m WHERE ok
UNION ALL SELECT project, 'unknown', FALSE, 'test_path', 't' FROM m WHERE ok""",
)
def _(t):
    manifests, entries = D.manifest_read(t.manifest_json)
    a = manifests.select("project", F.col("path").alias("item"), F.col("parse_ok").alias("ok"), F.lit("").alias("keys"), F.lit(None).cast("string").alias("test_path"))
    b = entries.select(
        "project", F.coalesce("pact_key", F.lit("unknown")).alias("item"), F.array_contains("keys", "source_file").alias("ok"),
        F.array_join(F.array_sort("keys"), ",").alias("keys"), "test_path",
    )
    return a.unionByName(b)


_INDEX_SQL = """SELECT project, lower(replace(key, ' ', '_')) AS evidence_key, arg_max(value, pos) AS path FROM (
  SELECT project, pos, trim(split_part(trim(text, '|'), '|', 1), ' `') AS key, trim(string_split(trim(text, '|'), '|')[-1], ' `') AS value, len(string_split(trim(text, '|'), '|')) AS n
  FROM evidence_index_lines WHERE contains(text, '|') AND NOT contains(text, '---')) c
WHERE n >= 2 AND key <> '' AND (contains(value, '/') OR value LIKE '%.md') GROUP BY 1, 2"""


@query("evidence_index_from_markdown", _INDEX_SQL)
def _(t):
    return D.evidence_index_from_markdown(t.evidence_index_lines)


@query(
    "evidence_stat",
    "SELECT i.project, i.evidence_key, i.path, f.mtime IS NOT NULL AS found, f.mtime FROM evidence_index i LEFT JOIN file_meta f ON f.project = i.project AND f.path = i.path",
)
def _(t):
    return D.evidence_stat(t.evidence_index, t.file_meta)
