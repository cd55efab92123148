"""Queries over compliance controls, reports, baselines and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import q_scan
from fixtures.q_checks import ALL_CHECKS_SQL, SHOWN, SOURCES_SQL, check_tables, shown
from fixtures.q_scan import EVIDENCE_OK, sql_rows, sq
from fixtures.registry import joined, query
from fleetlens import values as V
from fleetlens.control_table import packaged_controls
from fleetlens.operators import assertions as A, baseline as B, checks as K, controls as C, report as R
from fleetlens.session import stage
from fleetlens.sources.corpus import is_source_file, source_files

AS_OF = "2026-01-01 00:00:00"
CONTROLS = packaged_controls()
RESULT = "project, id, verdict, target, message, uncovered"


def _of(method: str) -> list[dict]:
    return [c for c in CONTROLS if c["detection"]["method"] == method]


def control_tables(t) -> dict:
    sources = source_files(t.code_corpus)
    return {
        "projects": t.projects,
        "corpus": t.code_corpus,
        "sources": sources,
        "registry_fields": t.registry_fields,
        "registries": t.artifacts.where("kind = 'registry'"),
        "project_config": t.project_config,
        "evidence_index": t.evidence_index,
        "file_meta": t.file_meta,
        "config_values": None,
    }


def _named(results, dets):
    names = F.create_map(*[F.lit(x) for d in dets for x in (d["ctl"], d["id"])])
    return results.select("project", names[F.col("ctl")].alias("id"), "verdict", "target", "message", joined("uncovered", "; "))


# --- reference SQL of the detectors --------------------------------------------------

_FEW = "coalesce(array_to_string((list(item ORDER BY {order}) FILTER (WHERE {bad}))[1:3], '; '), '')"

_ENC = _of("ledger_tier_encrypted")
ENCRYPTED_SQL = f"""SELECT p.project, c.id, CASE WHEN n IS NULL THEN 'skipped' WHEN m = 0 THEN 'present' WHEN m = n THEN 'missing' ELSE 'partial' END AS verdict, 'ledger' AS target,
  CASE WHEN n IS NULL THEN 'no matching Ledger fields' WHEN m = 0 THEN concat(n, ' Ledger field(s) encrypted at rest') ELSE concat(m, ' field(s) missing encrypted_at_rest') END AS message, coalesce(u, '') AS uncovered
FROM projects p CROSS JOIN ({sql_rows((c['id'], c['detection']['tier'].lower()) for c in _ENC)}) c(id, tier)
LEFT JOIN (SELECT project, lower(classification) AS tier, count(*) AS n, count(*) FILTER (WHERE NOT list_contains(annotations, 'encrypted_at_rest')) AS m,
  {_FEW.format(order='schema_path, pos', bad="NOT list_contains(annotations, 'encrypted_at_rest')")} AS u
  FROM (SELECT *, concat(schema_path, ':', name) AS item FROM registry_fields WHERE is_dict) f GROUP BY 1, 2) f ON f.project = p.project AND f.tier = c.tier"""
_BARE = "list_contains(annotations, 'gdpr_erasable') AND NOT list_contains(keys, 'erasure_method')"
OBLIGATION_SQL = f"""SELECT p.project, 'GDPR-ART17-ERASURE' AS id, CASE WHEN t IS NULL THEN 'skipped' WHEN n = 0 THEN 'missing' WHEN m = 0 THEN 'present' WHEN m = n THEN 'missing' ELSE 'partial' END AS verdict, 'ledger' AS target,
  CASE WHEN t IS NULL THEN 'no matching Ledger fields' WHEN n = 0 THEN 'no fields carry annotation gdpr_erasable' WHEN m = 0 THEN concat(n, ' Ledger field(s) satisfy gdpr_erasable') ELSE concat(m, ' field(s) missing erasure_method') END AS message, coalesce(u, '') AS uncovered
FROM projects p LEFT JOIN (SELECT project, count(*) AS t, count(*) FILTER (WHERE list_contains(annotations, 'gdpr_erasable')) AS n, count(*) FILTER (WHERE {_BARE}) AS m,
  {_FEW.format(order='schema_path, pos', bad=_BARE)} AS u FROM (SELECT *, concat(schema_path, ':', name) AS item FROM registry_fields WHERE is_dict AND lower(classification) = 'pii') f GROUP BY 1) f ON f.project = p.project"""


def _grep_files(c: dict) -> str:
    if c["detection"]["include_glob"] == "**/*":
        return "path LIKE '%/%'"
    return "(regexp_matches(path, '^(src|frontend|app|lib|infra|terraform)/') OR regexp_matches(path, '^services/.*/src/') OR path LIKE '%.tf')"


_GREP = _of("source_grep")


def _label(c: dict) -> str:
    glob = c["detection"]["include_glob"]
    return ",".join(glob) if isinstance(glob, list) else glob


def _pats(c: dict) -> list[str]:
    return c["detection"].get("any_of") or c["detection"]["none_of"]


def _grep_sql(controls: list[dict]) -> str:
    wide = [c for c in controls if isinstance(c["detection"]["include_glob"], str)]
    narrow = [c for c in controls if c not in wide]
    hits = " UNION ALL ".join(
        f"""SELECT f.project, f.path, v.id, v.pat, v.pattern FROM code_corpus f JOIN ({sql_rows((c['id'], i, p) for c in group for i, p in enumerate(_pats(c)))}) v(id, pat, pattern)
  ON regexp_matches(f.content, v.pattern) WHERE {EVIDENCE_OK} AND {_grep_files(group[0])}"""
        for group in (wide, narrow)
        if group
    )
    meta = sql_rows((c["id"], "any" if c["detection"].get("any_of") else "none", _label(c), str(_pats(c))) for c in controls)
    return f"""SELECT p.project, c.id, CASE WHEN (c.mode = 'any') = (h.path IS NOT NULL) THEN 'present' ELSE 'missing' END AS verdict,
  CASE WHEN c.mode = 'any' AND h.path IS NOT NULL THEN h.path ELSE c.label END AS target,
  CASE WHEN c.mode = 'any' AND h.path IS NOT NULL THEN concat('matched ', h.pattern) WHEN c.mode = 'any' THEN concat('none of ', c.pats, ' found')
    WHEN h.path IS NOT NULL THEN 'forbidden pattern(s) found' ELSE 'forbidden patterns absent' END AS message,
  CASE WHEN c.mode = 'none' THEN coalesce(h.u, '') ELSE '' END AS uncovered
FROM projects p CROSS JOIN ({meta}) c(id, mode, label, pats)
LEFT JOIN (SELECT project, id, first(path ORDER BY path, pat) AS path, first(pattern ORDER BY path, pat) AS pattern,
  array_to_string(list(concat(path, ':', pattern) ORDER BY path, pat)[1:3], '; ') AS u FROM ({hits}) x GROUP BY 1, 2) h ON h.project = p.project AND h.id = c.id"""


ANY_SQL = _grep_sql([c for c in _GREP if c["detection"].get("any_of")])
NONE_SQL = _grep_sql([c for c in _GREP if c["detection"].get("none_of")])

_GUARD = _of("route_guard")
_RANK = "CASE lang WHEN 'python' THEN 0 WHEN 'typescript' THEN 1 WHEN 'javascript' THEN 2 WHEN 'ruby' THEN 3 WHEN 'go' THEN 4 ELSE 5 END"


def _routes_sql(guards: str) -> str:
    """Routes of the source files with a flag for a guard near the line."""
    return f"""SELECT r.project, r.route, {_RANK} AS lang_rank, r.source_file, r.framework = 'gin' AS late, r.line, concat(r.method, ' ', r.route, ' (', r.source_file, ':', r.line, ')') AS item,
  EXISTS (SELECT 1 FROM lines l WHERE l.project = r.project AND l.path = r.source_file AND l.line BETWEEN r.line - 30 AND r.line + 30 AND regexp_matches(l.text, '{guards}')) AS guarded
FROM ({q_scan.ROUTES_SQL}) r JOIN ({SOURCES_SQL}) s ON s.project = r.project AND s.path = r.source_file"""


GUARD_SQL = f"""SELECT p.project, c.id, CASE WHEN n IS NULL THEN 'skipped' WHEN b = 0 THEN 'present' WHEN b = n THEN 'missing' ELSE 'partial' END AS verdict, 'routes' AS target,
  CASE WHEN n IS NULL THEN 'no routes discovered' WHEN b = 0 THEN concat(n, ' route(s) have guard evidence') ELSE concat(b, ' route(s) lack guard evidence') END AS message, coalesce(u, '') AS uncovered
FROM projects p CROSS JOIN ({sql_rows((c['id'],) for c in _GUARD)}) c(id)
LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (WHERE bad) AS b, {_FEW.format(order='lang_rank, source_file, late, line', bad='bad')} AS u
  FROM (SELECT r.*, NOT guarded AND NOT coalesce(len(list_filter(g.public_route_patterns, lambda x: regexp_matches(r.route, x))) > 0, FALSE) AS bad
    FROM ({_routes_sql('Depends|require_auth|require_role|authorize|user_claims|request.state.user_claims')}) r LEFT JOIN project_config g ON g.project = r.project) j GROUP BY 1) x ON x.project = p.project"""

_DOC = _of("evidence_doc")


def _evidence_sql(rows) -> str:
    return f"""SELECT p.project, c.id, CASE WHEN i.path IS NULL OR f.mtime IS NULL THEN 'missing' WHEN date_diff('day', f.mtime, TIMESTAMP '{AS_OF}') > c.age THEN 'partial' ELSE 'present' END AS verdict,
  coalesce(i.path, c.key) AS target, CASE WHEN i.path IS NULL THEN 'evidence path key missing from config' WHEN f.mtime IS NULL THEN 'evidence document missing'
    WHEN date_diff('day', f.mtime, TIMESTAMP '{AS_OF}') > c.age THEN concat('evidence document stale (', date_diff('day', f.mtime, TIMESTAMP '{AS_OF}'), 'd old)') ELSE 'evidence document present and fresh' END AS message, '' AS uncovered
FROM projects p CROSS JOIN ({sql_rows(rows)}) c(id, key, age)
LEFT JOIN evidence_index i ON i.project = p.project AND i.evidence_key = c.key LEFT JOIN file_meta f ON f.project = p.project AND f.path = i.path"""


EVIDENCE_SQL = _evidence_sql((c["id"], c["detection"]["evidence_path_key"], c["detection"]["max_age_days"]) for c in _DOC)


# --- detectors ---------------------------------------------------------------------------


def _detector(name: str, controls: list[dict], sql: str, run) -> None:
    def build(t):
        dets = C.number_detections(controls)
        return _named(run(t, dets), dets)

    query(name, f"SELECT {RESULT} FROM ({sql}) d")(build)


_detector("det_ledger_obligation", _of("ledger_obligation"), OBLIGATION_SQL, lambda t, d: C.detect_registry(t.projects, t.registry_fields, d))
_detector("det_tier_encrypted", _ENC, ENCRYPTED_SQL, lambda t, d: C.detect_registry(t.projects, t.registry_fields, d))
_detector("det_grep_any_of", [c for c in _GREP if c["detection"].get("any_of")], ANY_SQL, lambda t, d: C.detect_grep(t.projects, t.code_corpus, d))
_detector("det_grep_none_of", [c for c in _GREP if c["detection"].get("none_of")], NONE_SQL, lambda t, d: C.detect_grep(t.projects, t.code_corpus, d))
_detector("det_route_guard", _GUARD, GUARD_SQL, lambda t, d: C.detect_route_guard(t.projects, source_files(t.code_corpus), t.project_config, d))
_detector("det_evidence_doc", _DOC, EVIDENCE_SQL, lambda t, d: C.detect_evidence(t.projects, t.evidence_index, t.file_meta, AS_OF, d))


_BAD_ROUTES = f"""SELECT r.project, r.source_file, r.item FROM ({_routes_sql('Depends|require_auth|require_role|authorize|user_claims|request.state.user_claims')}) r LEFT JOIN project_config g ON g.project = r.project
WHERE NOT guarded AND NOT coalesce(len(list_filter(g.public_route_patterns, lambda x: regexp_matches(r.route, x))) > 0, FALSE)"""


@query("det_route_guard_offenders", f"SELECT b.project, c.id, b.source_file, b.item FROM ({_BAD_ROUTES}) b CROSS JOIN ({sql_rows((c['id'],) for c in _GUARD)}) c(id)")
def _(t):
    dets = C.number_detections(_GUARD)
    names = F.create_map(*[F.lit(x) for d in dets for x in (d["ctl"], d["id"])])
    rows = C.judged_routes(source_files(t.code_corpus), t.project_config, dets)
    return rows.select("project", names[F.col("ctl")].alias("id"), "source_file", "item")


@query(
    "det_registry_offenders",
    f"""SELECT f.project, c.id, concat(f.schema_path, ':', f.name) AS item FROM registry_fields f
JOIN ({sql_rows((c['id'], c['detection']['tier'].lower()) for c in _ENC)}) c(id, tier) ON lower(f.classification) = c.tier WHERE f.is_dict AND NOT list_contains(f.annotations, 'encrypted_at_rest')""",
)
def _(t):
    dets = C.number_detections(_ENC)
    names = F.create_map(*[F.lit(x) for d in dets for x in (d["ctl"], d["id"])])
    return C.registry_offenders(t.registry_fields, dets).select("project", names[F.col("ctl")].alias("id"), "item")


_FORBIDDEN = [c for c in _GREP if c["detection"].get("none_of")]
OFFENDERS_SQL = f"""SELECT f.project, c.id, concat(f.schema_path, ':', coalesce(f.name, '<unnamed>')) AS item FROM registry_fields f
  JOIN ({sql_rows((c['id'], c['detection']['tier'].lower()) for c in _ENC)}) c(id, tier) ON lower(f.classification) = c.tier WHERE f.is_dict AND NOT list_contains(f.annotations, 'encrypted_at_rest')
UNION ALL SELECT project, 'GDPR-ART17-ERASURE', concat(schema_path, ':', coalesce(name, '<unnamed>')) FROM registry_fields WHERE is_dict AND lower(classification) = 'pii' AND {_BARE}
UNION ALL SELECT f.project, v.id, concat(f.path, ':', v.pattern) FROM code_corpus f JOIN ({sql_rows((c['id'], i, p) for c in _FORBIDDEN for i, p in enumerate(_pats(c)))}) v(id, pat, pattern)
  ON regexp_matches(f.content, v.pattern) WHERE {EVIDENCE_OK} AND {_grep_files(_FORBIDDEN[0])}
UNION ALL SELECT b.project, c.id, b.item FROM ({_BAD_ROUTES}) b CROSS JOIN ({sql_rows((c['id'],) for c in _GUARD)}) c(id)"""


@query("control_offenders", OFFENDERS_SQL)
def _(t):
    names = F.create_map(*[F.lit(x) for i, c in enumerate(CONTROLS) for x in (i, c["id"])])
    texts = stage(C.text_stream(t.code_corpus, is_source_file()), "texts")
    rows = C.control_offenders(control_tables(t) | {"texts": texts}, CONTROLS)
    return rows.select("project", names[F.col("control")].alias("id"), "item")


def _control(cid: str, detection: dict, **more) -> dict:
    return {"framework": "house", "id": cid, "title": cid, "severity": "must", "detection": detection, **more}


_CONFIG = [
    _control("CFG-FILE", {"method": "config_present", "path": "config/app.yaml"}),
    _control("CFG-TLS", {"method": "config_present", "path": "config/app.yaml", "required_key": "server.tls", "required_value": "True"}),
    _control("CFG-PORT", {"method": "config_present", "path": "config/app.yaml", "required_key": "server.port"}),
    _control("CFG-TEXT", {"method": "config_present", "path": "config/app.yaml", "required_key": "audit.level", "required_value": "high"}),
    _control("CFG-OTHER", {"method": "config_present", "path": "config/none.yaml", "required_key": "x"}),
]
CONFIG_SQL = f"""SELECT p.project, c.id, CASE WHEN f.content IS NULL THEN 'missing' WHEN c.id = 'CFG-TLS' AND p.pn % 3 <> 0 THEN 'missing' WHEN c.id = 'CFG-PORT' AND p.pn % 4 <> 0 THEN 'missing' ELSE 'present' END AS verdict, c.path AS target,
  CASE WHEN f.content IS NULL THEN 'config file missing' WHEN c.id = 'CFG-FILE' THEN 'config file present'
    WHEN c.id = 'CFG-TLS' AND p.pn % 3 <> 0 THEN 'server.tls does not equal True' WHEN c.id = 'CFG-PORT' AND p.pn % 4 <> 0 THEN 'required key server.port missing' ELSE concat(c.key, ' present') END AS message, '' AS uncovered
FROM projects p CROSS JOIN ({sql_rows((c['id'], c['detection']['path'], c['detection'].get('required_key', '')) for c in _CONFIG)}) c(id, path, key)
LEFT JOIN config_files f ON f.project = p.project AND f.path = c.path"""


def _config_values(t):
    from fleetlens.sources.documents import config_values

    return config_values(t.config_files.where("path = 'config/app.yaml'"))


_detector("det_config_present", _CONFIG, CONFIG_SQL, lambda t, d: C.detect_config(t.projects, t.config_files, _config_values(t), d))

_COMPANIONS = [_control(f"CMP-{x.upper()}", {"method": "companion_config", "tool": x}) for x in ("pact", "baton", "other")]
COMPANION_SQL = f"""SELECT p.project, c.id, CASE WHEN hit IS NULL THEN 'missing' ELSE 'present' END AS verdict, coalesce(hit, c.tool) AS target,
  concat(c.tool, CASE WHEN hit IS NULL THEN ' companion config missing' ELSE ' companion config present' END) AS message, '' AS uncovered
FROM (SELECT p.project, c.id, c.tool, CASE WHEN c.tool = 'pact' AND g.pact_project_dir = 'contracts' AND EXISTS (SELECT 1 FROM contracts k WHERE k.project = p.project) THEN 'contracts'
    WHEN c.tool = 'pact' AND p.pn % 4 = 1 THEN '.pact' WHEN c.tool = 'baton' AND p.pn % 3 = 1 THEN 'baton.yaml' END AS hit
  FROM projects p JOIN project_config g ON g.project = p.project CROSS JOIN ({sql_rows((c['id'], c['detection']['tool']) for c in _COMPANIONS)}) c(id, tool)) c JOIN projects p ON p.project = c.project"""


def _companion(t, dets):
    files = t.config_files.select("project", "path").unionByName(t.contracts.select("project", "path"))
    own = t.project_config.select("project", F.lit("pact").alias("tool"), F.col("pact_project_dir").alias("path"))
    return C.detect_companion(t.projects, files, dets, own)


_detector("det_companion_config", _COMPANIONS, COMPANION_SQL, _companion)


# --- dispatch and corroboration -----------------------------------------------------------

_ROPA = {"method": "evidence_doc", "evidence_path_key": "ropa", "max_age_days": 400}
_RISK = {"method": "evidence_doc", "evidence_path_key": "risk_register", "max_age_days": 400}
_DISPATCH = [
    _control("DSP-UNKNOWN", {"method": "crystal_ball"}),
    _control("DSP-JUDGE", {"method": "llm_judgment"}),
    _control("DSP-PARTIAL", _ROPA, corroborating_detection=[{"method": "crystal_ball"}]),
    _control("DSP-SECOND", _ROPA, corroborating_detection=[_RISK, {"method": "llm_judgment"}]),
]
_E = _evidence_sql([("ropa", "ropa", 400), ("risk", "risk_register", 400)])
_EVALUATED = f"""WITH e AS ({_E}),
r AS (SELECT project, verdict, target, message FROM e WHERE id = 'ropa'), k AS (SELECT project, verdict, target, message FROM e WHERE id = 'risk')"""
_UNKNOWN_SQL = """SELECT project, 'DSP-UNKNOWN' AS id, 'missing' AS verdict, 'DSP-UNKNOWN' AS target, 'unknown detector: crystal_ball' AS message, '' AS uncovered FROM projects
UNION ALL SELECT project, 'DSP-JUDGE', 'skipped', 'DSP-JUDGE', 'llm_judgment skipped; pass --with-llm to enable', '' FROM projects"""
_PARTIAL_SQL = """SELECT project, 'DSP-PARTIAL' AS id, CASE WHEN verdict = 'present' THEN 'partial' ELSE verdict END AS verdict, target,
  CASE WHEN verdict = 'present' THEN 'unknown corroborating detector: crystal_ball' ELSE message END AS message, '' AS uncovered FROM r"""
_SECOND_SQL = """SELECT r.project, 'DSP-SECOND' AS id, CASE WHEN r.verdict = 'present' THEN 'partial' ELSE r.verdict END AS verdict,
  CASE WHEN r.verdict <> 'present' THEN r.target WHEN k.verdict <> 'present' THEN k.target ELSE 'DSP-SECOND' END AS target,
  CASE WHEN r.verdict <> 'present' THEN r.message WHEN k.verdict <> 'present' THEN concat('corroborating check: ', k.message) ELSE 'corroborating check: llm_judgment skipped; pass --with-llm to enable' END AS message, '' AS uncovered
FROM r JOIN k ON k.project = r.project"""


def _evaluated(t, controls):
    names = F.create_map(*[F.lit(x) for i, c in enumerate(controls) for x in (i, c["id"])])
    return C.evaluate_controls(control_tables(t), controls, AS_OF).select(
        "project", names[F.col("control")].alias("id"), "verdict", "target", "message", joined("uncovered", "; ")
    )


@query("det_method_dispatch", f"{_EVALUATED} {_UNKNOWN_SQL} UNION ALL {_PARTIAL_SQL}")
def _(t):
    return _evaluated(t, _DISPATCH[:3])


@query("control_corroboration", f"{_EVALUATED} {_SECOND_SQL}")
def _(t):
    return _evaluated(t, _DISPATCH[3:])


# --- applicability, merge, verdicts ----------------------------------------------------------


def _applicability_sql() -> str:
    rows = []
    for c in CONTROLS:
        app = c["applicability"]
        if app:
            tags = app.get("tags", [])
            tiers = [x.lower() for x in app.get("data_tiers", [])]
            rows.append((c["id"], bool(app.get("requires_ledger_registry")), ", ".join(tags), tags[0] if tags else None, ", ".join(tiers), tiers[0] if tiers else None))
    return f"""SELECT project, id, CASE WHEN why = 'tags' THEN id ELSE 'ledger' END AS target,
  CASE why WHEN 'registry' THEN 'control requires Ledger registry' WHEN 'tags' THEN concat('missing project tag(s): ', tags) ELSE concat('no Ledger fields for tier(s): ', tiers) END AS message
FROM (SELECT p.project, c.id, c.tags, c.tiers, CASE WHEN c.reg AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.project = p.project AND a.kind = 'registry') THEN 'registry'
    WHEN c.tag IS NOT NULL AND NOT list_contains(g.project_tags, c.tag) THEN 'tags'
    WHEN c.tier IS NOT NULL AND NOT EXISTS (SELECT 1 FROM registry_fields f WHERE f.project = p.project AND f.is_dict AND lower(f.classification) = c.tier) THEN 'tiers' END AS why
  FROM projects p JOIN project_config g ON g.project = p.project CROSS JOIN ({sql_rows(rows)}) c(id, reg, tags, tag, tiers, tier)) x WHERE why IS NOT NULL"""


APPLICABILITY_SQL = _applicability_sql()


@query("control_applicability", APPLICABILITY_SQL)
def _(t):
    names = F.create_map(*[F.lit(x) for i, c in enumerate(CONTROLS) for x in (i, c["id"])])
    off = C.control_applicability(t.projects, t.artifacts.where("kind = 'registry'"), t.registry_fields, t.project_config, CONTROLS)
    return off.select("project", names[F.col("control")].alias("id"), "target", "message")


@query(
    "controls_merge",
    f"""SELECT framework, id, min(layer)::INTEGER AS layer, arg_min(ord, layer * 10000000000 + ord) AS ord, arg_max(title, layer * 10000000000 + ord) AS title, arg_max(severity, layer * 10000000000 + ord) AS severity FROM (
  SELECT framework, id, 0::BIGINT AS layer, ord::BIGINT AS ord, title, severity FROM ({sql_rows((c['framework'], c['id'], i, c['title'], c['severity']) for i, c in enumerate(CONTROLS))}) v(framework, id, ord, title, severity)
  UNION ALL SELECT lower(framework), id, 1, ord, title, severity FROM project_controls) u GROUP BY 1, 2""",
)
def _(t):
    base = C.controls_table(t.spark).select("framework", "id", "ord", "title", "severity")
    return C.controls_merge(base, t.project_controls).select("framework", "id", "layer", "ord", "title", "severity")


_OWN = [("hub", "GDPR", _DOC[0]["id"], 1, {"evidence_path_key": _DOC[0]["detection"]["evidence_path_key"], "max_age_days": 30}),
        ("src1_0", "gdpr", _DOC[0]["id"], 2, {"evidence_path_key": "risk_register", "max_age_days": 400}),
        ("src2_0", "house", "OWN-DOC", 3, {"evidence_path_key": "ropa", "max_age_days": 400})]
_OWN = [(p, _DOC[0]["framework"] if i == _DOC[0]["id"] else f, i, o, {"method": "evidence_doc", **d}) for p, f, i, o, d in _OWN]
_EVERYWHERE = [(c["id"], c["detection"]["evidence_path_key"], c["detection"]["max_age_days"]) for c in _DOC]


@query(
    "controls_per_project",
    f"""SELECT {RESULT} FROM ({_evidence_sql(_EVERYWHERE)}) e WHERE NOT (id = '{_DOC[0]["id"]}' AND project IN ('hub', 'src1_0'))"""
    + "".join(
        f""" UNION ALL SELECT {RESULT} FROM ({_evidence_sql([(i, d["evidence_path_key"], d["max_age_days"])])}) o WHERE project = '{p}'"""
        for p, _, i, _, d in _OWN
    ),
)
def _(t):
    own = [{"framework": f, "id": i, "detection": d, "title": i} for _, f, i, _, d in _OWN]
    base = [c | {"applicability": {}, "corroborating_detection": []} for c in _DOC]
    projects = F.get(F.array(*[F.lit(o[0]) for o in _OWN]), F.col("ord").cast("int"))
    mine = C.controls_table(t.spark, own).withColumn("project", projects)
    controls = C.controls_list(C.controls_merge(C.controls_table(t.spark, base), mine))
    return _evaluated(t, controls)


@query(
    "controls_read",
    """SELECT lower(p.framework) AS framework, CASE v.n WHEN 0 THEN p.id ELSE concat('B', p.ord) END AS id, v.n::BIGINT AS ord, concat('R', p.ord * (1 - v.n // 2)) AS ref,
  CASE v.n WHEN 0 THEN p.title ELSE 'T' END AS title, CASE v.n WHEN 0 THEN p.severity ELSE 'must' END AS severity,
  CASE v.n WHEN 0 THEN 'source_grep' ELSE 'm' END AS method, CASE v.n WHEN 0 THEN NULL ELSE 'a' END AS tag
FROM project_controls p CROSS JOIN (VALUES (0), (2)) v(n) WHERE p.ord % 13 <> 5""",
)
def _(t):
    from fleetlens.sources.documents import controls_read

    return controls_read(t.controls_yaml).select(
        "framework", "id", "ord", F.when(F.col("ord") == 0, F.col("framework_ref")).otherwise("R0").alias("ref"), "title", "severity",
        F.get_json_object("detection", "$.method").alias("method"), F.get_json_object("applicability", "$.tags[0]").alias("tag"),
    )


VERDICTS_SQL = f"""SELECT r.project, r.id, CASE WHEN a.id IS NOT NULL THEN 'skipped' ELSE r.verdict END AS verdict, coalesce(a.target, r.target) AS target, coalesce(a.message, r.message) AS message,
  CASE WHEN a.id IS NOT NULL THEN '' ELSE r.uncovered END AS uncovered
FROM ({' UNION ALL '.join(f'SELECT {RESULT} FROM ({s}) q' for s in (ENCRYPTED_SQL, OBLIGATION_SQL, ANY_SQL, NONE_SQL, GUARD_SQL, EVIDENCE_SQL))}) r
LEFT JOIN ({APPLICABILITY_SQL}) a ON a.project = r.project AND a.id = r.id"""


def _compliance_sql(controls: list[dict]) -> str:
    meta = sql_rows((c["id"], c["framework"], c["severity"]) for c in controls)
    return f"""SELECT project, tool, check_id, target, CASE WHEN status <> 'PASS' THEN status WHEN severity = 'must' THEN 'FAIL' ELSE 'WARN' END AS severity, status, message, '' AS o1, 0::BIGINT AS o2 FROM (
  SELECT v.project, c.framework AS tool, v.id AS check_id, v.target, c.severity, CASE v.verdict WHEN 'present' THEN 'PASS' WHEN 'partial' THEN 'WARN' WHEN 'skipped' THEN 'INFO' ELSE CASE c.severity WHEN 'must' THEN 'FAIL' ELSE 'WARN' END END AS status,
    CASE WHEN v.uncovered <> '' THEN concat(v.message, '; uncovered: ', replace(v.uncovered, '; ', ', ')) ELSE v.message END AS message
  FROM ({VERDICTS_SQL}) v JOIN ({meta}) c(id, framework, severity) ON c.id = v.id) s"""


COMPLIANCE_SQL = _compliance_sql(CONTROLS)


@query("verdict_to_check", shown(_compliance_sql([c for c in CONTROLS if c["framework"] in ("gdpr", "pcidss")])))
def _(t):
    chosen = [c for c in CONTROLS if c["framework"] in ("gdpr", "pcidss")]
    return C.verdict_to_check(C.evaluate_controls(control_tables(t), chosen, AS_OF), chosen).select(*SHOWN)


@query("run_compliance", shown(COMPLIANCE_SQL))
def _(t):
    return C.run_compliance(control_tables(t), AS_OF).select(*SHOWN)


# --- reports -----------------------------------------------------------------------------------

ALL_SQL = f"{ALL_CHECKS_SQL} UNION ALL {COMPLIANCE_SQL}"


IDLE_SQL = "SELECT project FROM projects UNION ALL SELECT 'idle'"


def all_checks(t):
    """All check rows; each text is read once, what checks and controls need of it is staged."""
    texts = stage(C.text_stream(t.code_corpus, is_source_file()), "texts")
    control = control_tables(t) | {"texts": texts}
    return K.run_checks(check_tables(t) | {"texts": texts}).unionByName(C.run_compliance(control, AS_OF))


def tool_summary(t):
    """Summary of the tools' checks, without controls."""
    return R.check_summary(R.check_log(K.run_checks(check_tables(t))))


def _score_sql(keys: str, source: str, info: str = "") -> str:
    return f"""SELECT *, score_pass + score_warn + score_fail AS total, CASE WHEN score_pass + score_warn + score_fail = 0 THEN 100.0::DOUBLE ELSE round_even(score_pass::DOUBLE / (score_pass + score_warn + score_fail) * 100, 1) END AS score_pct FROM (
  SELECT {keys}, count(*) FILTER (WHERE status = 'PASS') AS score_pass, count(*) FILTER (WHERE status = 'WARN') AS score_warn, count(*) FILTER (WHERE status = 'FAIL') AS score_fail{info} FROM ({source}) c GROUP BY {keys}) s"""


OVERALL_SQL = _score_sql("project", ALL_CHECKS_SQL)


@query("score_by_tool", _score_sql("project, tool", ALL_SQL, ", count(*) FILTER (WHERE status = 'INFO') AS score_info"))
def _(t):
    return R.score_by_tool(R.check_summary(R.check_log(all_checks(t))))


@query(
    "score_overall",
    f"""SELECT p.project, coalesce(score_pass, 0) AS score_pass, coalesce(score_warn, 0) AS score_warn, coalesce(score_fail, 0) AS score_fail, coalesce(total, 0) AS total,
  coalesce(score_pct, 100.0) AS score_pct FROM ({IDLE_SQL}) p LEFT JOIN ({_score_sql("project", ALL_SQL)}) s ON s.project = p.project""",
)
def _(t):
    idle = t.projects.select("project").unionByName(t.spark.range(1).select(F.lit("idle").alias("project")))
    return R.score_overall(R.check_summary(R.check_log(all_checks(t))), idle)


@query(
    "report_rows",
    f"""SELECT project, upper(tool) AS tool, target, CASE WHEN length(target) > 40 THEN concat('...', right(target, 37)) ELSE target END AS shown, rpad(status, 6, ' ') AS status, message FROM ({ALL_SQL}) c""",
)
def _(t):
    return R.report_rows(all_checks(t)).drop("ord")


def _recommendation_case() -> str:
    cases = " ".join(f"WHEN {sq(k)} THEN replace({sq(v)}, '{{t}}', target)" for k, v in V.RECOMMENDATIONS.items())
    return f"CASE check_id {cases} ELSE concat('Fix: ', check_id, ' — ', message) END"


RECOMMENDATIONS_SQL = f"""SELECT project, rank::INTEGER AS rank, check_id, {_recommendation_case()} AS recommendation FROM (
  SELECT *, row_number() OVER (PARTITION BY project, check_id ORDER BY rank, o1, o2) AS rn FROM (SELECT *, CASE status WHEN 'FAIL' THEN 0 ELSE 1 END AS rank FROM ({ALL_SQL}) c WHERE status IN ('FAIL', 'WARN')) r) x WHERE rn = 1"""


@query("recommendations", RECOMMENDATIONS_SQL)
def _(t):
    log = R.check_log(all_checks(t))
    return R.recommendations(R.check_summary(log), log).drop("place")


@query(
    "gate_decision",
    f"""SELECT project, bool_or(status = 'FAIL') AS failed, bool_or(status IN ('FAIL', 'WARN')) AS failed_strict FROM ({ALL_SQL}) c GROUP BY 1""",
)
def _(t):
    rows = stage(R.check_summary(R.check_log(all_checks(t))), "summary")
    return R.gate_decision(rows).join(R.gate_decision(rows, strict=True).withColumnRenamed("failed", "failed_strict"), "project")


# --- baseline ------------------------------------------------------------------------------------

_LAST = f"""SELECT project, check_id, last(status ORDER BY o1, o2) AS status FROM ({ALL_CHECKS_SQL}) c GROUP BY 1, 2"""
SNAPSHOT_SQL = f"""SELECT l.project, l.check_id, l.status, s.score_pct FROM ({_LAST}) l JOIN ({OVERALL_SQL}) s ON s.project = l.project"""
# an older state: some ids passed then, one is gone now, scores were higher or unknown
_BASELINE = f"""SELECT project, check_id, CASE WHEN (length(project) + length(check_id)) % 3 = 0 THEN 'PASS' ELSE status END AS status,
  CASE WHEN length(check_id) % 2 = 0 THEN score_pct + 5.0 ELSE score_pct END AS score_pct FROM ({SNAPSHOT_SQL}) b
  UNION ALL SELECT DISTINCT project, 'RETIRED', 'PASS', 0.0::DOUBLE FROM ({SNAPSHOT_SQL}) b"""


def _baseline(summary):
    snap = B.baseline_snapshot(summary)
    older = F.when((F.length("project") + F.length("check_id")) % 3 == 0, "PASS").otherwise(F.col("status"))
    higher = F.when(F.length("check_id") % 2 == 0, F.col("score_pct") + 5.0).otherwise(F.col("score_pct"))
    changed = snap.select("project", "check_id", older.alias("status"), higher.alias("score_pct"))
    retired = snap.select("project").distinct().select(
        "project", F.lit("RETIRED").alias("check_id"), F.lit("PASS").alias("status"), F.lit(0.0).alias("score_pct")
    )
    return changed.unionByName(retired)


@query("baseline_snapshot", SNAPSHOT_SQL)
def _(t):
    return B.baseline_snapshot(tool_summary(t))


REGRESSIONS_SQL = f"""SELECT b.project, b.check_id, coalesce(n.status, 'ABSENT') AS now, concat(b.check_id, ': PASS -> ', coalesce(n.status, 'ABSENT')) AS regression
FROM ({_BASELINE}) b LEFT JOIN ({_LAST}) n ON n.project = b.project AND n.check_id = b.check_id WHERE b.status = 'PASS' AND coalesce(n.status, 'ABSENT') <> 'PASS'"""


@query("baseline_regressions", REGRESSIONS_SQL)
def _(t):
    summary = stage(tool_summary(t), "summary")
    return B.baseline_regressions(_baseline(summary), summary)


@query(
    "baseline_score_drop",
    f"""SELECT s.project, b.before, s.score_pct AS now, CASE WHEN b.before IS NULL THEN concat('baseline missing: ', s.project) ELSE concat('score_pct: ', b.before, ' -> ', s.score_pct) END AS regression
FROM ({OVERALL_SQL}) s LEFT JOIN (SELECT project, max(score_pct) AS before FROM ({_BASELINE}) x WHERE project NOT LIKE '%_1' GROUP BY 1) b ON b.project = s.project
WHERE b.before IS NULL OR s.score_pct < b.before""",
)
def _(t):
    summary = stage(tool_summary(t), "summary")
    return B.baseline_score_drop(_baseline(summary).where(~F.col("project").rlike(".1$")), summary)


# --- assertions ------------------------------------------------------------------------------------


@query(
    "controls_to_assert",
    f"""SELECT s.project, c.framework, c.id, c.assertion FROM ({COMPLIANCE_SQL}) s
JOIN ({sql_rows((c['framework'], c['id'], c['validation_test']['assertion']) for c in CONTROLS if c['validation_test'])}) c(framework, id, assertion) ON c.id = s.check_id WHERE s.status IN ('PASS', 'WARN')""",
)
def _(t):
    return A.controls_to_assert(C.controls_table(t.spark), C.run_compliance(control_tables(t), AS_OF), include_partial=True)


def _judge_sql(scope: str, bad: str, empty: str, text: str) -> str:
    return f"""SELECT p.project, coalesce(n, 0) > 0 AND coalesce(m, 0) = 0 AS ok, CASE WHEN coalesce(n, 0) = 0 THEN '{empty}' WHEN m > 0 THEN concat(m, '{text}') END AS detail
FROM projects p LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (WHERE {bad}) AS m FROM registry_fields WHERE is_dict AND {scope} GROUP BY 1) f ON f.project = p.project"""


@query(
    "assert_companion_field",
    _judge_sql(
        "lower(classification) = 'pii' AND list_contains(annotations, 'gdpr_erasable')", "NOT list_contains(keys, 'erasure_method')",
        "no Ledger fields carry annotation gdpr_erasable", " fields missing erasure_method",
    ),
)
def _(t):
    return A.assert_companion_field(t.projects, t.registry_fields, "gdpr_erasable", "erasure_method", "PII")


@query(
    "assert_tier_encrypted",
    _judge_sql("lower(classification) = 'financial'", "NOT list_contains(annotations, 'encrypted_at_rest')", "no Ledger fields for tier FINANCIAL", " fields missing encrypted_at_rest"),
)
def _(t):
    return A.assert_tier_encrypted(t.projects, t.registry_fields, "FINANCIAL")


def _hits_sql(test: str, wanted: bool, detail: str, files: str = "path LIKE '%/%'") -> str:
    ok = "n IS NOT NULL" if wanted else "n IS NULL"
    return f"""SELECT p.project, {ok} AS ok, coalesce(n, 0) AS files, CASE WHEN NOT ({ok}) THEN {sq(detail)} END AS detail
FROM projects p LEFT JOIN (SELECT project, count(*) AS n FROM code_corpus WHERE {EVIDENCE_OK} AND {files} AND {test} GROUP BY 1) h ON h.project = p.project"""


@query("assert_pattern_present", _hits_sql("regexp_matches(content, 'erasure|data.*export')", True, "pattern not found: erasure|data.*export"))
def _(t):
    return A.assert_pattern_present(t.projects, t.code_corpus, "erasure|data.*export")


@query(
    "assert_pattern_absent",
    _hits_sql("regexp_matches(content, '(store|save).*(cvv|cvc)')", False, "forbidden pattern found", "path LIKE 'src/%' AND path NOT LIKE '%.rb'"),
)
def _(t):
    return A.assert_pattern_absent(t.projects, t.code_corpus, "(store|save).*(cvv|cvc)", ["src/**"], ["*.rb"])


@query("assert_control_referenced", _hits_sql("contains(content, 'do not sell')", True, "pattern not found: do not sell"))
def _(t):
    return A.assert_control_referenced(t.projects, t.code_corpus, "do not sell")


@query(
    "assert_routes_guarded",
    f"""SELECT p.project, coalesce(b, 0) = 0 AS ok, CASE WHEN b > 0 THEN concat(b, ' routes without guard evidence') END AS detail
FROM projects p LEFT JOIN (SELECT project, count(*) FILTER (WHERE NOT guarded) AS b FROM ({_routes_sql('Depends|require_auth')}) r GROUP BY 1) x ON x.project = p.project""",
)
def _(t):
    return A.assert_routes_guarded(t.projects, source_files(t.code_corpus), ["Depends", "require_auth"])


@query(
    "assert_config_equals",
    """SELECT p.project, coalesce(f.content IS NOT NULL AND p.pn % 3 = 0, FALSE) AS ok, CASE WHEN f.content IS NULL THEN 'missing key server.tls' WHEN p.pn % 3 <> 0 THEN 'server.tls=False, expected True' END AS detail
FROM projects p LEFT JOIN config_files f ON f.project = p.project AND f.path = 'config/app.yaml'""",
)
def _(t):
    return A.assert_config_equals(t.projects, _config_values(t), "config/app.yaml", "server.tls", "True")


@query(
    "assert_evidence_fresh",
    f"""SELECT p.project, coalesce(date_diff('day', f.mtime, TIMESTAMP '{AS_OF}') <= 100, FALSE) AS ok, CASE WHEN i.path IS NULL THEN 'missing evidence key dpia' WHEN f.mtime IS NULL THEN concat('missing evidence document: ', i.path)
  WHEN date_diff('day', f.mtime, TIMESTAMP '{AS_OF}') > 100 THEN concat('evidence stale: ', date_diff('day', f.mtime, TIMESTAMP '{AS_OF}'), 'd > 100d') END AS detail
FROM projects p LEFT JOIN evidence_index i ON i.project = p.project AND i.evidence_key = 'dpia' LEFT JOIN file_meta f ON f.project = p.project AND f.path = i.path""",
)
def _(t):
    return A.assert_evidence_fresh(t.projects, t.evidence_index, t.file_meta, "dpia", 100, AS_OF)
