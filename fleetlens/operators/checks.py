"""Compatibility checks: every function returns rows of one check table.

Columns: project, tool, check_id, target, severity, status, message, ord.
``ord`` is the order in which a reader expects the rows of a project:
(tool, section, path, step, pos, sub).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import rx
from fleetlens.functions.text import constant_rows, version_below
from fleetlens.sources.documents import json_document

CHECK_COLUMNS = ["project", "tool", "check_id", "target", "severity", "status", "message", "ord"]


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def check_order(tool: str, section: int, path=None, step: int = 0, pos=None, sub: int = 0) -> Column:
    return F.struct(
        F.lit(V.CHECK_TOOLS.index(tool)).alias("tool"),
        F.lit(section).alias("section"),
        (F.lit("") if path is None else path).alias("path"),
        F.lit(step).alias("step"),
        (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"),
        F.lit(sub).alias("sub"),
    )


def _row(tool: str, check_id, target, severity, status, message, ord_: Column) -> list[Column]:
    return [
        F.lit(tool).alias("tool"),
        _text(check_id).alias("check_id"),
        _text(target).alias("target"),
        _text(severity).alias("severity"),
        _text(status).alias("status"),
        _text(message).alias("message"),
        ord_.alias("ord"),
    ]


Rule = tuple[Column | None, list[Column]]  # when it applies, and the row it gives


def _apply(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules on a table in one pass over it."""
    if len(rules) == 1:
        cond, row = rules[0]
        kept = table if cond is None else table.where(cond)
        return kept.select("project", *row)
    made = F.array(*[F.struct(*row) if cond is None else F.when(cond, F.struct(*row)) for cond, row in rules])
    return table.select("project", F.explode(F.array_compact(made)).alias("row")).select("project", "row.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def has(keys: str, name: str) -> Column:
    return F.array_contains(F.col(keys), name)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- contracts ----------------------------------------------------------------
# contracts(project, path, parse_ok, keys, rationale); rationale is NULL when it is
# given but no text, '' when it is missing


def _contract_valid() -> Rule:
    row = _row("pact", "contract_valid_yaml", F.col("path"), "FAIL", "FAIL", "Invalid YAML", check_order("pact", 0, F.col("path")))
    return ~F.col("parse_ok"), row


def _contract_access() -> Rule:
    absent = ~has("keys", "data_access")
    vague = F.coalesce(F.length(strip(F.col("rationale"))) < V.RATIONALE_MIN_CHARS, F.lit(False))

    def pick(if_absent: str, if_vague: str, otherwise: str) -> Column:
        return F.when(absent, if_absent).when(vague, if_vague).otherwise(otherwise)

    row = _row(
        "pact",
        pick("contract_has_data_access", "contract_data_access_rationale_not_vague", "contract_has_data_access"),
        F.col("path"),
        pick("FAIL", "WARN", "FAIL"),
        pick("FAIL", "WARN", "PASS"),
        pick("missing data_access field", "data_access.rationale is vague", "data_access present"),
        check_order("pact", 0, F.col("path"), 1),
    )
    return F.col("parse_ok"), row


def _contract_authority() -> Rule:
    there = has("keys", "authority")
    row = _row(
        "pact",
        "contract_has_authority",
        F.col("path"),
        "FAIL",
        F.when(there, "PASS").otherwise("FAIL"),
        F.when(there, "authority present").otherwise("missing authority field"),
        check_order("pact", 0, F.col("path"), 2),
    )
    return F.col("parse_ok"), row


def chk_contract_valid_yaml(contracts: DataFrame) -> DataFrame:
    return _apply(contracts, [_contract_valid()])


def chk_contract_data_access(contracts: DataFrame) -> DataFrame:
    return _apply(contracts, [_contract_access()])


def chk_contract_authority(contracts: DataFrame) -> DataFrame:
    return _apply(contracts, [_contract_authority()])


def contract_checks(contracts: DataFrame) -> DataFrame:
    return _apply(contracts, [_contract_valid(), _contract_access(), _contract_authority()])


# --- Python sources -------------------------------------------------------------
# sources: the corpus rows of lang python below the source folders


def _python(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("lang") == "python")


def source_signals(pattern: str = V.PACT_KEY_FORMAT) -> Column:
    """What the source checks ask of a text, and its distinct keys."""
    text, p = F.col("content"), rx(pattern)
    keys = F.when(text.rlike(p), F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        ((text.contains("class ") | text.contains("def ")) & ~text.rlike(p)).alias("no_key"),
        (text.contains("class ") & ~text.contains("event_handler")).alias("no_event"),
        (text.contains("class ") & text.contains("event_handler") & ~text.contains("log_handler")).alias("no_log"),
        keys.alias("keys"),
    )


def _signals(sources: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Python sources with the column ``signals``: that of a ``text_stream``, or looked up in the texts."""
    if "signals" in sources.columns:
        return sources.where(F.col("signals").isNotNull())
    return _python(sources).withColumn("signals", source_signals(pattern).dropFields(*({"no_key", "no_event", "no_log", "keys"} - set(names))))


def _source_key() -> Rule:
    row = _row("pact", "source_has_pact_key", F.col("path"), "FAIL", "FAIL", "no PACT key found in any method",
               check_order("pact", 1, F.col("path")))
    return F.col("signals.no_key"), row


def _source_event() -> Rule:
    row = _row("pact", "source_has_event_handler", F.col("path"), "FAIL", "FAIL", "no event_handler parameter",
               check_order("pact", 1, F.col("path"), 2))
    return F.col("signals.no_event"), row


def _source_log() -> Rule:
    row = _row("pact", "source_has_log_handler", F.col("path"), "WARN", "WARN", "event_handler present but log_handler missing",
               check_order("pact", 1, F.col("path"), 3))
    return F.col("signals.no_log"), row


def chk_source_has_pact_key(sources: DataFrame, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    return _apply(_signals(sources, pattern, "no_key"), [_source_key()])


def chk_source_event_handler(sources: DataFrame, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    return _apply(_signals(sources, pattern, "no_event"), [_source_event()])


def chk_source_log_handler(sources: DataFrame, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    return _apply(_signals(sources, pattern, "no_log"), [_source_log()])


def source_checks(sources: DataFrame, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    """The three source checks in one pass over the texts."""
    return _apply(_signals(sources, pattern, "no_key", "no_event", "no_log"), [_source_key(), _source_event(), _source_log()])


def chk_pact_key_format(sources: DataFrame, pattern: str = V.PACT_KEY_FORMAT, group: int = 0) -> DataFrame:
    """Found keys that do not fit the whole pattern.

    With ``group`` 1 the first capture group is what counts as the key.
    """
    p = rx(pattern)
    keys = _python(sources).where(F.col("content").rlike(p)).select(
        "project", "path", F.posexplode(F.regexp_extract_all("content", F.lit(p), F.lit(group))).alias("pos", "key")
    )
    row = _row("pact", "pact_key_format_valid", F.col("path"), "FAIL", "FAIL",
               F.concat(F.lit("malformed PACT key: "), "key"), check_order("pact", 1, F.col("path"), 1, F.col("pos")))
    return _apply(keys, [(~F.col("key").rlike("^(?:" + p + r")\z"), row)])


# --- topology --------------------------------------------------------------------
# topologies(project, path, parse_ok, version, global_keys); topology_nodes(project, pos, name, protocol, keys)


def chk_topology_exists_valid(projects: DataFrame, topologies: DataFrame) -> DataFrame:
    absent = projects.join(topologies, "project", "left_anti")
    missing = _row("baton", "baton_yaml_exists", "baton.yaml", "INFO", "INFO", "no baton.yaml found", check_order("baton", 0))
    broken = _row("baton", "baton_yaml_valid", F.col("path"), "FAIL", "FAIL", "Invalid YAML", check_order("baton", 0))
    return _apply(absent, [(None, missing)]).unionByName(_apply(topologies, [(~F.col("parse_ok"), broken)]))


def chk_topology_version(topologies: DataFrame, minimum: str = V.MIN_TOPOLOGY_VERSION) -> DataFrame:
    version = F.coalesce("version", F.lit("1.0"))
    old = version_below(version, minimum)
    row = _row(
        "baton",
        "baton_yaml_version_current",
        F.col("path"),
        "FAIL",
        F.when(old, "FAIL").otherwise("PASS"),
        F.when(old, F.concat(F.lit("version "), version, F.lit(f", requires {minimum}"))).otherwise(
            F.concat(F.lit("version "), version)
        ),
        check_order("baton", 1),
    )
    return _apply(topologies, [(F.col("parse_ok"), row)])


def _node_rule(cond: Column, check_id: str, message: str, sub: int) -> Rule:
    target = F.concat(F.lit("node: "), F.coalesce("name", F.lit("unknown")))
    return cond, _row("baton", check_id, target, "WARN", "WARN", message, check_order("baton", 2, None, 0, F.col("pos"), sub))


def _node_access() -> Rule:
    return _node_rule(~has("keys", "data_access"), "all_nodes_have_data_access", "data_access not declared", 0)


def _node_authority() -> Rule:
    return _node_rule(~has("keys", "authority"), "all_nodes_have_authority_declared", "authority not declared", 1)


def _node_openapi() -> Rule:
    cond = (F.col("protocol") == "http") & ~has("keys", "openapi_spec")
    return _node_rule(cond, "openapi_spec_present_for_http_nodes", "no openapi_spec configured", 2)


def chk_node_data_access(nodes: DataFrame) -> DataFrame:
    return _apply(nodes, [_node_access()])


def chk_node_authority(nodes: DataFrame) -> DataFrame:
    return _apply(nodes, [_node_authority()])


def chk_node_openapi(nodes: DataFrame) -> DataFrame:
    return _apply(nodes, [_node_openapi()])


def node_checks(nodes: DataFrame) -> DataFrame:
    return _apply(nodes, [_node_access(), _node_authority(), _node_openapi()])


def chk_global_sections(topologies: DataFrame) -> DataFrame:
    wanted = [
        ("arbiter", "arbiter_endpoint_configured", "INFO", "arbiter endpoint not configured"),
        ("ledger", "ledger_endpoint_configured", "INFO", "ledger endpoint not configured"),
        ("audit_channel", "audit_channel_port_configured", "WARN", "audit_channel not configured"),
    ]
    names = ["key", "check_id", "level", "message"]
    sections = constant_rows([dict(zip(names, row)) for row in wanted], names)
    missing = topologies.where("parse_ok").select(
        "project", "path", "global_keys", F.posexplode(sections).alias("n", "s")
    ).where(~F.array_contains(F.col("global_keys"), F.col("s.key")))
    row = _row("baton", F.col("s.check_id"), F.col("path"), F.col("s.level"), F.col("s.level"), F.col("s.message"),
               check_order("baton", 3, None, 0, F.col("n")))
    return _apply(missing, [(None, row)])


# --- registry ----------------------------------------------------------------------
# registry_fields(project, schema_path, pos, name, classification, annotations, keys, is_dict);
# a schema with an empty list has one row with pos NULL


def chk_fields_classified(fields: DataFrame) -> DataFrame:
    bare = F.count_if(F.col("is_dict") & ~has("keys", "classification"))
    per_schema = fields.groupBy("project", "schema_path").agg(bare.alias("missing"), F.count("pos").alias("n"))
    level = F.when(F.col("missing") > F.expr("n div 2"), "FAIL").otherwise("WARN")
    clean = F.col("missing") == 0
    row = _row(
        "ledger",
        "all_fields_have_classification",
        F.col("schema_path"),
        F.when(clean, "FAIL").otherwise(level),
        F.when(clean, "PASS").otherwise(level),
        F.when(clean, "all fields have classification").otherwise(
            F.concat(F.col("missing").cast("string"), F.lit(" fields missing classification"))
        ),
        check_order("ledger", 1, F.col("schema_path")),
    )
    return _apply(per_schema, [(None, row)])


def _field_rule(cond: Column, check_id: str, level: str, message: str, step: int) -> Rule:
    target = F.concat("schema_path", F.lit(":"), F.coalesce("name", F.lit("")))
    order = check_order("ledger", 1, F.col("schema_path"), step, F.col("pos"))
    return F.col("is_dict") & cond, _row("ledger", check_id, target, level, level, message, order)


def _field_conflict() -> Rule:
    both = has("annotations", "gdpr_erasable") & has("annotations", "immutable")
    return _field_rule(both, "no_annotation_conflicts", "FAIL", "field is both gdpr_erasable and immutable", 1)


def _field_erasure() -> Rule:
    bare = has("annotations", "gdpr_erasable") & ~has("keys", "erasure_method")
    return _field_rule(bare, "gdpr_erasable_has_erasure_method", "WARN", "gdpr_erasable field has no erasure_method", 2)


def _field_retention() -> Rule:
    bare = has("annotations", "audit_field") & ~has("keys", "retention_policy")
    return _field_rule(bare, "audit_fields_have_retention_policy", "WARN", "audit field has no retention_policy", 3)


def chk_annotation_conflict(fields: DataFrame) -> DataFrame:
    return _apply(fields, [_field_conflict()])


def chk_erasure_method(fields: DataFrame) -> DataFrame:
    return _apply(fields, [_field_erasure()])


def chk_audit_retention(fields: DataFrame) -> DataFrame:
    return _apply(fields, [_field_retention()])


def field_checks(fields: DataFrame) -> DataFrame:
    return _apply(fields, [_field_conflict(), _field_erasure(), _field_retention()])


def chk_registry_exists(projects: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifacts(project, kind, location_rank, path, body) holds kinds registry and arbiter."""
    expected = [
        ("registry", "ledger", 2, "ledger_registry_exists", ".ledger/registry/", "no ledger registry found"),
        ("arbiter", "arbiter", 3, "arbiter_registry_exists", ".arbiter/registry/", "no arbiter registry found"),
    ]
    names = ["kind", "tool", "tool_ord", "check_id", "target", "message"]
    kinds = constant_rows([dict(zip(names, row)) for row in expected], names)
    absent = (
        projects.select("project", F.explode(kinds).alias("k"))
        .select("project", "k.*")
        .join(artifacts.select("project", "kind"), ["project", "kind"], "left_anti")
    )
    level = F.lit("INFO")
    order = F.struct(
        F.col("tool_ord").alias("tool"), F.lit(0).alias("section"), F.lit("").alias("path"),
        F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("sub"),
    )
    return absent.select(
        "project", "tool", "check_id", "target", level.alias("severity"), level.alias("status"), "message", order.alias("ord")
    )


def _located(artifacts: DataFrame, kind: str) -> DataFrame:
    """Per project the artifact at the first place it is found; only its validity travels."""
    return (
        artifacts.where(F.col("kind") == kind)
        .select("project", "location_rank", "path", json_document(F.col("body"))["ok"].alias("ok"))
        .groupBy("project")
        .agg(F.min(F.struct("location_rank", "path", "ok")).alias("first"))
        .select("project", F.col("first.path").alias("path"), F.col("first.ok").alias("ok"))
    )


def chk_access_graph(artifacts: DataFrame) -> DataFrame:
    holders = artifacts.where(F.col("kind") == "arbiter").select("project").distinct()
    found = holders.join(_located(artifacts, "access_graph"), "project", "left")
    absent, bad = F.col("path").isNull(), ~F.col("ok")
    row = _row(
        "arbiter",
        F.when(~absent & bad, "access_graph_valid").otherwise("access_graph_exists"),
        F.coalesce("path", F.lit("access_graph.json")),
        "FAIL",
        F.when(absent | bad, "FAIL").otherwise("PASS"),
        F.when(absent, "not found — run pact build first").when(bad, "Invalid JSON").otherwise("present and readable"),
        check_order("arbiter", 1),
    )
    return _apply(found, [(None, row)])


def chk_trust_ledger(artifacts: DataFrame) -> DataFrame:
    holders = artifacts.where(F.col("kind") == "arbiter").select("project").distinct()
    found = holders.join(_located(artifacts, "trust_ledger"), "project")
    row = _row(
        "arbiter",
        F.when(F.col("ok"), "trust_ledger_readable").otherwise("trust_ledger_valid"),
        F.col("path"),
        "FAIL",
        F.when(F.col("ok"), "PASS").otherwise("FAIL"),
        F.when(F.col("ok"), "present and readable").otherwise("Invalid JSON"),
        check_order("arbiter", 2),
    )
    return _apply(found, [(None, row)])


# --- manifest --------------------------------------------------------------------
# manifests(project, path, parse_ok); manifest_entries(project, pos, pact_key, keys, contract_path, test_path)


def chk_manifest_exists_valid(projects: DataFrame, manifests: DataFrame) -> DataFrame:
    absent = projects.join(manifests, "project", "left_anti")
    missing = _row("sentinel", "sentinel_manifest_exists", ".sentinel/manifest.json", "INFO", "INFO",
                   "no sentinel manifest found", check_order("sentinel", 0))
    broken = _row("sentinel", "sentinel_manifest_valid", F.col("path"), "FAIL", "FAIL", "Invalid JSON", check_order("sentinel", 0))
    return _apply(absent, [(None, missing)]).unionByName(_apply(manifests, [(~F.col("parse_ok"), broken)]))


def _entry_rule(cond: Column, what: str, sub: int) -> Rule:
    row = _row("sentinel", f"all_manifest_entries_have_{what}", F.coalesce("pact_key", F.lit("unknown")), "FAIL", "FAIL",
               f"missing {what}", check_order("sentinel", 1, None, 0, F.col("pos"), sub))
    return cond, row


def _entry_contract() -> Rule:
    return _entry_rule(F.col("contract_path").isNull(), "contract_path", 0)


def _entry_test() -> Rule:
    return _entry_rule(F.col("test_path").isNull(), "test_path", 1)


def _entry_source() -> Rule:
    return _entry_rule(~has("keys", "source_path") & ~has("keys", "source_file"), "source_path", 2)


def chk_manifest_contract_path(entries: DataFrame) -> DataFrame:
    return _apply(entries, [_entry_contract()])


def chk_manifest_test_path(entries: DataFrame) -> DataFrame:
    return _apply(entries, [_entry_test()])


def chk_manifest_source_path(entries: DataFrame) -> DataFrame:
    return _apply(entries, [_entry_source()])


def entry_checks(entries: DataFrame) -> DataFrame:
    return _apply(entries, [_entry_contract(), _entry_test(), _entry_source()])


def chk_source_keys_in_manifest(
    sources: DataFrame, manifests: DataFrame, entries: DataFrame, pattern: str = V.PACT_KEY_FORMAT
) -> DataFrame:
    """Distinct source keys without a manifest entry, counted per project."""
    keys = _signals(sources, pattern, "keys").select("project", F.explode("signals.keys").alias("pact_key")).distinct()
    missing = keys.join(entries.select("project", "pact_key"), ["project", "pact_key"], "left_anti")
    counted = missing.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    readable = manifests.where("parse_ok").select("project", "path")
    row = _row("sentinel", "all_source_pact_keys_in_manifest", F.col("path"), "WARN", "WARN",
               F.concat(F.col("n").cast("string"), F.lit(" PACT keys in source not in manifest")), check_order("sentinel", 2))
    return _apply(counted.join(readable, "project"), [(None, row)])


def chk_integrations_configured(config: DataFrame, manifests: DataFrame) -> DataFrame:
    """config(project, pact_project_dir, arbiter_registry); only projects with a readable manifest."""
    wanted = [
        ("pact_configured", "pact_project_dir", "Pact project"),
        ("arbiter_configured", "arbiter_registry", "Arbiter registry"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("check_id"),
                F.lit(f"stack.{col}").alias("target"),
                F.when(F.coalesce(F.col(col), F.lit("")) != "", "PASS").otherwise("INFO").alias("status"),
                F.lit(label).alias("label"),
            )
            for c, col, label in wanted
        ]
    )
    readable = config.join(manifests.where("parse_ok").select("project"), "project", "left_semi")
    found = readable.select("project", F.posexplode(rows).alias("n", "r"))
    message = F.concat("r.label", F.when(F.col("r.status") == "PASS", " configured").otherwise(" not configured"))
    row = _row("sentinel", F.col("r.check_id"), F.col("r.target"), "INFO", F.col("r.status"), message,
               check_order("sentinel", 3, None, 0, F.col("n")))
    return _apply(found, [(None, row)])


# --- all together ------------------------------------------------------------------


def run_checks(tables: dict[str, DataFrame], tools: list[str] | None = None, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    """All checks in tool order, each input table read once per kind of work.

    ``tables``: projects, contracts, sources, topologies, topology_nodes,
    registry_fields, artifacts, manifests, manifest_entries, project_config;
    ``texts``, a ``text_stream``, takes the place of the sources' texts.
    """
    t = tables
    signals = t["sources"] if t.get("texts") is None else t["texts"]
    registry = chk_registry_exists(t["projects"], t["artifacts"])
    by_tool = {
        "pact": lambda: [
            contract_checks(t["contracts"]),
            source_checks(signals, pattern),
        ] + ([chk_pact_key_format(t["sources"], pattern, 1)] if re.compile(pattern).groups == 1 else []),
        "baton": lambda: [
            chk_topology_exists_valid(t["projects"], t["topologies"]),
            chk_topology_version(t["topologies"]),
            node_checks(t["topology_nodes"]),
            chk_global_sections(t["topologies"]),
        ],
        "ledger": lambda: [
            registry.where(F.col("tool") == "ledger"),
            chk_fields_classified(t["registry_fields"]),
            field_checks(t["registry_fields"]),
        ],
        "arbiter": lambda: [
            registry.where(F.col("tool") == "arbiter"),
            chk_access_graph(t["artifacts"]),
            chk_trust_ledger(t["artifacts"]),
        ],
        "sentinel": lambda: [
            chk_manifest_exists_valid(t["projects"], t["manifests"]),
            entry_checks(t["manifest_entries"]),
            chk_source_keys_in_manifest(signals, t["manifests"], t["manifest_entries"], pattern),
            chk_integrations_configured(t["project_config"], t["manifests"]),
        ],
    }
    chosen = [tool for tool in V.CHECK_TOOLS if not tools or tool in tools]
    return union_all([frame.select(*CHECK_COLUMNS) for tool in chosen for frame in by_tool[tool]()])
