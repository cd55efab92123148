"""The whole job: land the corpus, check, judge, report, draft."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from fleetlens import values as V
from fleetlens.operators import baseline as B, controls as C, discovery, drafts as D
from fleetlens.operators.checks import run_checks
from fleetlens.operators.report import check_log, check_summary, score_by_tool
from fleetlens.session import stage
from fleetlens.sources import documents as S
from fleetlens.sources.corpus import corpus_language, is_source_file, source_files
from fleetlens.sources.sinks import baseline_sink, draft_sink, report_sink


@dataclass
class Settings:
    """What a fleet may configure; one row per project where it differs by project."""

    as_of: str
    config: DataFrame  # project, project_tags, public_route_patterns, pact_project_dir, arbiter_registry
    evidence_index: DataFrame  # project, evidence_key, path
    source_dirs: list[str] = field(default_factory=lambda: list(V.SOURCE_DIRS))
    languages: list[str] | None = None
    exclude: list[str] | None = None
    key_format: str = V.PACT_KEY_FORMAT
    frameworks: list[str] | None = None
    controls: list[dict] | None = None


def land(corpus: DataFrame) -> DataFrame:
    """The corpus as parquet by language, so that a scan reads only its files."""
    tagged = corpus if "lang" in corpus.columns else corpus_language(corpus, keep_unknown=True)
    return stage(tagged.drop("raw"), "corpus", ["lang"])


def tables(corpus: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Inputs of checks and controls from a landed corpus of whole projects."""
    projects = corpus.select("project").distinct()
    registry = S.located(corpus, S.REGISTRY_PLACES, suffix="")
    fields = S.registry_read(registry.where(F.col("path").endswith(".yaml")))
    topologies, nodes = S.topology_read(S.located(corpus, S.TOPOLOGY_PLACES, suffix=""))
    manifests, entries = S.manifest_read(S.located(corpus, S.MANIFEST_PLACES, suffix=""))
    own = settings.config.select("project", F.col("pact_project_dir").alias("place"))
    contracts = S.contracts_read(S.located(corpus, S.CONTRACT_PLACES, own))
    return {
        "projects": projects,
        "corpus": corpus.where(~F.coalesce("is_binary", F.lit(False))) if "is_binary" in corpus.columns else corpus,
        "sources": source_files(corpus, settings.source_dirs, settings.languages, settings.exclude),
        "contracts": contracts,
        "topologies": topologies,
        "topology_nodes": nodes,
        "registry_fields": fields,
        "registries": registry.select("project").distinct(),
        "artifacts": artifacts(corpus, registry),
        "manifests": manifests,
        "manifest_entries": entries,
        "project_config": settings.config,
        "evidence_index": settings.evidence_index,
        "file_meta": corpus.select("project", "path", "mtime"),
        "config_values": S.config_values(corpus.where(F.col("path").rlike(r"\.(ya?ml|json)$"))),
    }


def artifacts(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry folders and JSON artifacts with their place of discovery."""
    none = F.lit(None).cast("string")
    arbiter = corpus.where(F.col("path").startswith(".arbiter/")).select("project").distinct()
    held = [
        registry.select("project").distinct().select("project", F.lit("registry").alias("kind"), F.lit(0).alias("location_rank"), F.lit(".ledger").alias("path"), none.alias("body")),
        arbiter.select("project", F.lit("arbiter").alias("kind"), F.lit(0).alias("location_rank"), F.lit(".arbiter").alias("path"), none.alias("body")),
    ]
    for name in ("access_graph", "trust_ledger"):
        places = F.create_map(*[F.lit(x) for i, p in enumerate([f".arbiter/registry/{name}.json", f".arbiter/{name}.json", f"{name}.json"]) for x in (p, i)])
        found = corpus.where(places[F.col("path")].isNotNull())
        held.append(found.select("project", F.lit(name).alias("kind"), places[F.col("path")].alias("location_rank"), "path", F.col("content").alias("body")))
    out = held[0]
    for frame in held[1:]:
        out = out.unionByName(frame)
    return out


def checks(corpus: DataFrame, settings: Settings, tools: list[str] | None = None) -> DataFrame:
    """Every check row of every project; the texts are read once."""
    inputs = tables(corpus, settings)
    wanted = is_source_file(settings.source_dirs, settings.languages, settings.exclude)
    chosen = C.chosen_controls(settings.controls, settings.frameworks)
    inputs["texts"] = stage(C.text_stream(inputs["corpus"], wanted, chosen, None, settings.key_format), "texts")
    compliance = C.run_compliance(inputs, settings.as_of, settings.controls, settings.frameworks)
    return run_checks(inputs, tools, settings.key_format).unionByName(compliance)


def draft_tables(facts: dict[str, DataFrame], projects: DataFrame) -> DataFrame:
    """All drafts as (project, tool, artifact, body as JSON)."""
    by_artifact = {
        ("ledger", "schemas"): D.draft_schemas(facts["models"]),
        ("ledger", "backends"): D.draft_backends(facts["models"]),
        ("ledger", "connection_hints"): D.draft_connection_hints(facts["env_vars"]),
        ("pact", "contracts"): D.draft_contracts(facts["components"]),
        ("baton", "nodes"): D.draft_topology_nodes(facts["routes"], facts["components"]),
        ("baton", "edges"): D.draft_topology_edges(facts["routes"], facts["components"]),
        ("constrain", "component_map"): D.draft_component_map(facts["components"]),
        ("constrain", "constraints"): D.draft_constraints(facts["sensitive_fields"]),
        ("constrain", "trust_policy"): D.draft_trust_policy(projects, facts["sensitive_fields"]),
        ("constrain", "schema_hints"): D.draft_schema_hints(facts["env_vars"], facts["sensitive_fields"]),
        ("sentinel", "manifest"): D.draft_manifest(facts["pact_keys"]),
    }
    out = None
    for (tool, artifact), frame in by_artifact.items():
        body = F.to_json(F.struct(*[c for c in frame.columns if c != "project"]))
        rows = frame.select("project", F.lit(tool).alias("tool"), F.lit(artifact).alias("artifact"), body.alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run(corpus: DataFrame, settings: Settings, folder: str, stamp: str, baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """One pass of the job; results lie below ``folder``.

    The corpus, the facts, what checks and controls need of the texts, and the
    check rows are each written once and read back: texts are read once for
    the discovery and once for checks and controls, and a lost executor never
    forces an earlier step to run again.
    """
    landed = land(corpus)
    facts = discovery.discover(source_files(landed, settings.source_dirs, settings.languages, settings.exclude), staged=True)
    rows = check_log(checks(landed, settings))
    summary = stage(check_summary(rows), "summary")
    report_sink(rows, summary, folder, stamp)
    draft_sink(draft_tables(facts, landed.select("project").distinct()), posixpath.join(folder, "drafts"))
    baseline_sink(B.baseline_snapshot(summary), posixpath.join(folder, f"baseline_{stamp}"))
    out = {"checks": rows, "scores": score_by_tool(summary), **facts}
    if baseline is not None:
        out["regressions"] = B.verify_baseline(baseline, summary)
    return out
