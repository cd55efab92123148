"""Whole project trees on disk, through the reader, checks and controls."""

import os
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.control_table import packaged_controls
from fleetlens.operators import assertions as A, baseline as B, controls as C, discovery, report as R
from fleetlens.operators.checks import run_checks
from fleetlens.plans import posture
from fleetlens.sources.corpus import is_source_file
from fleetlens.sources import corpus as S

NOW = datetime.now(timezone.utc)
AS_OF = (NOW + timedelta(seconds=1)).strftime("%Y-%m-%d %H:%M:%S")
GOOD = "fields:\n  - name: email\n    classification: PII\n    annotations: [gdpr_erasable, encrypted_at_rest]\n    erasure_method: purge\n"


@pytest.fixture
def tree(spark, tmp_path):
    """Writes {path: text or bytes} and evaluates controls on it."""

    class Tree:
        root = str(tmp_path / "fleet")

        def write(self, files, project="p"):
            for path, text in files.items():
                full = os.path.join(self.root, project, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(text if isinstance(text, bytes) else text.encode())
            return self

        def settings(self, tags=(), public=(), index=(), controls=None, frameworks=None, **more):
            config = spark.createDataFrame(
                [("p", list(tags), list(public), None, None)],
                "project string, project_tags array<string>, public_route_patterns array<string>, pact_project_dir string, arbiter_registry string",
            )
            evidence = spark.createDataFrame([("p", k, v) for k, v in index], "project string, evidence_key string, path string")
            return posture.Settings(AS_OF, config, evidence, controls=controls, frameworks=frameworks, **more)

        def corpus(self):
            return S.corpus_read(spark, self.root)

        def verdicts(self, controls, **more):
            settings = self.settings(controls=controls, **more)
            found = C.evaluate_controls(posture.tables(self.corpus(), settings), controls, AS_OF)
            return {controls[r.control]["id"]: r for r in found.collect()}

        def verdict(self, detection, tier=None, applies=None, **more):
            one = {"framework": "f", "id": "X", "severity": "must", "detection": detection, "classification_tier": tier, "applicability": applies or {}}
            return self.verdicts([one], **more)["X"]

    return Tree()


OBLIGATION = {"method": "ledger_obligation", "tier": "PII", "required_annotation": "gdpr_erasable", "required_field_key": "erasure_method"}


def test_registry_obligation(tree):
    assert tree.write({".ledger/registry/user.yaml": GOOD}).verdict(OBLIGATION).verdict == "present"


def test_registry_annotation_objects_and_flags(tree):
    text = "fields:\n  - name: a\n    classification: pii\n    annotations: [{name: gdpr_erasable}, {name: encrypted_at_rest}]\n  - name: b\n    classification: PII\n    gdpr_erasable: true\n    erasure_method: x\n    encrypted_at_rest: false\n"
    tree.write({".ledger/user.yaml": text, ".ledger/broken.yaml": "a: [", ".ledger/list.yaml": "- 1", ".ledger/odd.yaml": "fields: 3"})
    r = tree.verdict(OBLIGATION)
    assert (r.verdict, r.uncovered, r.message) == ("partial", [".ledger/user.yaml:a"], "1 field(s) missing erasure_method")
    r = tree.verdict({"method": "ledger_tier_encrypted", "tier": "PII"})
    assert (r.verdict, r.uncovered) == ("partial", [".ledger/user.yaml:b"])


def test_registry_scope(tree):
    tree.write({".ledger/registry/a.yaml": "fields:\n  - {name: x, classification: AUTH}\n"})
    assert tree.verdict(OBLIGATION).verdict == "skipped"
    assert tree.verdict({**OBLIGATION, "tier": "auth"}).message == "no fields carry annotation gdpr_erasable"
    assert tree.verdict({"method": "ledger_tier_encrypted"}, tier="AUTH").verdict == "missing"
    assert tree.verdict({"method": "ledger_tier_encrypted"}, applies={"data_tiers": ["PII", "Financial"]}).message == "no Ledger fields for tier(s): financial, pii"


def test_registry_absent(tree):
    r = tree.write({"src/a.py": "x"}).verdict(OBLIGATION, applies={"requires_ledger_registry": True, "tags": ["t"]})
    assert (r.verdict, r.target, r.message) == ("skipped", "ledger", "control requires Ledger registry")
    r = tree.verdict(OBLIGATION, applies={"tags": ["b", "a"]}, tags=["a"])
    assert (r.verdict, r.target, r.message) == ("skipped", "X", "missing project tag(s): a, b")


def test_evidence_age(tree):
    tree.write({"docs/ropa.md": "x"})
    old = NOW.timestamp() - 10 * 86400
    os.utime(os.path.join(tree.root, "p/docs/ropa.md"), (old, old))
    doc = {"method": "evidence_doc", "evidence_path_key": "ropa"}
    r = tree.verdict({**doc, "max_age_days": 1}, index=[("ropa", "docs/ropa.md")])
    assert (r.verdict, r.message) == ("partial", "evidence document stale (10d old)")
    assert tree.verdict(doc, index=[("ropa", "docs/ropa.md")]).verdict == "present"
    assert tree.verdict(doc, index=[("ropa", "docs/none.md")]).message == "evidence document missing"
    assert tree.verdict(doc).message == "evidence path key missing from config"


def test_grep_globs(tree):
    tree.write({"src/app.py": "run()", "services/api/src/x.py": "TLS on", "tests/t.py": "store cvv", "root.py": "TLS"})
    assert tree.verdict({"method": "source_grep", "none_of": ["debug=True"]}).verdict == "present"
    r = tree.verdict({"method": "source_grep", "none_of": ["cvv"], "include_glob": "**/*", "exclude_glob": ["tests/*"]})
    assert (r.verdict, r.target, r.message) == ("present", "**/*", "forbidden patterns absent")
    r = tree.verdict({"method": "source_grep", "none_of": ["cvv", "^store"], "include_glob": "**/*"})
    assert (r.verdict, r.uncovered) == ("missing", ["tests/t.py:cvv", "tests/t.py:^store"])
    r = tree.verdict({"method": "source_grep", "any_of": ["TLS"], "include_glob": ["app/**", "services/*/src/**"]})
    assert (r.verdict, r.target, r.message) == ("present", "services/api/src/x.py", "matched TLS")
    r = tree.verdict({"method": "source_grep", "any_of": ["HSTS", "zz"], "include_glob": ["app/**", "x"]})
    assert (r.verdict, r.target, r.message) == ("missing", "app/**,x", "none of ['HSTS', 'zz'] found")
    assert tree.verdict({"method": "source_grep"}).verdict == "skipped"


def test_grep_ignores_caches_generated_and_binary(tree):
    files = [".pytest_cache/a", ".claude/b.md", "compliance/controls/x.yaml", "tests/compliance/t.py", ".terraform/p", "a/node_modules/x.js", "venv/y.py"]
    tree.write({f: "secret" for f in files} | {"src/blob.bin": b"secret\0x"})
    assert tree.verdict({"method": "source_grep", "any_of": ["secret"]}).verdict == "missing"
    tree.write({"src/late.txt": b"x" * 8192 + b"\0secret"})
    assert tree.verdict({"method": "source_grep", "any_of": ["secret"]}).verdict == "present"


def test_payment_scope(tree):
    tree.write({"docs/notes.md": "TLS audit MFA"})
    pci = [c for c in packaged_controls() if c["framework"] == "pcidss"]
    assert {r.verdict for r in tree.verdicts(pci).values()} == {"skipped"}
    found = tree.verdicts(pci, tags=["payment_data"])
    missing = {k for k, r in found.items() if r.verdict == "missing" and k != "PCIDSS-12-1-POLICY"}
    assert missing == {"PCIDSS-4-2-TRANSMISSION-ENCRYPTION", "PCIDSS-8-4-MFA", "PCIDSS-10-2-AUDIT-LOGGING"}


GUARDS = {"method": "route_guard", "guard_patterns": ["Depends"]}


def test_route_guard(tree):
    far = "\n" * 40
    tree.write({"src/api.py": f'@app.get("/health")\ndef h(): pass\n{far}@app.get("/secure")\ndef s(r):\n    return r.user_claims\n'})
    r = tree.verdict(GUARDS, public=["^/health$"])
    assert (r.verdict, r.message) == ("present", "2 route(s) have guard evidence")
    r = tree.verdict(GUARDS)
    assert (r.verdict, r.uncovered) == ("partial", ["GET /health (src/api.py:2)"])
    assert tree.verdict({**GUARDS, "exclude_path_patterns": ["health"]}).verdict == "present"


def test_route_guard_counts_excluded_routes(tree):
    tree.write({"src/a.py": '@app.get("/a")\ndef a(): pass\n@app.get("/b")\ndef b(): pass\n', "other/x.py": '@app.get("/c")\ndef c(): pass\n'})
    assert tree.verdict(GUARDS).verdict == "missing"
    assert tree.verdict(GUARDS, public=["/a"]).verdict == "partial"


def test_route_guard_without_routes(tree):
    assert tree.write({"src/a.py": "x = 1"}).verdict(GUARDS).verdict == "skipped"


def test_config_and_companion(tree):
    tree.write({"conf.yaml": "a:\n  b: true\n  c: {d: 4}\n", "bad.yaml": "k: [", ".ledger/x.yaml": "a: 1"})

    def config(**det):
        r = tree.verdict({"method": "config_present", **det})
        return r.verdict, r.message

    assert config(path="conf.yaml") == ("present", "config file present")
    assert config(path="none.yaml") == ("missing", "config file missing")
    assert config(path="conf.yaml", required_key="a.b", required_value=True) == ("present", "a.b present")
    assert config(path="conf.yaml", required_key="a.c.d", required_value=5) == ("missing", "a.c.d does not equal 5")
    assert config(path="conf.yaml", required_key="a.z") == ("missing", "required key a.z missing")
    assert config(path="bad.yaml", required_key="k") == ("present", "k present")
    r = tree.verdict({"method": "companion_config", "tool": "Ledger"})
    assert (r.verdict, r.target) == ("present", ".ledger")
    r = tree.verdict({"method": "companion_config", "tool": "vault"})
    assert (r.verdict, r.target, r.message) == ("missing", "vault", "vault companion config missing")


def test_checks_of_a_project(tree, spark):
    tree.write(
        {
            "contracts/a.yaml": "data_access: {rationale: 'reads the orders'}\nauthority: {}\n",
            "contracts/b.yaml": "data_access: {rationale: 5}",
            "contracts/c.yaml": "x: [",
            "src/a.py": "class A:\n    key = 'PACT:a:b'\n",
            "src/b.py": "def f(event_handler): pass",
            "baton.yaml": "version: 1.5\nnodes:\n  - {name: n, protocol: http}\nglobal: {audit_channel: 1}\n",
            ".ledger/registry/s.yaml": "fields:\n  - {name: a}\n  - {name: b}\n  - {name: c, classification: PII, gdpr_erasable: true, immutable: true, audit_field: true}\n",
            ".ledger/registry/empty.yaml": "fields: []",
            ".arbiter/registry/access_graph.json": "{}",
            "trust_ledger.json": "{",
            ".sentinel/manifest.json": '{"entries": [{"pact_key": "PACT:x:y", "contract_path": "c"}, 4]}',
        }
    )
    rows = posture.checks(tree.corpus(), tree.settings(frameworks=["none"], controls=packaged_controls()[:1]), None)
    got = [(r.tool, r.check_id, r.target, r.status) for r in rows.where("tool <> 'ccpa'").orderBy("ord").collect()]
    assert got == [
        ("pact", "contract_has_data_access", "contracts/a.yaml", "PASS"),
        ("pact", "contract_has_authority", "contracts/a.yaml", "PASS"),
        ("pact", "contract_has_data_access", "contracts/b.yaml", "PASS"),
        ("pact", "contract_has_authority", "contracts/b.yaml", "FAIL"),
        ("pact", "contract_valid_yaml", "contracts/c.yaml", "FAIL"),
        ("pact", "source_has_event_handler", "src/a.py", "FAIL"),
        ("pact", "source_has_pact_key", "src/b.py", "FAIL"),
        ("baton", "baton_yaml_version_current", "baton.yaml", "FAIL"),
        ("baton", "all_nodes_have_data_access", "node: n", "WARN"),
        ("baton", "all_nodes_have_authority_declared", "node: n", "WARN"),
        ("baton", "openapi_spec_present_for_http_nodes", "node: n", "WARN"),
        ("baton", "arbiter_endpoint_configured", "baton.yaml", "INFO"),
        ("baton", "ledger_endpoint_configured", "baton.yaml", "INFO"),
        ("ledger", "all_fields_have_classification", ".ledger/registry/empty.yaml", "PASS"),
        ("ledger", "all_fields_have_classification", ".ledger/registry/s.yaml", "FAIL"),
        ("ledger", "no_annotation_conflicts", ".ledger/registry/s.yaml:c", "FAIL"),
        ("ledger", "gdpr_erasable_has_erasure_method", ".ledger/registry/s.yaml:c", "WARN"),
        ("ledger", "audit_fields_have_retention_policy", ".ledger/registry/s.yaml:c", "WARN"),
        ("arbiter", "access_graph_exists", ".arbiter/registry/access_graph.json", "PASS"),
        ("arbiter", "trust_ledger_valid", "trust_ledger.json", "FAIL"),
        ("sentinel", "all_manifest_entries_have_test_path", "PACT:x:y", "FAIL"),
        ("sentinel", "all_manifest_entries_have_source_path", "PACT:x:y", "FAIL"),
        ("sentinel", "all_source_pact_keys_in_manifest", ".sentinel/manifest.json", "WARN"),
        ("sentinel", "pact_configured", "stack.pact_project_dir", "INFO"),
        ("sentinel", "arbiter_configured", "stack.arbiter_registry", "INFO"),
    ]


def test_job_writes_report_drafts_and_baseline(tree, spark, tmp_path):
    files = {"src/app.py": "# audit\nclass A:\n    def run(self): pass\n", ".ledger/registry/user.yaml": GOOD, "src/x.rb": "ENV['REDIS_URL']"}
    tree.write(files)
    out = str(tmp_path / "out")
    first = posture.run(tree.corpus(), tree.settings(), out, "one")
    assert first["scores"].count() > 0
    saved = spark.read.parquet(out + "/baseline_one")
    tree.write({"src/app.py": "class A:\n    def run(self): pass\n"})
    second = posture.run(tree.corpus(), tree.settings(), out, "two", saved)
    lines = {r.regression for r in second["regressions"].collect()}
    assert "HIPAA-164312-B-AUDIT: PASS -> FAIL" in lines
    assert any(re.match(r"score_pct: [\d.]+ -> [\d.]+$", x) for x in lines)
    assert spark.read.json(out + "/report_latest/scores").count() == 1
    tools = {r.tool for r in spark.read.json(out + "/drafts").select("tool").distinct().collect()}
    assert tools == {"ledger", "pact", "baton", "constrain"}


def test_recommendation_order(spark):
    rows = [
        ("p", "baton", "audit_channel_port_configured", "t", "WARN", "WARN", "m", 1),
        ("p", "pact", "contract_has_authority", "late", "FAIL", "FAIL", "m", 5),
        ("p", "pact", "contract_has_authority", "early", "FAIL", "FAIL", "m", 3),
        ("p", "x", "other", "t", "FAIL", "FAIL", "why", 4),
        ("p", "x", "other", "t", "WARN", "WARN", "no", 2),
        ("p", "x", "fine", "t", "FAIL", "PASS", "", 0),
    ]
    df = spark.createDataFrame(rows, "project string, tool string, check_id string, target string, severity string, status string, message string, ord int")
    log = R.check_log(df)
    summary = R.check_summary(log)
    got = [r.recommendation for r in R.recommendations(summary, log).orderBy("place").collect()]
    assert got == ["Add authority field to early", "Fix: other — why", "Configure audit_channel in baton.yaml global config"]
    score = R.score_overall(summary).first()
    assert (score.score_pass, score.score_warn, score.score_fail, score.total, score.score_pct) == (1, 2, 3, 6, 16.7)
    warned = summary.where("score_warn > 0 AND score_fail = 0")
    assert R.gate_decision(warned).first().failed is False
    assert R.gate_decision(warned, strict=True).first().failed is True
    assert {r.check_id: r.status for r in B.baseline_snapshot(summary).collect()}["other"] == "FAIL"
    idle = spark.createDataFrame([("p",), ("idle",)], "project string")
    assert {r.project: r.score_pct for r in R.score_overall(summary, idle).collect()} == {"p": 16.7, "idle": 100.0}
    # partial summaries add up
    halves = [R.check_summary(log.where(f"seq % 2 = {k}")) for k in (0, 1)]
    assert R.score_by_tool(halves[0].unionByName(halves[1])).orderBy("tool").collect() == R.score_by_tool(summary).orderBy("tool").collect()


def test_texts_are_read_once(tree, spark):
    """Checks and controls on the staged stream give the rows they give on texts."""
    tree.write(
        {
            "src/app.py": "# audit\nfrom fastapi import APIRouter\nrouter = APIRouter()\nclass A:\n    def run(self, event_handler): pass\n@router.get('/x')\ndef x(): pass\n",
            "src/b.ts": "app.get('/y', (req) => 1)\nconst k = 'PACT:a1:b'",
            "docs/a.md": "webauthn login\ncvv",
            "src/broken.py": "def (",
        }
    )
    inputs = posture.tables(tree.corpus(), tree.settings())
    plain = run_checks(inputs).unionByName(C.run_compliance(inputs, AS_OF))
    inputs["texts"] = C.text_stream(inputs["corpus"], is_source_file())
    streamed = run_checks(inputs).unionByName(C.run_compliance(inputs, AS_OF))
    assert sorted(map(str, plain.collect())) == sorted(map(str, streamed.collect()))
    union = discovery.discovery_union(inputs["sources"])
    facts = discovery.discover(inputs["sources"], staged=True)
    assert union.count() == sum(f.count() for f in facts.values()) > 0
    plan = union._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan ") == 1


def test_assertions_name_the_misses(tree, spark):
    tree.write({".ledger/a.yaml": "fields:\n  - {name: x, classification: PII, gdpr_erasable: true}\n  - {name: y, classification: PII}\n"})
    fields = posture.tables(tree.corpus(), tree.settings())["registry_fields"]
    assert [r.name for r in A.companion_field_misses(fields, "gdpr_erasable", "erasure_method", "PII").collect()] == ["x"]
    assert sorted(r.name for r in A.tier_encrypted_misses(fields, "pii").collect()) == ["x", "y"]


def test_controls_override(spark):
    base = C.controls_table(spark)
    own = [{**packaged_controls()[18], "title": "Ours", "severity": "should"}, {**packaged_controls()[0], "id": "NEW-1", "framework": "GDPR"}]
    merged = C.controls_list(C.controls_merge(base, C.controls_table(spark, own), ["gdpr"]))
    assert [c["id"] for c in merged][:2] == ["GDPR-ART17-ERASURE", "GDPR-ART32-ENCRYPTION"]
    assert (merged[0]["title"], merged[0]["severity"], merged[-1]["id"], len(merged)) == ("Ours", "should", "NEW-1", 7)
    assert len(packaged_controls()) == 49
    assert base.where(F.col("framework") == "pcidss").count() == 7


def test_projects_override_one_control_differently(spark):
    grep = lambda *p: {"method": "source_grep", "any_of": list(p), "include_glob": "**/*"}
    make = lambda i, d, title: {"framework": "F", "id": i, "detection": d, "title": title}
    base = C.controls_table(spark, [make("A", grep("audit"), "base"), make("B", grep("tls"), "base")])
    own = C.controls_table(spark, [make("A", grep("journal"), "p"), make("A", grep("ledger"), "q"), make("C", grep("own"), "q")])
    own = own.withColumn("project", F.when(F.col("title") == "p", "p").otherwise("q"))
    merged = C.controls_merge(base, own)
    assert {(r.project, r.id, r.title, r.layer) for r in merged.collect()} == {(None, "A", "base", 0), (None, "B", "base", 0), ("p", "A", "p", 0), ("q", "A", "q", 0), ("q", "C", "q", 1)}
    controls = C.controls_list(merged)
    text = "audit ledger own"
    corpus = spark.createDataFrame([(p, "src/a.py", text, "python") for p in "pqr"], "project string, path string, content string, lang string")
    none = spark.createDataFrame([], "project string, schema_path string, pos long, name string, classification string, annotations array<string>, keys array<string>, is_dict boolean")
    config = spark.createDataFrame([(p, [], []) for p in "pqr"], "project string, project_tags array<string>, public_route_patterns array<string>")
    tables = {"projects": corpus.select("project"), "corpus": corpus, "sources": corpus, "registry_fields": none, "registries": none.select("project"), "project_config": config}
    want = {("p", "A", "missing"), ("p", "B", "missing"), ("q", "A", "present"), ("q", "B", "missing"), ("q", "C", "present"), ("r", "A", "present"), ("r", "B", "missing")}
    for more in ({}, {"texts": C.text_stream(corpus, is_source_file(), controls)}):
        rows = C.evaluate_controls(tables | more, controls, AS_OF).collect()
        assert {(r.project, controls[r.control]["id"], r.verdict) for r in rows} == want and len(rows) == len(want)
    checks = C.verdict_to_check(C.evaluate_controls(tables, controls, AS_OF), controls)
    assert {r.status for r in checks.where("project = 'q' AND check_id = 'A'").collect()} == {"PASS"}


def test_streaming_scan(spark, tmp_path, corpus):
    from fleetlens.operators import code_scan, line_scan
    from fleetlens.streaming.scan_stream import corpus_stream, scan_to

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = ["project", "path", "lang", "content"]
    scanner = lambda c: line_scan.scan_pact_keys(c).select("path", "key")
    for i, text in enumerate(["PACT:a:b\nPACT:c:d", "none", "x PACT:e:f"]):
        corpus({f"f{i}.py": text}).select(*columns).write.mode("append").parquet(folder)
        scan_to(corpus_stream(spark, folder), scanner, out, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["PACT:a:b", "PACT:c:d", "PACT:e:f"]
    corpus({"r.rb": "class A < ApplicationRecord"}).select(*columns).write.mode("append").parquet(folder)
    models = lambda c: code_scan.models(c, ["rb_activerecord_models"]).select("name")
    scan_to(corpus_stream(spark, folder), models, str(tmp_path / "m"), str(tmp_path / "ck2")).awaitTermination(120)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["A"]
