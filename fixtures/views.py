"""Derived input tables, one SQL text each for Spark and DuckDB.

The given tables hold prose and star-schema rows.  These views turn every row
of them into the inputs the operators read: source files, registries,
contracts, topologies, manifests, evidence and so on.  Project ``hub`` gets a
third of all rows on purpose, so every query meets a skewed key.

List columns are built as ``split('a,b', ',')``, which both engines accept.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import functions as F

from fleetlens.session import spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"


def project(key: str) -> str:
    return (
        f"CASE WHEN {key} % 3 = 0 THEN 'hub' ELSE concat('src', CAST({key} % 20 AS STRING), '_',"
        f" CAST(CAST(floor({key} / 200.0) AS BIGINT) AS STRING)) END"
    )


def _file(*lines: str) -> str:
    """SQL expression for text lines; a line is a template with {d} for the key.

    A line may be a pair (condition, template): it is left out when the
    condition is false.
    """
    parts = []
    for line in lines:
        cond, text = line if isinstance(line, tuple) else (None, line)
        pieces = re.split(r"(\{d\})", text)
        args = [("d" if p == "{d}" else "'" + p.replace("'", "''") + "'") for p in pieces if p] + ["chr(10)"]
        sql = "concat(" + ", ".join(args) + ")"
        parts.append(f"CASE WHEN {cond} THEN {sql} ELSE '' END" if cond else sql)
    return "concat(\n      " + ",\n      ".join(parts) + ")"


_GUARDED = "doc_id % 5 <> 0"
_SIGNALS = [
    ("doc_id % 7 = 1", "{c} audit logging of every request"),
    ("doc_id % 11 = 1", "{c} served over https://host{d}.example with TLS"),
    ("doc_id % 13 = 1", "{c} erasure and data export, opt-out, do not sell"),
    ("doc_id % 17 = 1", "{c} webauthn login, checksum and monitor, data minimization"),
    ("doc_id % 53 = 0", "{c} store cvv for later"),
    ("doc_id % 10 = 3", "{c} PACT:note{d}:seen and PACT:note{d}:again"),
]


def _signals(comment: str) -> list[tuple[str, str]]:
    return [(cond, text.replace("{c}", comment)) for cond, text in _SIGNALS]


PY_SERVICE = _file(
    "import os",
    (_GUARDED, "from fastapi import APIRouter, Depends"),
    ("doc_id % 5 = 0", "from fastapi import APIRouter"),
    *_signals("#"),
    ("doc_id % 24 <> 0", 'KEY = "PACT:svc{d}:handle"'),
    "router = APIRouter()",
    "",
    "",
    "class Service{d}:",
    ("doc_id % 16 = 0", "    def __init__(self, store{d}, service{d}, database):"),
    ("doc_id % 16 = 0", "        self.store = store{d}"),
    "    def handle(self, email, event_handler=None):",
    ("doc_id % 32 = 0", "        log_handler = None"),
    '        url = os.environ["DATABASE_URL"]',
    "        cache = os.getenv('REDIS_URL')",
    '        again = os.environ.get("DATABASE_URL")',
    '        other = os.environ.get("HOME_DIR")',
    "        return Email, email, password",
    "",
    "    def _hidden(self):",
    "        return None",
    "",
    "",
    '@router.get("/svc/{d}")',
    (_GUARDED, "def read_{d}(user=Depends(auth)):"),
    ("doc_id % 5 = 0", "def read_{d}():"),
    "    return None",
    "",
    "",
    '@app.route("/svc/{d}/items")',
    "async def write_{d}():",
    "    return None",
    "",
)

PY_ORM = _file(
    "from sqlalchemy import Column, Integer, String",
    *_signals("#"),
    ("doc_id % 3 = 0", 'PACT = "PACT:orm{d}:save"'),
    "",
    ("doc_id % 40 = 1", "class Model{d}(Base):"),
    ("doc_id % 40 = 9", "class Model{d}(db.Model):"),
    ("doc_id % 40 = 17", "class Model{d}(models.Model):"),
    ("doc_id % 40 = 25", "class Model{d}(BaseModel):"),
    ("doc_id % 40 = 33", "class Model{d}(Plain{d}):"),
    '    __tablename__ = "t{d}"',
    "    id = Column(Integer, primary_key=True)",
    "    email = db.Column(String(120))",
    "    note: Mapped[str] = mapped_column()",
    "    card_number: str",
    "    owner = Column()",
    "    size = 3",
    "",
    "    def save(self, session):",
    "        return session",
    "",
    "    async def load(self):",
    "        return None",
    "",
)

TS = _file(
    'import { Entity } from "typeorm";',
    *_signals("//"),
    '@Entity("tbl_{d}")',
    "export class Ent{d} {",
    '  @Column({ type: "varchar" })',
    "  name{d}: string;",
    "  @Column()",
    "  password: string;",
    "}",
    ("doc_id % 3 = 0", "@Entity()"),
    ("doc_id % 3 = 0", "class Second{d} {"),
    ("doc_id % 3 = 0", "  @Column({ type: 'int' })"),
    ("doc_id % 3 = 0", "  token: number;"),
    ("doc_id % 3 = 0", "}"),
    ("doc_id % 3 = 1", "@Entity('loose_{d}')"),
    'export const users{d} = pgTable("users_{d}", {});',
    'const M{d} = mongoose.model("Doc{d}", schema); const N{d} = model(\'Sub{d}\');',
    'sequelize.define("Seq{d}", {});',
    "Inv{d}.init({",
    "});",
    (_GUARDED, 'app.get("/ts/{d}", require_auth);'),
    ("doc_id % 5 = 0", 'app.get("/ts/{d}", open);'),
    "Router.POST('/health/{d}', handler);",
    "const key = process.env.MONGO_URI;",
)

JS = _file(
    'const express = require("express");',
    *_signals("//"),
    "router.get('/js/{d}', handler);",
    "class Widget{d} {",
    "}",
    "module.exports = Widget{d};",
    "module.exports = helper{d};",
    "module.exports = helper{d};",
    ("doc_id % 3 = 0", "module.exports = class Extra{d} {};"),
    "const bucket = process.env.S3_BUCKET; const address = 1;",
)

RB = _file(
    *_signals("#"),
    "class User{d} < ApplicationRecord",
    "end",
    "class Item{d} < Sequel::Model",
    "end",
    "class Helper{d}",
    "  def url",
    "    ENV['MYSQL_HOST'] + ENV[\"AMQP_URL\"]",
    "  end",
    "end",
    "get '/rb/{d}', to: 'x#y'",
    "resources 'items_{d}'",
)

GO = _file(
    "package main",
    *_signals("//"),
    "type User{d} struct {",
    '\tID int `gorm:"primaryKey"`',
    '\tEmail string `gorm:"column:email" db:"mail"`',
    "\tprivate string",
    "}",
    "type Row{d} struct {",
    '\tName string `db:"name"`',
    "}",
    "type Plain{d} struct {",
    "\tSize int",
    "}",
    "type hidden{d} struct {",
    "\tx int",
    "}",
    "func main() {",
    '\tr.GET("/go/{d}", h)',
    '\tmux.HandleFunc("/go/{d}/h", h)',
    '\tos.Getenv("KAFKA_BROKER")',
    "}",
)

JAVA = _file(
    *_signals("//"),
    ("doc_id % 16 = 6", "@Entity"),
    '@Table(name = "acct_{d}")',
    "public class Account{d} {",
    '    @Column(name = "email_addr")',
    "    private String email;",
    '    @Column(name = "bal", nullable = false)',
    "    private BigDecimal balance;",
    "}",
    "class Other{d} {",
    "}",
    '@RequestMapping("/java/{d}")',
    "public class Ctl{d} {",
    '    @GetMapping(value = "/java/{d}/x")',
    '    String url = System.getenv("ELASTICSEARCH_URL");',
    "}",
)

PRISMA = _file(
    *_signals("//"),
    "model Person{d} {",
    "  id Int @id",
    "  email String?",
    "  tags String[]",
    "  @@index([email])",
    "  // comment only",
    "}",
    "",
    "model Post{d} {",
    "  id Int",
    "}",
)

_EXT = ["py", "py", "ts", "js", "rb", "go", "java", "prisma"]
_LANG = ["python", "python", "typescript", "javascript", "ruby", "go", "java", "prisma"]
_BODY = [PY_SERVICE, PY_ORM, TS, JS, RB, GO, JAVA, PRISMA]
_STEM = """CASE WHEN doc_id % 8 = 4 THEN CASE WHEN doc_id % 16 = 4 THEN concat('routes_', d) ELSE concat('f', d) END
      WHEN doc_id % 9 = 1 THEN concat('F', d, '_controller') WHEN doc_id % 9 = 2 THEN concat('f-', d, '_handler')
      WHEN doc_id % 9 = 3 THEN concat('svc', CAST(doc_id % 30 AS STRING), '_api') ELSE concat('f', d) END"""
_FOLDER = """CASE WHEN doc_id % 9 = 3 THEN concat('src/g', d, '/') WHEN doc_id % 37 = 0 THEN 'src/node_modules/pkg/' WHEN doc_id % 41 = 0 THEN 'docs/'
      WHEN doc_id % 43 = 0 THEN 'services/api/src/' WHEN doc_id % 47 = 0 THEN 'src/.terraform/'
      WHEN doc_id % 59 = 0 THEN 'tests/compliance/' WHEN doc_id % 19 = 0 THEN 'src/config/' ELSE concat('src/m', CAST(doc_id % 7 AS STRING), '/') END"""


def _by_lang(values: list[str]) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


VIEWS: dict[str, str] = {}

# one source file per document: a header in one of eight languages, then the whole text as comment lines
VIEWS["code_docs"] = f"""
SELECT doc_id, CAST(doc_id AS STRING) AS d, {project('doc_id')} AS project, coalesce(text, '') AS text FROM documents"""
VIEWS["code_corpus"] = f"""
SELECT project,
  concat({_FOLDER}, {_STEM}, '.', {_by_lang([f"'{e}'" for e in _EXT])}) AS path,
  {_by_lang([f"'{x}'" for x in _LANG])} AS lang,
  concat({_by_lang(_BODY)},
    {_by_lang(["'# '"] * 2 + ["'// '"] * 2 + ["'# '"] + ["'// '"] * 3)},
    replace(replace(text, chr(13), ' '), chr(10), {_by_lang(["concat(chr(10), '# ')"] * 2 + ["concat(chr(10), '// ')"] * 2 + ["concat(chr(10), '# ')"] + ["concat(chr(10), '// ')"] * 3)}),
    chr(10)) AS content
FROM code_docs"""
VIEWS["file_meta"] = """
SELECT project, concat('evidence/e', CAST(doc_id % 60 AS STRING), '.md') AS path,
  max(CAST(DATE '2026-01-01' - CAST(doc_id % 500 AS INTEGER) AS TIMESTAMP)) AS mtime
FROM code_docs GROUP BY 1, 2"""

VIEWS["registry_fields"] = f"""
SELECT {project('c_custkey')} AS project,
  concat('.ledger/registry/s', CAST(c_nationkey AS STRING), '.yaml') AS schema_path,
  c_custkey AS pos,
  concat('field', CAST(c_custkey AS STRING)) AS name,
  CASE c_custkey % 6 WHEN 1 THEN 'PII' WHEN 2 THEN 'FINANCIAL' WHEN 3 THEN 'AUTH' WHEN 4 THEN 'COMPLIANCE' WHEN 5 THEN 'pii' END AS classification,
  split(concat_ws(',', CASE WHEN c_custkey % 4 <> 1 OR c_nationkey < 5 THEN 'encrypted_at_rest' END,
    CASE WHEN c_custkey % 5 < 2 THEN 'gdpr_erasable' END, CASE WHEN c_custkey % 10 = 1 THEN 'immutable' END,
    CASE WHEN c_custkey % 7 = 0 THEN 'audit_field' END), ',') AS annotations,
  split(concat_ws(',', 'name', CASE WHEN c_custkey % 6 <> 0 THEN 'classification' END,
    CASE WHEN c_custkey % 15 <> 1 THEN 'erasure_method' END, CASE WHEN c_custkey % 14 = 0 THEN 'retention_policy' END), ',') AS keys,
  c_custkey % 50 <> 49 AS is_dict
FROM customer"""

VIEWS["contracts"] = f"""
SELECT {project('s_suppkey')} AS project,
  concat('contracts/c', CAST(s_suppkey AS STRING), '.yaml') AS path,
  s_suppkey % 11 <> 5 AS parse_ok,
  split(concat_ws(',', 'id', CASE WHEN s_suppkey % 4 <> 0 THEN 'data_access' END, CASE WHEN s_suppkey % 5 <> 0 THEN 'authority' END), ',') AS keys,
  CASE s_suppkey % 6 WHEN 0 THEN '  short  ' WHEN 1 THEN '' WHEN 2 THEN 'exactly 10' WHEN 3 THEN 'reads the order table nightly' WHEN 4 THEN '         x         ' END AS rationale
FROM supplier"""
VIEWS["topologies"] = f"""
SELECT {project('s_suppkey')} AS project, min(s_suppkey) AS first_key, 'baton.yaml' AS path,
  min(s_suppkey) % 9 <> 4 AS parse_ok,
  CASE min(s_suppkey) % 5 WHEN 0 THEN '1.0' WHEN 1 THEN '1.10' WHEN 2 THEN '2.0' WHEN 3 THEN '2.0.1' ELSE 'beta' END AS version,
  split(concat_ws(',', 'name', CASE WHEN min(s_suppkey) % 2 = 0 THEN 'arbiter' END, CASE WHEN min(s_suppkey) % 3 = 0 THEN 'ledger' END,
    CASE WHEN min(s_suppkey) % 4 = 0 THEN 'audit_channel' END), ',') AS global_keys
FROM supplier WHERE s_suppkey % 20 <> 13 GROUP BY 1"""
VIEWS["topology_nodes"] = f"""
SELECT n.project, n.pos, n.name, n.protocol, n.keys FROM (
  SELECT {project('s_suppkey')} AS project, s_suppkey AS pos, concat('node', CAST(s_suppkey AS STRING)) AS name,
    CASE s_suppkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'grpc' ELSE 'http' END AS protocol,
    split(concat_ws(',', 'name', CASE WHEN s_suppkey % 3 <> 1 THEN 'data_access' END, CASE WHEN s_suppkey % 7 <> 2 THEN 'authority' END,
      CASE WHEN s_suppkey % 5 = 0 THEN 'openapi_spec' END), ',') AS keys FROM supplier) n
JOIN topologies t ON t.project = n.project AND t.parse_ok"""

VIEWS["projects"] = f"""
SELECT project, CAST(length(project) + max(doc_id) AS BIGINT) AS pn FROM code_docs GROUP BY 1"""
VIEWS["manifests"] = """
SELECT project, '.sentinel/manifest.json' AS path, pn % 7 <> 3 AS parse_ok FROM projects WHERE pn % 6 <> 5"""
VIEWS["manifest_entries"] = """
SELECT c.project, c.doc_id AS pos,
  CASE WHEN doc_id % 8 = 0 THEN concat('PACT:svc', d, ':handle') WHEN doc_id % 29 <> 2 THEN concat('PACT:orm', d, ':save') END AS pact_key,
  split(concat_ws(',', 'pact_key', CASE WHEN doc_id % 4 = 1 THEN 'source_path' END, CASE WHEN doc_id % 6 = 2 THEN 'source_file' END), ',') AS keys,
  CASE WHEN doc_id % 3 <> 1 THEN concat('contracts/', d, '.yaml') END AS contract_path,
  CASE WHEN doc_id % 5 <> 3 THEN concat('tests/', d, '.py') END AS test_path
FROM code_docs c JOIN manifests m ON m.project = c.project AND m.parse_ok WHERE doc_id % 48 <> 8"""
VIEWS["project_config"] = """
SELECT project, pn,
  split(concat_ws(',', 'base', CASE WHEN pn % 2 = 0 THEN 'payment_data' END, CASE WHEN pn % 3 = 0 THEN 'high_risk_processing' END), ',') AS project_tags,
  split(concat_ws(',', '^/none$', CASE WHEN pn % 4 <> 1 THEN '^/health' END), ',') AS public_route_patterns,
  CASE WHEN pn % 5 < 3 THEN 'contracts' END AS pact_project_dir,
  CASE WHEN pn % 4 < 2 THEN '.arbiter/registry' END AS arbiter_registry
FROM projects"""
# JSON artifacts: one or two candidate places per project and kind
VIEWS["artifacts"] = """
SELECT project, kind, location_rank, path, body FROM (
  SELECT project, 'arbiter' AS kind, 0 AS location_rank, '.arbiter/registry' AS path, CAST(NULL AS STRING) AS body FROM projects WHERE pn % 5 <> 2
  UNION ALL
  SELECT project, 'registry', 0, '.ledger/registry', CAST(NULL AS STRING) FROM projects WHERE pn % 8 <> 5
  UNION ALL
  SELECT project, 'access_graph', 0, '.arbiter/registry/access_graph.json', CASE WHEN pn % 4 = 1 THEN '{"nodes": [' ELSE '{"nodes": []}' END FROM projects WHERE pn % 3 = 0
  UNION ALL
  SELECT project, 'access_graph', 1, 'access_graph.json', CASE WHEN pn % 4 = 0 THEN '{"nodes": 1' ELSE '[1, 2.5, null]' END FROM projects WHERE pn % 2 = 0
  UNION ALL
  SELECT project, 'trust_ledger', 0, '.arbiter/registry/trust_ledger.json', '{"a": 1}' FROM projects WHERE pn % 4 = 2
  UNION ALL
  SELECT project, 'trust_ledger', 1, 'trust_ledger.json', CASE WHEN pn % 7 = 0 THEN 'nope' ELSE '{}' END FROM projects WHERE pn % 3 = 1
) a"""
VIEWS["evidence_index_lines"] = """
SELECT project, doc_id AS pos, CASE doc_id % 12
    WHEN 0 THEN 'no table row' WHEN 1 THEN '| --- | --- |' WHEN 2 THEN '| only |'
    ELSE concat('| `', CASE (doc_id % 16) WHEN 0 THEN 'ropa' WHEN 1 THEN 'DPIA' WHEN 2 THEN 'Notice at collection' WHEN 3 THEN 'retention policy'
      WHEN 4 THEN 'Personnel security' WHEN 5 THEN 'physical_security' WHEN 6 THEN 'account management' WHEN 7 THEN 'POAM'
      WHEN 8 THEN 'hipaa risk analysis' WHEN 9 THEN 'information security policy' WHEN 10 THEN 'disaster recovery' WHEN 11 THEN 'vulnerability management'
      WHEN 12 THEN 'pci security policy' WHEN 13 THEN 'change management' WHEN 14 THEN 'risk register' ELSE 'privacy notice' END,
      '` | owner | `', CASE WHEN doc_id % 31 = 30 THEN 'nowhere' ELSE concat('evidence/e', CAST(doc_id % 61 AS STRING), '.md') END, '` |') END AS text
FROM code_docs"""
# the index of a project: its lines in one markdown file each thousand documents
VIEWS["evidence_index"] = """
SELECT project, lower(replace(key, ' ', '_')) AS evidence_key, max_by(value, pos) AS path FROM (
  SELECT project, pos, split_part(text, '`', 2) AS key, split_part(text, '`', 4) AS value
  FROM evidence_index_lines WHERE text LIKE '| `%') e
WHERE key <> '' AND (value LIKE '%/%' OR value LIKE '%.md') GROUP BY 1, 2"""

VIEWS["openapi_specs"] = f"""
SELECT {project('page_id')} AS project, concat('file://', url, '#', CAST(page_id AS STRING)) AS source,
  concat('{{"openapi": "3.0.0", "info": {{', CASE WHEN page_id % 6 <> 0 THEN concat('"title": "Api ', CAST(page_id AS STRING), '", ') ELSE '' END,
    '"version": "1.', CAST(page_id % 4 AS STRING), '"}}, "paths": {{"/p/', CAST(page_id AS STRING), '": {{',
    '"get": {{"summary": "s"', CASE WHEN page_id % 3 = 0 THEN concat(', "operationId": "read', CAST(page_id AS STRING), '"') ELSE '' END, '}}, ',
    '"parameters": [{{"name": "id"}}], "x-internal": {{"a": 1}}, "post": {{"operationId": "write', CAST(page_id AS STRING), '"}}, "summary": "text"}}, ',
    CASE WHEN page_id % 4 = 1 THEN '"/broken": "text", ' ELSE '' END,
    '"/q/', CAST(page_id AS STRING), '": {{"delete": {{}}}}}}}}') AS spec
FROM pages"""

VIEWS["json_documents"] = """
SELECT concat(CASE WHEN user_id % 10 = 9 THEN 'system.' ELSE '' END, event_type, '_', CAST(user_id % 4 AS STRING)) AS collection,
  event_id AS seq,
  concat('{"id": ', CAST(event_id AS STRING), ', "kind": "', event_type, '", "value": ',
    CASE event_id % 4 WHEN 0 THEN '1.5' WHEN 1 THEN '7' WHEN 2 THEN 'null' ELSE '"n/a"' END,
    ', "ok": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ', "tags": [1, 2], "props": ', props,
    CASE WHEN event_id % 5 = 0 THEN ', "nested": {"deep": {"x": 1}}' ELSE '' END, '}') AS doc
FROM events"""
VIEWS["cache_keys"] = """
SELECT concat('cache', CAST(user_id % 3 AS STRING)) AS backend, event_id AS seq,
  CASE event_id % 5 WHEN 0 THEN concat('user:', CAST(user_id AS STRING), ':', event_type)
    WHEN 1 THEN concat('obj:', substring(md5(CAST(event_id AS STRING)), 1, 24))
    WHEN 2 THEN concat('sess:', substring(md5(CAST(event_id AS STRING)), 1, 8), '-', substring(md5(event_type), 1, 27))
    WHEN 3 THEN concat(event_type, ':', CAST(user_id % 90 AS STRING), 'x')
    ELSE concat('cfg', CAST(user_id % 70 AS STRING), ':', event_type) END AS key
FROM events"""
VIEWS["catalog_columns"] = """
SELECT concat('db', CAST(p_size % 3 AS STRING)) AS backend,
  CASE WHEN p_partkey % 17 = 16 THEN 'private' ELSE 'public' END AS table_schema,
  concat('t', CAST(CAST(floor(p_partkey / 12.0) AS BIGINT) AS STRING)) AS table_name,
  CASE WHEN CAST(floor(p_partkey / 12.0) AS BIGINT) % 9 = 4 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
  replace(concat(p_name, CAST(p_partkey AS STRING)), ' ', '_') AS column_name,
  p_partkey % 12 + 1 AS ordinal_position, lower(p_type) AS data_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_nullable,
  CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 11 = 1 THEN 0 END AS character_maximum_length,
  CASE WHEN p_partkey % 5 = 0 THEN 32 END AS numeric_precision
FROM part"""
VIEWS["topics"] = """
SELECT concat('bus', CAST(c_nationkey % 4 AS STRING)) AS backend,
  concat(CASE WHEN c_custkey % 13 = 0 THEN '__' ELSE '' END, 'topic', CAST(c_custkey AS STRING)) AS topic, c_nationkey + 1 AS partitions
FROM customer"""
VIEWS["topic_schemas"] = """
SELECT concat('bus', CAST(c_nationkey % 4 AS STRING)) AS backend, concat('topic', CAST(c_custkey AS STRING), s.suffix) AS subject,
  CASE WHEN c_custkey % 4 = 0 THEN '{"type": "string"}'
    WHEN c_custkey % 9 = 0 THEN '{"type": "record"'
    ELSE concat('{"type": "record", "name": "r", "fields": [{"name": "id', CAST(c_custkey AS STRING), '", "type": "long"}, ',
      '{"name": "opt", "type": ["null", "string"]}, {"name": "list", "type": {"type": "array", "items": "int"}}, {"name": "odd", "type": {"a": 1}}, {"name": "bare"}]}') END AS schema
FROM customer CROSS JOIN (SELECT '-value' AS suffix UNION ALL SELECT '-key') s
WHERE (s.suffix = '-value' AND c_custkey % 2 = 0) OR (s.suffix = '-key' AND c_custkey % 3 = 0)"""

# risk descriptions: every document's and benchmark item's text
VIEWS["risk_texts"] = """
SELECT doc_id AS risk_id, CASE doc_id % 3 WHEN 0 THEN 'gdpr' WHEN 1 THEN 'soc2' ELSE 'hipaa' END AS framework,
  CASE WHEN doc_id % 10 = 3 THEN 'Immigration status must not appear in CSV exports' WHEN doc_id % 30 = 7 THEN '...'
    WHEN doc_id % 10 = 5 THEN concat('Never log raw rows: ', coalesce(text, '')) ELSE coalesce(text, '') END AS description
FROM documents
UNION ALL
SELECT 1000000000 + item_id, 'soc2', text FROM benchmark"""

# custom sensitive terms: part names, some of them equal to default terms
VIEWS["custom_terms"] = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'PII' WHEN 1 THEN 'VENDOR' WHEN 2 THEN 'AUTH' ELSE 'EXTRA' END AS tier,
  CAST(CASE p_partkey % 4 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS tier_ord, p_partkey AS pos,
  CASE p_partkey % 25 WHEN 0 THEN 'email' WHEN 1 THEN 'Email' WHEN 2 THEN 'TOKEN' WHEN 3 THEN 'Service' WHEN 4 THEN 'string'
    ELSE replace(concat(p_name, '_', p_type), ' ', '_') END AS term
FROM part"""

# controls of the projects: every document proposes one; some carry an id that is packaged
VIEWS["project_controls"] = """
SELECT CASE doc_id % 4 WHEN 0 THEN 'GDPR' WHEN 1 THEN 'soc2' WHEN 2 THEN 'hipaa' ELSE 'house' END AS framework,
  CASE WHEN doc_id % 20 = 0 THEN 'GDPR-ART30-ROPA' WHEN doc_id % 20 = 1 THEN 'SOC2-CC9-RISK-MANAGEMENT' ELSE concat('PRJ-', CAST(doc_id % 700 AS STRING)) END AS id,
  doc_id AS ord, concat('Control of ', source) AS title, CASE WHEN doc_id % 2 = 0 THEN 'must' ELSE 'should' END AS severity
FROM documents"""

# YAML and JSON texts of registries, contracts, topologies, manifests and configurations
VIEWS["registry_yaml"] = f"""
SELECT {project('c_custkey')} AS project, concat('.ledger/registry/c', CAST(c_custkey AS STRING), '.yaml') AS path,
  CASE WHEN c_custkey % 23 = 22 THEN concat('fields: [', c_name)
    WHEN c_custkey % 19 = 18 THEN 'fields: none'
    WHEN c_custkey % 17 = 16 THEN 'fields: []'
    ELSE concat('name: s', chr(10), 'fields:', chr(10), '  - name: ', lower(c_mktsegment), chr(10), '    classification: PII', chr(10),
      '    annotations: [gdpr_erasable, {{name: encrypted_at_rest}}]', chr(10), '    immutable: true', chr(10),
      '  - justtext', chr(10), '  - {{name: acct, erasure_method: wipe, flag: false}}', chr(10),
      '  - {{name: texts, gdpr_erasable: "true", audit_field: true, annotations: ["{{name: no}}", 3, {{name: 4}}]}}', chr(10), '  - "{{name: immutable}}"', chr(10)) END AS content
FROM customer"""
VIEWS["contracts_yaml"] = f"""
SELECT {project('o_orderkey')} AS project, concat('contracts/o', CAST(o_orderkey AS STRING), '.yaml') AS path,
  CASE o_orderkey % 7 WHEN 0 THEN concat('data_access: {{rationale: reads ', o_orderstatus, ' orders}}', chr(10), 'authority: {{}}')
    WHEN 1 THEN 'id: x' WHEN 2 THEN 'data_access: text' WHEN 3 THEN 'data_access: {{rationale: 12}}' WHEN 4 THEN '- a list'
    WHEN 5 THEN 'broken: [1, 2' ELSE concat('data_access: {{reads: []}}', chr(10), 'extra: ', CAST(o_orderkey AS STRING)) END AS content
FROM orders"""
VIEWS["topology_yaml"] = f"""
SELECT {project('s_suppkey')} AS project, concat('t', CAST(s_suppkey AS STRING), '/baton.yaml') AS path,
  CASE WHEN s_suppkey % 9 = 8 THEN 'nodes: [' ELSE concat('version: "', CAST(s_suppkey % 3 AS STRING), '.0"', chr(10), 'global: {{arbiter: 1}}', chr(10), 'nodes:', chr(10),
    '  - {{name: n', CAST(s_suppkey AS STRING), ', protocol: http, authority: {{}}}}', chr(10), '  - plain', chr(10), '  - {{data_access: {{}}}}') END AS content
FROM supplier"""
VIEWS["manifest_json"] = f"""
SELECT {project('l_orderkey')} AS project, concat('m', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '.json') AS path,
  CASE WHEN l_partkey % 8 = 7 THEN '{{"entries": [' WHEN l_partkey % 16 = 6 THEN '{{"entries": []}} trailing'
    WHEN l_partkey % 16 = 14 THEN concat(' {{"weight": NaN, "entries": 1, "entries": [{{"pact_key": "PACT:a:', CAST(l_suppkey AS STRING), '", "contract_path": null, "source_file": "x"}}, 5, {{"test_path": "t"}}]}} ') ELSE concat('{{"entries": [{{"pact_key": "PACT:a:', CAST(l_suppkey AS STRING), '", "contract_path": null, "source_file": "x"}}, 5, {{"test_path": "t"}}]}}') END AS content
FROM lineitem"""
VIEWS["controls_yaml"] = """
SELECT 'org' AS project, concat('controls/', CAST(ord AS STRING), '.yaml') AS path,
  CASE WHEN ord % 13 = 5 THEN 'framework: [' ELSE concat('framework: ', framework, chr(10), 'controls:', chr(10),
    '  - {id: ', id, ', family: F, framework_ref: R', CAST(ord AS STRING), ', title: "', title, '", severity: ', severity, ', detection: {method: source_grep, any_of: [x]}}', chr(10),
    '  - {id: "not valid", family: F, framework_ref: R, title: T, detection: {method: m}}', chr(10),
    '  - {id: B', CAST(ord AS STRING), ', family: F, framework_ref: R, title: T, applicability: {tags: [a]}, detection: {method: m}}') END AS content
FROM project_controls"""
VIEWS["config_files"] = f"""
SELECT project, path, content FROM (
  SELECT project, pn, 'config/app.yaml' AS path, concat('server:', chr(10), '  tls: ', CASE WHEN pn % 3 = 0 THEN 'true' ELSE 'false' END, chr(10),
    CASE WHEN pn % 4 = 0 THEN concat('  port: ', CAST(pn AS STRING), chr(10)) ELSE '' END, '# note: audit.level is high') AS content FROM projects WHERE pn % 5 <> 4) c
UNION ALL SELECT project, '.pact/contract.yaml', 'a: 1' FROM projects WHERE pn % 4 = 1
UNION ALL SELECT project, 'baton.yaml', 'a: 1' FROM projects WHERE pn % 3 = 1"""

# draft artifacts as JSON documents, one per order
VIEWS["draft_files"] = f"""
SELECT {project('o_orderkey')} AS project,
  concat(CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'pact/contracts/' WHEN 2 THEN 'ledger/schemas/' WHEN 3 THEN 'ledger/backends/' WHEN 4 THEN 'constrain/' ELSE 'sentinel/' END,
    'd', CAST(o_orderkey AS STRING), '.yaml') AS path,
  concat('{{"_draft": ', CASE WHEN o_orderkey % 11 = 0 THEN 'false' ELSE 'true' END,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', "_confidence": "high"' WHEN 2 THEN ', "_confidence": "medium"' WHEN 3 THEN ', "_confidence": "low"' ELSE ', "_confidence": "certain"' END,
    CASE WHEN o_orderkey % 7 = 0 THEN ', "fields": [{{"name": "n", "classification": "PII"}}]' WHEN o_orderkey % 7 = 3 THEN ', "note": "classification: none"' ELSE ', "fields": []' END, '}}') AS body
FROM orders"""


# only for the reference queries: every line of every file
DUCKDB_VIEWS = {
    "lines": """
SELECT project, path, lang, unnest(generate_series(1, len(parts))) AS line, unnest(parts) AS text
FROM (SELECT project, path, lang, string_split(content, chr(10)) AS parts FROM code_corpus) s"""
}


#: Views whose rows are texts to be parsed and scanned; the tables under all others are only read.
COSTLY = ("code_corpus", "registry_yaml", "contracts_yaml", "manifest_json", "controls_yaml", "risk_texts", "json_documents")

_SOURCE = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.IGNORECASE)


@functools.cache
def _sources(sql: str) -> frozenset[str]:
    """Names a text reads from, found in one pass over it."""
    return frozenset(_SOURCE.findall(sql))


def _reads(sql: str, name: str) -> bool:
    return name in _sources(sql)


def closure(sql: str) -> list[str]:
    """Views ``sql`` needs, in an order that can be created."""
    order: list[str] = []
    known = VIEWS | DUCKDB_VIEWS

    def visit(text: str) -> None:
        for name in known:
            if name not in order and _reads(text, name):
                visit(known[name])
                order.append(name)

    visit(sql)
    return order


def for_duckdb(sql: str) -> str:
    """``sql`` with the views it needs as leading common table expressions."""
    names = closure(sql)
    if not names:
        return sql
    known = VIEWS | DUCKDB_VIEWS
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('code_corpus', 'lines') else ''}({known[n]})" for n in names)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        body = re.sub(r"(?i)^with\s+", "", body)
        return f"WITH {head},\n{body}"
    return f"WITH {head}\n{body}"


def view(spark, sf_dir: str, name: str, done: set[str] | None = None):
    """The derived table ``name`` as a Spark DataFrame.

    ``done`` names the tables that are registered already.  Costly views have
    tables of their own, dealt out over more tasks.
    """
    costly = name in COSTLY
    before = set() if done is None else done
    done = set() if costly else before
    needed = closure(VIEWS[name])
    texts = [VIEWS[n] for n in needed] + [VIEWS[name]]
    for table in BASE_TABLES:
        if table not in done and any(_reads(text, table) for text in texts):
            spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), costly=costly).createOrReplaceTempView(table)
            done.add(table)
    for dep in needed:
        if dep not in done:
            _build(spark, dep).createOrReplaceTempView(dep)
            done.add(dep)
    if costly:
        before -= done  # other views register these names again
    return _build(spark, name)


def _build(spark, name: str):
    df = spark.sql(VIEWS[name])
    if name != "code_corpus":
        return df
    # path and text of a file are large expressions here, columns in real
    # corpora: the generators keep filters from copying them
    df = df.select("project", F.explode(F.array("path")).alias("path"), "lang", "content")
    return df.select("project", "path", "lang", F.explode(F.array("content")).alias("content"))
