"""Python files: models, routes and components from the syntax tree.

Only the parse itself needs Python.  It runs as one Arrow UDF that sends the
text of Python files and takes back a struct of three arrays; the rest of the
row stays in the JVM.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from fleetlens import values as V

_FIELD = pa.struct([("name", pa.string()), ("type", pa.string())])
_MODEL = pa.struct(
    [("name", pa.string()), ("line", pa.int32()), ("orm", pa.string()), ("confidence", pa.string()), ("fields", pa.list_(_FIELD))]
)
_ROUTE = pa.struct(
    [("path", pa.string()), ("method", pa.string()), ("handler", pa.string()), ("line", pa.int32()), ("framework", pa.string())]
)
_COMPONENT = pa.struct(
    [
        ("name", pa.string()),
        ("line", pa.int32()),
        ("type", pa.string()),
        ("public_methods", pa.list_(pa.string())),
        ("dependencies", pa.list_(pa.string())),
    ]
)
_FACTS = pa.struct([("models", pa.list_(_MODEL)), ("routes", pa.list_(_ROUTE)), ("components", pa.list_(_COMPONENT))])
_FACTS_DDL = (
    "models array<struct<name:string,line:int,orm:string,confidence:string,fields:array<struct<name:string,type:string>>>>,"
    "routes array<struct<path:string,method:string,handler:string,line:int,framework:string>>,"
    "components array<struct<name:string,line:int,type:string,public_methods:array<string>,dependencies:array<string>>>"
)

# which import makes an ORM likely: all words occur in the lower-case source
_ORM_IMPORTS = [
    ("sqlalchemy", ["sqlalchemy"]),
    ("django", ["django", "models"]),
    ("peewee", ["peewee"]),
    ("tortoise", ["tortoise"]),
    ("pydantic", ["pydantic"]),
]


def _dotted(node: ast.expr) -> str | None:
    """``a.b.c`` as text; for anything else at the root only the attributes."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names)) or None


def _callee(node: ast.expr) -> str:
    func = node.func if isinstance(node, ast.Call) else None
    return getattr(func, "id", None) or getattr(func, "attr", "")


class _File:
    """Facts of one parsed file."""

    def __init__(self, tree: ast.Module):
        nodes = list(ast.walk(tree))
        self.imports = self._imports(nodes)
        self.hint = next(
            (orm for src in self.imports.values() for orm, words in _ORM_IMPORTS if all(w in src.lower() for w in words)),
            None,
        )
        self.models: list[dict] = []
        self.routes: list[dict] = []
        self.components: list[dict] = []
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                self._class(node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(node)

    @staticmethod
    def _imports(nodes: list[ast.AST]) -> dict[str, str]:
        table: dict[str, str] = {}
        for node in nodes:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                prefix = "" if isinstance(node, ast.Import) else (node.module or "") + "."
                table.update({a.asname or a.name: prefix + a.name for a in node.names})
        return table

    def _orm(self, base: str) -> str | None:
        if base in V.PY_SQLALCHEMY_BASES:
            return "sqlalchemy"
        if base == "models.Model":
            return "django"
        if self.hint == "peewee" and base == "BaseModel":
            return "peewee"
        return "pydantic" if base in V.PY_PYDANTIC_BASES else None

    def _class(self, node: ast.ClassDef) -> None:
        bases = (_dotted(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute)))
        orm = next((o for o in map(self._orm, filter(None, bases)) if o), None)
        if orm:
            self.models.append(
                {
                    "name": node.name,
                    "line": node.lineno,
                    "orm": orm,
                    "confidence": "medium" if orm == "pydantic" else "high",
                    "fields": [{"name": n, "type": t} for item in node.body for n, t in _fields(item)],
                }
            )
        methods = [d.name for d in node.body if isinstance(d, (ast.FunctionDef, ast.AsyncFunctionDef)) and d.name[0] != "_"]
        if methods:
            init = next((d for d in node.body if isinstance(d, ast.FunctionDef) and d.name == "__init__"), None)
            args = [a.arg for a in init.args.args] if init else []
            self.components.append(
                {
                    "name": node.name,
                    "line": node.lineno,
                    "type": "service" if len(args) > 1 else "library",
                    "public_methods": methods,
                    "dependencies": [a for a in args if a != "self"],
                }
            )

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for call in node.decorator_list:
            if not isinstance(call, ast.Call):
                continue
            target = call.func
            if isinstance(target, ast.Attribute) and target.attr.lower() in V.PY_ROUTE_VERBS:
                verb = target.attr.lower()
                method, framework = "ANY" if verb == "route" else verb.upper(), self._framework(target.value)
            elif isinstance(target, ast.Name) and target.id in V.PY_BARE_ROUTE_NAMES:
                method, framework = "ANY", "unknown"
            else:
                continue
            texts = (a.value for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str))
            self.routes.append(
                {
                    "path": next(texts, None) or "/",
                    "method": method,
                    "handler": node.name,
                    "line": node.lineno,
                    "framework": framework,
                }
            )

    def _framework(self, owner: ast.expr) -> str:
        if not isinstance(owner, ast.Name):
            return "unknown"
        source = self.imports.get(owner.id, "").lower()
        named = next((f for f in ("fastapi", "flask") if f in source), None)
        return named or {"router": "fastapi", "app": "flask"}.get(owner.id, "unknown")


def _fields(item: ast.stmt):
    """(name, type) pairs one class-level statement declares."""
    if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
        note = item.annotation
        if isinstance(note, ast.Subscript) and isinstance(note.value, ast.Name):
            note = note.value
        name = getattr(note, "id", None) if isinstance(note, ast.Name) else getattr(note, "attr", None)
        yield item.target.id, (name or "unknown").lower()
    elif isinstance(item, ast.Assign) and _callee(item.value) in V.PY_COLUMN_CALLS:
        heads = (a.func if isinstance(a, ast.Call) else a for a in item.value.args)
        known = (V.PY_COLUMN_TYPES[h.id] for h in heads if isinstance(h, ast.Name) and h.id in V.PY_COLUMN_TYPES)
        kind = next(known, "unknown")
        for target in item.targets:
            if isinstance(target, ast.Name) and not target.id.startswith("_"):
                yield target.id, kind


def _facts(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _File(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return {"models": found.models, "routes": found.routes, "components": found.components}


def _parse(texts: pa.Array) -> pa.Array:
    return pa.array([_facts(t) for t in texts.to_pylist()], type=_FACTS)


def python_facts(content: Column) -> Column:
    """``struct<models, routes, components>``; NULL for unparsable text."""
    return arrow_udf(_parse, _FACTS_DDL)(content)
