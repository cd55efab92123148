"""Scanner semantics that the derived tables do not reach."""

from pyspark.sql import functions as F

from fleetlens.operators import code_scan as code, line_scan
from fleetlens.operators.discovery import openapi_components, openapi_routes
from fleetlens.operators.python_scan import _facts


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("ord").select(*cols).collect()]


def test_python_bases():
    text = """
import peewee
class A(Model): pass
class B(BaseModel): pass
class C(models.Model): pass
class D(x.y.Base, BaseSettings): pass
class E(foo().db.Model): pass
class F(Generic[T], Base): pass
class G: pass
"""
    found = _facts(text)["models"]
    assert [(m["name"], m["orm"], m["confidence"]) for m in found] == [
        ("A", "sqlalchemy", "high"), ("B", "peewee", "high"), ("C", "django", "high"), ("D", "pydantic", "medium"),
        ("E", "sqlalchemy", "high"), ("F", "sqlalchemy", "high"),
    ]


def test_python_fields():
    text = """
class A(Base):
    a: int
    b: List[int] = None
    c: typing.Optional[int]
    d: "x"
    e: t.Text
    f = g = Column(Enum(X), JSON)
    _h = Column(JSON)
    i = sa.Column(sa.Integer)
    j = other(String)
    k, l = Column(JSON), 2
"""
    fields = _facts(text)["models"][0]["fields"]
    assert [(f["name"], f["type"]) for f in fields] == [
        ("a", "int"), ("b", "list"), ("c", "unknown"), ("d", "unknown"), ("e", "text"), ("f", "enum"), ("g", "enum"), ("i", "unknown"),
    ]


def test_python_routes():
    text = """
from fastapi import FastAPI as router2
import flask as web
@router2.get("/a")
def a(): pass
@web.route(rule="/b")
@x.patch("/c", "/d")
async def b(): pass
@app_route("/e")
@router(1)
@plain
@self.x.delete("/f")
def c(): pass
class K:
    @app.Get("/g")
    def d(self): pass
"""
    assert [tuple(r.values()) for r in _facts(text)["routes"]] == [
        ("/a", "GET", "a", 5, "fastapi"), ("/", "ANY", "b", 8, "flask"), ("/c", "PATCH", "b", 8, "unknown"),
        ("/e", "ANY", "c", 13, "unknown"), ("/", "ANY", "c", 13, "unknown"), ("/f", "DELETE", "c", 13, "unknown"), ("/g", "GET", "d", 16, "flask"),
    ]


def test_python_components_and_broken_files():
    text = """
class A:
    async def run(self): pass
    def __init__(self, db, *, kw=1): pass
class B:
    def _x(self): pass
class C:
    class D:
        def go(self): pass
"""
    assert [tuple(c.values()) for c in _facts(text)["components"]] == [("A", 2, "service", ["run"], ["db"]), ("D", 8, "library", ["go"], [])]
    for bad in ("class :", "x = 1\0", "(" * 3000, "  indented = 1\nx"):
        assert _facts(bad) is None
    assert _facts(None) is None


def test_python_through_spark(corpus):
    c = corpus({"a.py": "class A(Base):\n    x: int\n", "b.py": "def (", "c.rb": "class Z < ApplicationRecord"})
    got = rows(code.models(c), "source_file", "name", "orm", "line", F.col("fields.name"))
    assert got == [("a.py", "A", "sqlalchemy", 1, ["x"]), ("c.rb", "Z", "activerecord", 1, [])]


def test_typeorm_stretches_and_names(corpus):
    text = "\n@Entity( 'a' )\n@Column({ type: 'int' })\n id: x;\nclass\n  A {}\n" + " " * 1950 + "@Column()\n far\n@Entity()\nfunction x() {}\n"
    got = rows(code.models(corpus({"m.ts": text}), ["ts_typeorm_models"]), "name", "line", F.col("fields.name"), F.col("fields.type"))
    assert got == [("A", 2, ["id", "far"], ["int", "unknown"]), ("Unknown", 9, [], [])]


def test_typeorm_long_entity_keeps_its_fields_only(corpus):
    column = "  @Column()\n  f{}: string;\n"
    long = "@Entity('t')\nexport class Long {\n" + "".join(column.format(k) + "  // " + "x" * 80 + "\n" for k in range(120)) + "}\n"
    other = "class Helper {\n  @Column()\n  stray: string;\n}\n@Entity({ name: 'odd' })\nclass Odd {\n  @Column()\n  odd: string;\n}\n"
    late = "@Entity()\n@Entity('twice')\nexport abstract class Late {\n" + column.format("l") + "}\n"
    assert len(long) > 10_000
    got = rows(code.models(corpus({"m.ts": long + other + late}), ["ts_typeorm_models"]), "name", F.col("fields.name"))
    assert got == [("Long", [f"f{k}" for k in range(120)]), ("Late", []), ("Late", ["fl"])]
    near = corpus({"m.ts": long}).select(F.explode(code.typeorm_models(F.col("content"), 2000)).alias("m")).first().m
    assert 0 < len(near.fields) < 40


def test_many_prisma_models(corpus):
    text = "".join(f"model M{k}x {{\n id Int\n}}\n" for k in range(1500))
    got = rows(code.models(corpus({"s.prisma": text})), "name", "line")
    assert sorted(got, key=lambda r: r[1]) == [(f"M{k}x", 3 * k + 1) for k in range(1500)]


def test_prisma_prefix_line_and_fields(corpus):
    text = "model PersonX {\n id Int\n}\n\nmodel Person {\n  a String[]? @x\n  @@map(b)\n  // c d\n  @skip me\n one\n}\nmodel  Odd {\n}"
    got = rows(code.models(corpus({"s.prisma": text})), "name", "line", F.col("fields.name"), F.col("fields.type"))
    assert got == [("PersonX", 1, ["id"], ["Int"]), ("Person", 1, ["a"], ["String"])]


def test_go_body_ends_at_first_brace(corpus):
    text = 'type A struct {\n\tM map[string]struct{}\n\tX int `gorm:"x"`\n}\ntype B struct {\n Y int `db:"y"`\n z int\n Lone\n}\ntype open struct { Q int `gorm:"q"`'
    c = corpus({"a.go": text + '\n r.GET("/x", h)\n'})
    assert rows(code.models(c), "name", "orm", F.col("fields.name")) == [("B", "sqlx", ["Y"])]
    assert rows(code.components(c), "name") == [("A",)]
    assert rows(code.routes(c), "method", "framework") == [("GET", "net/http"), ("GET", "gin")]


def test_java_first_class_is_the_entity(corpus):
    text = '// class of\n@Entity\npublic class Acc {\n @Column(name="a")\n\n private Long id;\n}\nclass Acc2 {}\nclass of {}'
    c = corpus({"A.java": text})
    assert rows(code.models(c), "name", "line", F.col("fields.name"), F.col("fields.type")) == [("of", 1, ["id"], ["long"])]
    assert rows(code.components(c), "name", "line") == [("Acc", 3), ("Acc2", 8)]


def test_rails_paths_and_exports(corpus):
    rb = "get '/a'\nresources \"b\"\nRESOURCE 'c'\nwidget 'd'"
    c = corpus({"config/x.rb": rb, "My_Routes.rb": rb, "other.rb": rb, "e.js": "module.exports = A\nclass B {}\nmodule.exports = B\nmodule.exports = A\n"})
    assert rows(code.routes(c, ["rb_rails_routes"]), "source_file", "method", "route") == [
        ("My_Routes.rb", "GET", "/a"), ("My_Routes.rb", "CRUD", "b"), ("My_Routes.rb", "CRUD", "c"), ("My_Routes.rb", "GET", "d"),
        ("config/x.rb", "GET", "/a"), ("config/x.rb", "CRUD", "b"), ("config/x.rb", "CRUD", "c"), ("config/x.rb", "GET", "d"),
    ]
    got = rows(code.components(c, ["js_module_exports", "ts_classes"]), "name", "line", "note")
    assert [(n, line) for n, line, _ in got] == [("B", 2), ("A", 1)]


def test_pact_keys_line_anchors(corpus):
    c = corpus({"a.py": "KEY:one\nKEY:two x\nKEY:three"})
    got = line_scan.scan_pact_keys(c, r"KEY:\w+$").select("line", "key").collect()
    assert sorted(map(tuple, got)) == [(1, "KEY:one"), (3, "KEY:three")]


def test_env_and_sensitive(corpus):
    text = "os.environ['DATABASE_URL'] + process.env.database_url2; ENV[\"X\"]\nos.getenv('DATABASE_URL') # Token token éemail email_ EMAIL\n"
    c = corpus({"a.py": text})
    assert [tuple(r) for r in line_scan.env_vars(c).orderBy("pos").select("name", "line", "backend_hint").collect()] == [
        ("DATABASE_URL", 1, "postgres"), ("database_url2", 1, "postgres")
    ]
    got = line_scan.scan_sensitive_fields(c).orderBy("pos").select("field_name", "pattern_matched", "classification_hint").collect()
    assert [tuple(r) for r in got] == [("Token", "token", "AUTH"), ("EMAIL", "email", "PII")]


def test_openapi_odd_documents(spark):
    specs = [
        ("p", "a", '{"paths": {"/x": "text", "/y": {"get": {}, "post": "no", "x-a": {}, "trace": {"operationId": "t"}}}}'),
        ("p", "b", '{"info": {"title": "T"}}'),
    ]
    df = spark.createDataFrame(specs, "project string, source string, spec string")
    got = [tuple(r) for r in openapi_routes(df).orderBy("ord").select("route", "method", "handler").collect()]
    assert got == [("/y", "GET", "get_/y"), ("/y", "TRACE", "t")]
    got = [tuple(r) for r in openapi_components(df).orderBy("ord").select("name", "public_methods", "note").collect()]
    assert got == [("unknown", ["get_/y", "t"], "Discovered from OpenAPI spec: unknown"), ("T", [], "Discovered from OpenAPI spec: unknown")]


def test_yaml_with_date_keys_and_manifests_with_leading_blanks(corpus):
    from fleetlens.sources.documents import manifest_read, yaml_documents

    row = yaml_documents(corpus({"a.yaml": "2024-01-02: x\nlist: [{2024-01-03: y}]\n"})).first()
    assert row.parse_ok and row.body == '{"2024-01-02": "x", "list": [{"2024-01-03": "y"}]}'
    _, entries = manifest_read(corpus({"m.json": '\n {"entries": [{"pact_key": "PACT:a:b"}]}'}))
    assert [r.pact_key for r in entries.collect()] == ["PACT:a:b"]
