"""Matches, line numbers, globs and scores against plain Python."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens import values as V
from fleetlens.functions import regexkit as R
from fleetlens.functions.text import percent, snake, version_below

PATTERNS = [V.TS_CLASS, V.RAILS_ROUTE, V.GO_STRUCT, V.SPRING_MAPPING, V.MODULE_EXPORTS, V.DRIZZLE_TABLE]


def _texts():
    rng = random.Random(7)
    bits = [
        "class Foo", "class\n  Bär", "export class X1 ", "get 'a/b'", 'put\n"x"', "type T struct {", "type\tU\n struct{",
        '@GetMapping("/a")', "@PostMapping(value = '/b')", "module.exports = class Q", "module.exports=\nz", "pgTable('t')", "\n", "\n\n",
        " é\u2028x ", "\r\n", "\x85", "classy Foo", "\U0001f600",
    ]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "class A", "class A\n" * 3000]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_equal_finditer(spark, pattern):
    texts = _texts()
    groups = tuple(range(1, re.compile(pattern).groups + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = df.select("id", F.posexplode(R.match_structs("content", R.rx(pattern), groups)).alias("pos", "m")).select("id", "pos", "m.*")
    found = sorted(tuple(r) for r in got.collect())
    want = sorted(
        (i, n, t[: m.start()].count("\n") + 1, m.start(), m.end(), *[g or "" for g in m.groups()])
        for i, t in enumerate(texts)
        for n, m in enumerate(re.finditer(pattern, t))
    )
    assert found == want


CONTEXT = [r"(\w+)(?=\n)", r"(?<=class )(\w)", r"\b(c)l(a|e)", r"^(\w)", r"(\w*)$", r"([^\n])\Z", r"(x)?(\w++)"]


@pytest.mark.parametrize("pattern", CONTEXT)
def test_groups_that_hang_on_the_text_around(spark, pattern):
    assert not R.stands_alone(R.rx(pattern, multiline=True))
    texts = _texts()[:30]
    groups = tuple(range(1, re.compile(pattern).groups + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = df.select("id", F.explode(R.match_structs("content", R.rx(pattern, multiline=True), groups)).alias("m")).select("id", "m.start", *[f"m.g{g}" for g in groups])
    want = sorted((i, m.start(), *[g or "" for g in m.groups()]) for i, t in enumerate(texts) for m in re.finditer(pattern, t, re.M) if m.group())
    assert sorted(tuple(r) for r in got.collect() if any(r[2:])) == [w for w in want if any(w[2:])]


def test_groups_are_read_from_the_matches():
    for pattern in [*PATTERNS, V.EXPRESS_ROUTE, V.GO_HTTP_ROUTE, V.GIN_ROUTE, V.JAVA_CLASS]:
        assert R.match_sql("content", R.rx(pattern), (1,)).count("regexp_extract_all(content") == 1


HELD = [
    "cla", "class X1", "(cla|get)", "(?:put|T)", "(class|get|module).*(struct|Map|=)", "class.*Foo", "cla.*X1.*(y|Q)", "absent", "absent.*Foo", "Foo.*absent",
    "class.*", "a|class.*Foo", "(cla(?=s)|x).*Foo", "clas[st].*Foo", "(get|put)?", "^class.*Foo$", "(get||x)y", "(export|put)\\s", "é",
]


@pytest.mark.parametrize("pattern", HELD)
def test_words_are_searched_before_the_pattern(spark, pattern):
    texts = _texts()
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, content string")
    got = dict(df.select("id", R.holds(F.col("content"), pattern, multiline=True)).collect())
    assert got == {-1: None} | {i: bool(re.search(pattern, t, re.M)) for i, t in enumerate(texts)}


def test_a_text_without_the_words_never_meets_the_pattern():
    assert "rlike" in str(R.holds(F.col("c"), "clas[st].*Foo"))
    for words in ("audit", "do not sell", "(cvv|track2)"):
        assert "rlike" not in str(R.holds(F.col("c"), words))
    both = str(R.holds(F.col("c"), "(store|log).*(cvv|cvc)"))
    assert both.index("cvc") < both.index("rlike") and both.lower().count("contains") == 4


@pytest.mark.parametrize("pattern", [V.RAILS_ROUTE, V.EXPRESS_ROUTE, V.GO_HTTP_ROUTE, "(keep|Set|stop)x", "(get|put)?b", "(get||put)x", "(?:app|b)c|d"])
def test_a_look_at_the_next_character_changes_no_match(spark, pattern):
    plain = R.rx(pattern, ignore_case=True)
    texts = [*_texts(), "\u212aeepx \u017fetx \u017ftopx", "app.get('x') APP.Post(\n'y' router.put('z'", "bc d ac appc b", "mux.Get(\"/a\" r.get(\"/b\" xapp.HANDLE(\""]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    hits = [F.expr(f"regexp_extract_all(content, {R.sql_text(p)}, 0)").alias(n) for n, p in (("a", plain), ("b", R.hasten(plain)))]
    rows = df.select(*hits).collect()
    assert any(r.a for r in rows) and all(r.a == r.b for r in rows)
    assert ("(?=[" in R.hasten(plain)) == (pattern not in ("(get|put)?b", "(get||put)x"))


def test_rx_translates_python_notation():
    assert R.rx(r"(?P<a>\w)(?P=a)\Z") == r"(?Ud)(?<a>[\p{L}\p{N}_])\k<a>\z"
    assert R.rx(r"\\w", multiline=True, ignore_case=True) == r"(?Udmiu)\\w"


@pytest.mark.parametrize("glob", ["**/*", "*.py", "src/**", "services/*/src/**", "a?c/[xy]*.t", "[!a]*", "a.b+c"])
def test_globs_equal_fnmatch(spark, glob):
    paths = ["x.py", "src/x.py", "services/a/src/b/x.tf", "abc/x1.t", "abc/z1.t", "root", "a.b+c", "d/a.b+c", "src/a\nb"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r[0] for r in df.where(R.matches_any_glob(F.col("path"), [glob])).collect()}
    assert got == {p for p in paths if fnmatch.fnmatch(p, glob) or fnmatch.fnmatch(p.rsplit("/", 1)[-1], glob)}


def test_percent_rounds_like_python(spark):
    rows = [(p, t) for t in range(0, 90) for p in range(0, t + 1)]
    df = spark.createDataFrame(rows, "p bigint, t bigint").select("p", "t", percent(F.col("p"), F.col("t")).alias("x"))
    for r in df.collect():
        assert r.x == (100.0 if r.t == 0 else round(r.p / r.t * 100, 1))


@pytest.mark.parametrize("minimum", ["2.0", "1.0.0", "beta"])
def test_versions(spark, minimum):
    versions = ["1.0", "1.10", "1.2.0", "1.10.0", "2.0", "2", "2.0.0", "beta", "1.x", "10.0", " 2.0", ""]

    def below(a, b):
        try:
            return [int(x) for x in a.split(".")] < [int(x) for x in b.split(".")]
        except ValueError:
            return a < b

    df = spark.createDataFrame([(v,) for v in versions], "v string").select("v", version_below(F.col("v"), minimum).alias("b"))
    assert {r.v: r.b for r in df.collect()} == {v: below(v, minimum) for v in versions}


def test_snake(spark):
    def slug(name):
        return re.sub(r"[^a-z0-9_]", "_", re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower())

    names = ["FooBar", "HTTPServer", "x", "a-b C", "Ünï", "aB1C", "_X"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", snake(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == {n: slug(n) for n in names}


def test_escape_regex(spark):
    texts = ["a.b*c", "(x) [y] {z}", "1+1=2?", "p|q^r$", "back\\slash", "..."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.escape_regex(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.e == re.escape(r.t)
