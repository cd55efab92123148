"""Compliance controls over a fleet of projects.

The control list is small and lives on the driver; its patterns become
constants inside the plan.  Each detection method is one branch over the data
it needs, whatever the number of controls:

* one pass over the corpus evaluates all patterns of all grep controls,
* one pass over the files with routes evaluates all guard sets,
* one aggregation over the registry fields serves all tier controls,
* evidence controls are a join of (project, control) with two small tables.

Every branch returns (project, ctl, verdict, target, message, uncovered),
where ``ctl`` numbers the detection and ``uncovered`` holds the first few
offenders.  ``registry_offenders``, ``grep_hits`` and ``judged_routes`` return
all of them as rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens import values as V
from fleetlens.control_table import packaged_controls
from fleetlens.functions.regexkit import holds, let, once, rx
from fleetlens.functions.text import constant_map, constant_rows
from fleetlens.operators.checks import CHECK_COLUMNS, check_order, source_signals, union_all
from fleetlens.operators.code_scan import fact_array, files_with, language_rank, with_syntax
from fleetlens.sources.corpus import evidence_path_ok

MAX_CONTROLS = 10_000
RESULT = ["project", "ctl", "verdict", "target", "message", "uncovered"]
CONTROL_SCHEMA = (
    "framework string, framework_version string, id string, ord bigint, family string, framework_ref string, title string, description string, severity string, "
    "classification_tier string, applicability string, detection string, corroborating string, validation_test string, evidence_owner string"
)

# --- control table ------------------------------------------------------------


def controls_table(spark: SparkSession, controls: list[dict] | None = None) -> DataFrame:
    """Controls as a table; nested parts are JSON text."""
    rows = []
    for i, c in enumerate(packaged_controls() if controls is None else controls):
        rows.append(
            (
                c["framework"].lower(), c.get("framework_version"), c["id"], i, c.get("family"), c.get("framework_ref"), c.get("title"),
                c.get("description"), c.get("severity", "must"), c.get("classification_tier"), json.dumps(c.get("applicability") or {}),
                json.dumps(c["detection"]), json.dumps(c.get("corroborating_detection") or []),
                json.dumps(c["validation_test"]) if c.get("validation_test") else None, c.get("evidence_owner"),
            )
        )
    return spark.createDataFrame(rows, CONTROL_SCHEMA)


def controls_merge(base: DataFrame, project_controls: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """Later controls replace earlier ones of the same id but keep their place.

    Both tables hold at least (framework, id, ord); ``ord`` orders a table.
    With a column ``project`` in ``project_controls`` each project has its own
    later controls: ``project`` of the result is NULL for the controls that
    hold everywhere else, and a project's own rows come besides them.
    """
    own = "project" in project_controls.columns
    body = [c for c in base.columns if c not in ("framework", "id", "ord", "project")]

    def layered(df: DataFrame, layer: int) -> DataFrame:
        return df.select(
            *(["project"] if own and layer else []),
            F.lower("framework").alias("framework"), "id",
            F.struct(F.lit(layer).alias("layer"), F.col("ord").cast("bigint").alias("ord")).alias("place"),
            F.struct(*body).alias("body"),
        )

    def last(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys, "framework", "id").agg(F.min("place").alias("place"), F.max_by("body", "place").alias("body"))

    first, later = layered(base, 0), layered(project_controls, 1)
    if own:
        packaged = last(first)
        places = packaged.select("framework", "id", F.col("place").alias("packaged"))
        mine = last(later.where(F.col("project").isNotNull()), "project").join(places, ["framework", "id"], "left").withColumn("place", F.coalesce("packaged", "place"))
        everywhere = packaged.withColumn("project", F.lit(None).cast("string"))
        merged = everywhere.unionByName(mine.drop("packaged"))
    else:
        merged = last(first.unionByName(later))
    wanted = [f.lower() for f in frameworks or []]
    if wanted:
        merged = merged.where(F.col("framework").isin(wanted))
    return merged.select(*(["project"] if own else []), "framework", "id", F.col("place.layer").alias("layer"), F.col("place.ord").alias("ord"), "body.*")


def controls_list(table: DataFrame) -> list[dict]:
    """The (small) control table as dictionaries, in order of evaluation.

    A project's own control gets ``only``, its project; the control that it
    replaces gets ``besides``, the projects it does not hold for.
    """
    place = ["framework"] + (["layer"] if "layer" in table.columns else []) + ["ord"] + (["project"] if "project" in table.columns else [])
    rows = table.orderBy(*place).limit(MAX_CONTROLS + 1).collect()
    if len(rows) > MAX_CONTROLS:
        raise ValueError(f"more than {MAX_CONTROLS} controls")
    out = []
    for r in rows:
        c = r.asDict()
        c["applicability"] = json.loads(c.get("applicability") or "{}")
        c["detection"] = json.loads(c["detection"])
        c["corroborating_detection"] = json.loads(c.pop("corroborating", None) or "[]")
        c["validation_test"] = json.loads(c["validation_test"]) if c.get("validation_test") else None
        c["only"] = c.pop("project", None)
        out.append(c)
    for c in out:
        if c["only"] is None:
            c["besides"] = [o["only"] for o in out if o["only"] is not None and (o["framework"], o["id"]) == (c["framework"], c["id"])]
    return out


def _in_scope(controls: list[dict], number: str = "control") -> Column | None:
    """Does a control hold for a project?  None if all controls hold everywhere."""
    only = {i: c["only"] for i, c in enumerate(controls) if c.get("only") is not None}
    besides = {i: c["besides"] for i, c in enumerate(controls) if c.get("besides")}
    if not only and not besides:
        return None
    fits = F.lit(True)
    if only:
        fits = fits & F.coalesce(constant_map(only)[F.col(number)] == F.col("project"), F.lit(True))
    if besides:
        fits = fits & ~F.coalesce(F.array_contains(constant_map(besides)[F.col(number)], F.col("project")), F.lit(False))
    return fits


# --- helpers -----------------------------------------------------------------------


def _as_list(value) -> list:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def _label(value) -> str:
    return ",".join(map(str, value)) if isinstance(value, list) else str(value)


def _no_uncovered() -> Column:
    return F.array().cast("array<string>").alias("uncovered")


def _struct_array(rows: list[dict], ddl: str) -> Column:
    """A constant array of structs, one per row; ddl gives names and types."""
    return constant_rows(rows, [part.split(":")[0] for part in ddl.split(",")])


def _per_project(projects: DataFrame, rows: list[dict], ddl: str) -> DataFrame:
    """Each project once per control row; the rows are constants."""
    return projects.select("project", F.explode(_struct_array(rows, ddl)).alias("c")).select("project", "c.*")


def _first_few(rows: DataFrame, keys: list[str], order: list[str], text: str, n: int = V.UNCOVERED_SHOWN) -> DataFrame:
    """The first ``n`` texts per key; the limit applies before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_place", place)
        .where(F.col("_place") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_place", text))).alias("_few"))
        .select(*keys, F.col(f"_few.{text}").alias("uncovered"))
    )


# --- registry detectors ------------------------------------------------------------


def _tier_of(ctl: dict) -> str | None:
    tier = ctl["detection"].get("tier") or ctl.get("classification_tier")
    return tier.lower() if tier else None


def _in_tier(tier: str | None) -> Column:
    return F.lit(True) if not tier else F.lower(F.coalesce("classification", F.lit(""))) == tier


def _registry_scope(d: dict) -> tuple[Column, Column]:
    """(in scope, missing) conditions of one registry detection on a field."""
    tier = _in_tier(d["_tier"])
    if d["method"] == "ledger_tier_encrypted":
        return tier, tier & ~F.array_contains("annotations", "encrypted_at_rest")
    wanted, companion = d.get("required_annotation"), d.get("required_field_key")
    scope = tier & F.array_contains("annotations", wanted) if wanted else tier
    missing = scope & ~F.array_contains("keys", companion) if companion else F.lit(False)
    return scope, missing


def _flat(dets: list[dict]) -> list[dict]:
    return [{**d["detection"], "ctl": d["ctl"], "_tier": _tier_of(d)} for d in dets]


def registry_offenders(fields: DataFrame, dets: list[dict]) -> DataFrame:
    """(project, ctl, schema_path, pos, item) of every field a detection misses."""
    flags = F.array(*[F.when(_registry_scope(d)[1], F.lit(d["ctl"])) for d in _flat(dets)])
    item = F.concat("schema_path", F.lit(":"), F.coalesce("name", F.lit("<unnamed>")))
    return fields.where("is_dict").select(
        "project", "schema_path", "pos", item.alias("item"), F.explode(F.array_compact(flags)).alias("ctl")
    )


def detect_registry(projects: DataFrame, fields: DataFrame, dets: list[dict]) -> DataFrame:
    """Obligation and encryption detections, all in one aggregation per project."""
    offenders = registry_offenders(fields, dets)
    dets = _flat(dets)
    sums = []
    for d in dets:
        scope, missing = _registry_scope(d)
        sums.append(
            F.struct(
                F.count_if(_in_tier(d["_tier"])).alias("n_tier"),
                F.count_if(scope).alias("n_scope"),
                F.count_if(missing).alias("n_missing"),
            ).alias(f"c{d['ctl']}")
        )
    counts = fields.where("is_dict").groupBy("project").agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(d["ctl"]).alias("ctl"),
                F.lit(d["method"] == "ledger_tier_encrypted").alias("encrypted"),
                F.lit(d.get("required_annotation")).cast("string").alias("annotation"),
                F.lit("encrypted_at_rest" if d["method"] == "ledger_tier_encrypted" else d.get("required_field_key")).cast("string").alias("companion"),
                F.coalesce(F.col(f"c{d['ctl']}.n_tier"), F.lit(0)).alias("n_tier"),
                F.coalesce(F.col(f"c{d['ctl']}.n_scope"), F.lit(0)).alias("n_scope"),
                F.coalesce(F.col(f"c{d['ctl']}.n_missing"), F.lit(0)).alias("n_missing"),
            )
            for d in dets
        ]
    )
    flat = projects.select("project").join(counts, "project", "left").select("project", F.explode(rows).alias("r")).select("project", "r.*")
    n = {k: F.col(k).cast("string") for k in ("n_scope", "n_missing")}
    verdict = (
        F.when(F.col("n_tier") == 0, "skipped")
        .when(F.col("n_scope") == 0, "missing")
        .when(F.col("n_missing") == 0, "present")
        .when(F.col("n_missing") == F.col("n_scope"), "missing")
        .otherwise("partial")
    )
    annotation = F.coalesce("annotation", F.lit("None"))
    message = (
        F.when(F.col("n_tier") == 0, "no matching Ledger fields")
        .when(F.col("n_scope") == 0, F.concat(F.lit("no fields carry annotation "), annotation))
        .when((F.col("n_missing") == 0) & F.col("encrypted"), F.concat(n["n_scope"], F.lit(" Ledger field(s) encrypted at rest")))
        .when(F.col("n_missing") == 0, F.concat(n["n_scope"], F.lit(" Ledger field(s) satisfy "), annotation))
        .otherwise(F.concat(n["n_missing"], F.lit(" field(s) missing "), F.coalesce("companion", F.lit("None"))))
    )
    few = _first_few(offenders, ["project", "ctl"], ["schema_path", "pos"], "item")
    return flat.join(few, ["project", "ctl"], "left").select(
        "project", "ctl", verdict.alias("verdict"), F.lit("ledger").alias("target"), message.alias("message"),
        F.coalesce("uncovered", _no_uncovered()).alias("uncovered"),
    )


# --- source_grep ---------------------------------------------------------------------


def _grep_params(d: dict) -> tuple[list[str], list[str], list[str]]:
    det = d["detection"]
    patterns = _as_list(det.get("any_of")) or _as_list(det.get("none_of"))
    return patterns, _as_list(det.get("include_glob") or V.DEFAULT_INCLUDE), _as_list(det.get("exclude_glob"))


def _grep_array(dets: list[dict], path_rules: dict | None = None) -> Column:
    """The (ctl, pat) pairs that a file's path and content meet, as an array.

    Distinct file rules and distinct patterns are evaluated once per file.
    """
    rules: list[tuple] = []
    patterns: dict[str, set] = {}  # and the projects that ask for them, None: all
    pairs: list[dict] = []
    for d in dets:
        pats, include, exclude = _grep_params(d)
        rule = (tuple(include), tuple(exclude))
        if rule not in rules:
            rules.append(rule)
        for i, p in enumerate(pats):
            patterns.setdefault(p, set()).add(d.get("only"))
            pairs.append({"ctl": d["ctl"], "pat": i, "rule": rules.index(rule), "regex": list(patterns).index(p)})

    def meets(pattern: str, projects: set) -> Column:
        seen = holds(F.col("content"), pattern, multiline=True)
        return seen if None in projects else F.col("project").isin(sorted(projects)) & seen

    allowed = F.array(*[evidence_path_ok(F.col("path"), list(inc), list(exc), **(path_rules or {})) for inc, exc in rules])
    seen = F.array(*[meets(p, projects) for p, projects in patterns.items()])
    table = _struct_array(pairs, "ctl:int,pat:int,rule:int,regex:int")
    hit = let(seen, lambda s: let(allowed, lambda ok: F.filter(table, lambda q: F.get(ok, q["rule"]) & F.get(s, q["regex"]))))
    return F.when(let(allowed, lambda ok: F.array_contains(ok, True)), F.transform(hit, lambda h: F.struct(h["ctl"].alias("ctl"), h["pat"].alias("pat"))))


def grep_hits(corpus: DataFrame, dets: list[dict], path_rules: dict | None = None) -> DataFrame:
    """(project, path, ctl, pat): every file and pattern of a control that meet."""
    return _hit_rows(once(corpus.select("project", "path", "content"), "hits", _grep_array(dets, path_rules)))


def _hit_rows(files: DataFrame) -> DataFrame:
    return files.select("project", "path", F.explode("hits").alias("h")).select("project", "path", "h.ctl", "h.pat")


def detect_grep(projects: DataFrame, corpus: DataFrame, dets: list[dict], path_rules: dict | None = None) -> DataFrame:
    """``corpus`` holds texts, or is a ``text_stream`` that has looked at them already."""
    rows = []
    for d in dets:
        det = d["detection"]
        include = det.get("include_glob") or V.DEFAULT_INCLUDE
        pats, _, _ = _grep_params(d)
        mode = "any" if _as_list(det.get("any_of")) else "none" if pats else "off"
        rows.append({"ctl": d["ctl"], "mode": mode, "label": _label(include), "pats": pats, "listed": str(pats)})
    base = _per_project(projects, rows, "ctl:int,mode:string,label:string,pats:array,listed:string")
    active = [d for d in dets if _grep_params(d)[0]]
    if not active:
        hits = base.select("project", "ctl", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("pat")).where(F.lit(False))
    else:
        hits = _hit_rows(corpus) if "hits" in corpus.columns else grep_hits(corpus, active, path_rules)
        hits = hits.where(F.col("ctl").isin([d["ctl"] for d in active]))
    # the first hits of a control: the target of any-of, the offenders of none-of
    few = _first_few(hits.withColumn("hit", F.struct("path", "pat")), ["project", "ctl"], ["path", "pat"], "hit")
    result = base.join(few.withColumnRenamed("uncovered", "few"), ["project", "ctl"], "left").withColumn("first", F.get("few", F.lit(0)))
    offenders = F.when(
        F.col("mode") == "none", F.transform("few", lambda h: F.concat(h["path"], F.lit(":"), F.get("pats", h["pat"])))
    )
    any_mode, found = F.col("mode") == "any", F.col("first").isNotNull()
    off = F.col("mode") == "off"
    verdict = F.when(off, "skipped").when(any_mode == found, "present").otherwise("missing")
    target = F.when(any_mode & found, F.col("first.path")).otherwise(F.col("label"))
    message = (
        F.when(off, "no source_grep patterns configured")
        .when(any_mode & found, F.concat(F.lit("matched "), F.get("pats", F.col("first.pat"))))
        .when(any_mode, F.concat(F.lit("none of "), "listed", F.lit(" found")))
        .when(found, "forbidden pattern(s) found")
        .otherwise("forbidden patterns absent")
    )
    return result.select(
        "project", "ctl", verdict.alias("verdict"), target.alias("target"), message.alias("message"),
        F.coalesce(offenders, _no_uncovered()).alias("uncovered"),
    )


# --- route_guard -----------------------------------------------------------------------


def _guard_lines(guard_sets: list[list[str]], radius: int) -> Column:
    """Per line that has a route a flag per guard set.

    The window of lines is cut inside the file row, once per distinct line,
    so no text is ever shuffled.
    """
    lines = F.split("content", "\n", -1)

    def flags(all_lines: Column, line: Column) -> Column:
        start = F.greatest(F.lit(1), line - radius)
        window = F.array_join(F.slice(all_lines, start, line + radius - start + 1), "\n")
        return let(
            window,
            lambda w: F.array(*[_any([holds(w, p) for p in guards]) for guards in guard_sets]),
        )

    route_lines = F.array_distinct(F.transform("facts", lambda r: r["line"]))
    return let(lines, lambda ls: let(route_lines, lambda rl: F.map_from_arrays(rl, F.transform(rl, lambda n: flags(ls, n)))))


def _guarded_files(sources: DataFrame, guard_sets: list[list[str]], radius: int) -> DataFrame:
    """Files with routes and, per line that has one, a flag per guard set."""
    if "by_line" in sources.columns:
        return sources.where(F.size("facts") > 0).select("project", "path", "lang_rank", "facts", "by_line")
    kept = once(files_with(sources, "routes").where(F.size("facts") > 0), "by_line", _guard_lines(guard_sets, radius))
    return kept.select("project", "path", language_rank().alias("lang_rank"), "facts", "by_line")


def routes_with_guards(sources: DataFrame, guard_sets: list[list[str]], radius: int = V.GUARD_RADIUS) -> DataFrame:
    """Every route with one flag per guard set: is a guard near its line."""
    return _guarded_files(sources, guard_sets, radius).select(
        "project", "path", "lang_rank", "by_line", F.posexplode("facts").alias("pos", "r")
    ).select(
        "project",
        F.col("r.route").alias("route"),
        F.col("r.method").alias("method"),
        F.col("path").alias("source_file"),
        F.col("r.line").alias("line"),
        F.struct(F.col("lang_rank").alias("lang"), "path", "pos").alias("ord"),
        F.element_at("by_line", F.col("r.line")).alias("guarded"),
    )


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _guard_rules(dets: list[dict]) -> tuple[list[list[str]], list[dict]]:
    """Distinct guard sets, and distinct rules (guard set, excluded paths) with their controls."""
    sets: list[list[str]] = []
    rules: list[dict] = []
    for d in dets:
        guards = (_as_list(d["detection"].get("guard_patterns")) or list(V.DEFAULT_GUARDS)) + V.ALWAYS_GUARDS
        if guards not in sets:
            sets.append(guards)
        excluded = [rx(p) for p in _as_list(d["detection"].get("exclude_path_patterns"))]
        same = [r for r in rules if r["set"] == sets.index(guards) and r["excluded"] == excluded]
        if not same:
            same = [{"rule": len(rules), "set": sets.index(guards), "excluded": excluded, "ctls": []}]
            rules += same
        same[0]["ctls"].append(d["ctl"])
    return sets, rules


def _judged_files(sources: DataFrame, config: DataFrame, sets: list[list[str]], rules: list[dict]) -> DataFrame:
    """(project, path, lang_rank, rule, n, bad): the routes of a file a rule misses, as an array."""
    files = _guarded_files(sources, sets, V.GUARD_RADIUS)
    public = config.select("project", F.transform("public_route_patterns", lambda p: F.concat(F.lit("(?Ud)"), p)).alias("public"))
    joined = files.join(public, "project", "left")

    def missed(rule: Column) -> Column:
        def bare(r: Column) -> Column:
            is_public = F.coalesce(F.exists("public", lambda p: F.rlike(r["route"], p)), F.lit(False))
            excluded = F.exists(rule["excluded"], lambda p: F.rlike(r["route"], p))
            return ~(is_public | F.get(F.element_at("by_line", r["line"]), rule["set"]) | excluded)

        item = lambda r: F.concat(r["method"], F.lit(" "), r["route"], F.lit(" ("), F.col("path"), F.lit(":"), r["line"].cast("string"), F.lit(")"))
        return F.transform(F.filter("facts", bare), item)

    table = _struct_array(rules, "rule:int,set:int,excluded:array")
    judged = F.transform(table, lambda c: F.struct(c["rule"].alias("rule"), missed(c).alias("bad")))
    return joined.select("project", "path", "lang_rank", F.size("facts").alias("n"), F.explode(judged).alias("j")).select(
        "project", "path", "lang_rank", "j.rule", "n", "j.bad"
    )


def judged_routes(sources: DataFrame, config: DataFrame, dets: list[dict]) -> DataFrame:
    """(project, ctl, source_file, item): every route a guard detection misses."""
    sets, rules = _guard_rules(dets)
    ctls = constant_map({r["rule"]: r["ctls"] for r in rules})
    return _judged_files(sources, config, sets, rules).select(
        "project", F.col("path").alias("source_file"), "rule", F.explode("bad").alias("item")
    ).select("project", F.explode(ctls[F.col("rule")]).alias("ctl"), "source_file", "item")


GUARD_BUCKETS = 64


def detect_route_guard(projects: DataFrame, sources: DataFrame, config: DataFrame, dets: list[dict]) -> DataFrame:
    """Counts and first offenders from one pass over the files.

    A project is first summed in buckets of files, so that one with very many
    files is spread over many tasks; the few rows kept per bucket are joined
    up afterwards.
    """
    sets, rules = _guard_rules(dets)
    bucket = F.pmod(F.xxhash64("path"), F.lit(GUARD_BUCKETS)).alias("bucket")
    few = F.slice("bad", 1, V.UNCOVERED_SHOWN)
    files = _judged_files(sources, config, sets, rules).select(
        "project", "rule", bucket, "n", F.size("bad").alias("n_bad"), F.struct("lang_rank", "path", few.alias("items")).alias("f")
    )
    whole = Window.partitionBy("project", "rule", "bucket")
    ranked = files.select(
        "project", "rule", "f", "n_bad",
        F.sum("n").over(whole).alias("n"),
        F.sum("n_bad").over(whole).alias("bad"),
        F.row_number().over(whole.orderBy(F.col("n_bad") == 0, "f")).alias("place"),
    ).where(F.col("place") <= V.UNCOVERED_SHOWN)
    first = F.col("place") == 1
    firsts = F.array_sort(F.collect_list(F.when(F.col("n_bad") > 0, F.col("f"))))  # at most buckets x 3 files
    counts = ranked.groupBy("project", "rule").agg(
        F.sum(F.when(first, F.col("n"))).alias("n"), F.sum(F.when(first, F.col("bad"))).alias("bad"), firsts.alias("firsts")
    )
    found = counts.withColumn("uncovered", F.slice(F.flatten(F.transform("firsts", lambda f: f["items"])), 1, V.UNCOVERED_SHOWN))
    asked = [{"ctl": c, "rule": r["rule"]} for r in rules for c in r["ctls"]]
    joined = _per_project(projects, asked, "ctl:int,rule:int").join(found, ["project", "rule"], "left")
    none, n, bad = F.col("n").isNull(), F.col("n").cast("string"), F.col("bad").cast("string")
    verdict = F.when(none, "skipped").when(F.col("bad") == 0, "present").when(F.col("bad") == F.col("n"), "missing").otherwise("partial")
    message = (
        F.when(none, "no routes discovered")
        .when(F.col("bad") == 0, F.concat(n, F.lit(" route(s) have guard evidence")))
        .otherwise(F.concat(bad, F.lit(" route(s) lack guard evidence")))
    )
    return joined.select(
        "project", "ctl", verdict.alias("verdict"), F.lit("routes").alias("target"), message.alias("message"),
        F.coalesce("uncovered", _no_uncovered()).alias("uncovered"),
    )


# --- evidence_doc, config_present, companion_config --------------------------------------


def detect_evidence(projects: DataFrame, evidence_index: DataFrame, files: DataFrame, as_of: str, dets: list[dict]) -> DataFrame:
    """evidence_index(project, evidence_key, path); files(project, path, mtime).

    ``as_of`` is the moment ages are measured at, an SQL timestamp text.
    """
    rows = [
        {
            "ctl": d["ctl"],
            "key": str(d["detection"].get("evidence_path_key") or ""),
            "max_age": int(d["detection"].get("max_age_days") or V.DEFAULT_MAX_AGE_DAYS),
        }
        for d in dets
    ]
    asked = _per_project(projects, rows, "ctl:int,key:string,max_age:int")
    index = evidence_index.select("project", F.col("evidence_key").alias("key"), "path").where(F.col("path") != "")
    stamped = files.select("project", "path", "mtime")
    joined = asked.join(index, ["project", "key"], "left").join(stamped, ["project", "path"], "left")
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("mtime")) / F.lit(86400e6)
    unknown, absent, stale = F.col("path").isNull(), F.col("mtime").isNull(), age > F.col("max_age")
    verdict = F.when(unknown | absent, "missing").when(stale, "partial").otherwise("present")
    message = (
        F.when(unknown, "evidence path key missing from config")
        .when(absent, "evidence document missing")
        .when(stale, F.concat(F.lit("evidence document stale ("), F.bround(age).cast("bigint").cast("string"), F.lit("d old)")))
        .otherwise("evidence document present and fresh")
    )
    return joined.select(
        "project", "ctl", verdict.alias("verdict"), F.coalesce("path", "key").alias("target"), message.alias("message"), _no_uncovered()
    )


def detect_config(projects: DataFrame, corpus: DataFrame, config_values: DataFrame, dets: list[dict]) -> DataFrame:
    """corpus(project, path, content); config_values(project, path, key, value)."""
    rows = []
    for d in dets:
        det = d["detection"]
        expected = det.get("required_value")
        rows.append(
            {
                "ctl": d["ctl"],
                "path": str(det.get("path") or ""),
                "key": str(det["required_key"]) if det.get("required_key") else None,
                "expected": None if expected is None else str(expected),
            }
        )
    for r in rows:
        r["key_"], r["expected_"] = r["key"] or "", r["expected"] or ""
        r["has_key"], r["has_expected"] = r["key"] is not None, r["expected"] is not None
    asked = _per_project(projects, rows, "ctl:int,path:string,key_:string,expected_:string,has_key:boolean,has_expected:boolean")
    paths = sorted({r["path"] for r in rows})
    named = [{"ctl": r["ctl"], "path": r["path"], "key_": r["key_"], "expected_": r["expected_"]} for r in rows]
    # the texts are tested where they lie; only the outcome is joined
    wanted = F.filter(_struct_array(named, "ctl:int,path:string,key_:string,expected_:string"), lambda q: q["path"] == F.col("path"))
    texts = (
        corpus.where(F.col("path").isin(paths))
        .select("project", "content", F.explode(wanted).alias("q"))
        .select(
            "project", "q.ctl",
            F.contains("content", F.col("q.key_")).alias("key_in_text"),
            F.contains("content", F.col("q.expected_")).alias("value_in_text"),
        )
    )
    looked = config_values.select("project", "path", F.col("key").alias("key_"), "value")
    joined = asked.join(texts, ["project", "ctl"], "left").join(looked, ["project", "path", "key_"], "left")
    absent = F.col("key_in_text").isNull()
    no_key = F.col("has_key") & F.col("value").isNull() & ~F.col("key_in_text")
    other = F.col("has_expected") & ~F.equal_null(F.col("value"), F.col("expected_")) & ~F.col("value_in_text")
    other = F.col("has_key") & other
    verdict = F.when(absent | no_key | other, "missing").otherwise("present")
    message = (
        F.when(absent, "config file missing")
        .when(~F.col("has_key"), "config file present")
        .when(no_key, F.concat(F.lit("required key "), "key_", F.lit(" missing")))
        .when(other, F.concat("key_", F.lit(" does not equal "), "expected_"))
        .otherwise(F.concat("key_", F.lit(" present")))
    )
    return joined.select("project", "ctl", verdict.alias("verdict"), F.col("path").alias("target"), message.alias("message"), _no_uncovered())


def detect_companion(projects: DataFrame, files: DataFrame, dets: list[dict], configured: DataFrame | None = None) -> DataFrame:
    """First candidate place of a companion tool's configuration that exists.

    ``configured`` (project, tool, path) holds places set per project; they
    come before the fixed ones.
    """
    rows = [
        {"ctl": d["ctl"], "tool": str(d["detection"].get("tool") or "").lower()}
        for d in dets
    ]
    places = [
        {"tool": t, "rank": i + 1, "place": p}
        for t in sorted({r["tool"] for r in rows})
        for i, p in enumerate(V.COMPANION_PATHS.get(t, [f"{t}.yaml"]))
    ]
    fixed = _struct_array(places, "tool:string,rank:int,place:string")

    def inside(path: Column, place: Column) -> Column:
        return (path == place) | path.startswith(F.concat(place, F.lit("/")))

    found = files.select("project", "path").select(
        "project", F.explode(F.filter(fixed, lambda q: inside(F.col("path"), q["place"]))).alias("q")
    ).select("project", "q.tool", "q.rank", "q.place")
    if configured is not None:
        clean = configured.where(F.col("path").isNotNull()).select(
            "project", F.col("tool"), F.regexp_replace("path", r"^\./|/$", "").alias("place")
        )
        every_place = files.select("project", F.explode(_ancestors(F.col("path"))).alias("place")).distinct()
        own = clean.join(every_place, ["project", "place"], "left_semi").select("project", "tool", F.lit(0).alias("rank"), "place")
        found = found.unionByName(own)
    first = found.groupBy("project", "tool").agg(F.min(F.struct("rank", "place")).alias("first"))
    joined = _per_project(projects, rows, "ctl:int,tool:string").join(first, ["project", "tool"], "left")
    there = F.col("first").isNotNull()
    return joined.select(
        "project", "ctl", F.when(there, "present").otherwise("missing").alias("verdict"),
        F.coalesce("first.place", "tool").alias("target"),
        F.concat("tool", F.when(there, " companion config present").otherwise(" companion config missing")).alias("message"),
        _no_uncovered(),
    )


def _ancestors(path: Column) -> Column:
    """The path and every folder above it."""
    return let(
        F.split(path, "/", -1),
        lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


# --- one pass over the texts ---------------------------------------------------------------


def text_stream(
    corpus: DataFrame,
    is_source: Column,
    controls: list[dict] | None = None,
    path_rules: dict | None = None,
    key_format: str = V.PACT_KEY_FORMAT,
) -> DataFrame:
    """What checks and controls need from each file's text, without the text, in one pass over the files.

    (project, path, lang, is_source, signals, facts, by_line, hits): the
    signals of the source checks, routes with the flags of their guards, and
    the patterns of grep controls that the file meets.  Syntax is looked at in
    source files only, and only where a decorator can be.  Stage it once and pass it to ``run_checks`` and
    ``run_compliance`` (with the same controls) as table ``texts``.
    """
    dets = number_detections(packaged_controls() if controls is None else controls)
    active = [d for d in dets if d["detection"]["method"] == "source_grep" and _grep_params(d)[0]]
    guards = [d for d in dets if d["detection"]["method"] == "route_guard"]
    none = F.array().cast("array<struct<ctl:int,pat:int>>")
    files = once(corpus.select("project", "path", "lang", "content"), "is_source", is_source)
    # of the syntax only routes are asked for, which are decorated functions
    files = with_syntax(files, F.col("is_source") & F.col("content").contains("@"))
    scanned = F.struct(
        F.when(F.col("is_source"), fact_array("routes")).alias("facts"),
        F.when(F.col("is_source") & (F.col("lang") == "python"), source_signals(key_format)).alias("signals"),
        F.coalesce(_grep_array(active, path_rules), none).alias("hits") if active else none.alias("hits"),
    )
    files = once(files, "scanned", scanned).select("project", "path", "lang", "content", "is_source", "scanned.*")
    sets = _guard_rules(guards)[0]
    lines = F.when(F.size("facts") > 0, _guard_lines(sets, V.GUARD_RADIUS)) if sets else F.lit(None).cast("map<int,array<boolean>>")
    return once(files, "by_line", lines).select(
        "project", "path", "lang", language_rank().alias("lang_rank"), "is_source", "signals", "facts", "by_line", "hits"
    )


def control_offenders(tables: dict[str, DataFrame], controls: list[dict], path_rules: dict | None = None) -> DataFrame:
    """(project, control, item): everything that a detection finds wrong, a row each; ``uncovered`` shows the first few.

    Registry fields that miss what is asked, hits of forbidden patterns,
    routes without a guard; ``tables`` as for ``detect``.
    """
    dets = number_detections(controls)
    texts = tables.get("texts")
    of = lambda *methods: [d for d in dets if d["detection"]["method"] in methods]
    frames = []
    if registry := of("ledger_obligation", "ledger_tier_encrypted"):
        frames.append(registry_offenders(tables["registry_fields"], registry).select("project", "ctl", "item"))
    if forbidden := [d for d in of("source_grep") if _grep_params(d)[0] and not _as_list(d["detection"].get("any_of"))]:
        hits = _hit_rows(texts) if texts is not None else grep_hits(tables["corpus"], forbidden, path_rules)
        pats = constant_map({d["ctl"]: _grep_params(d)[0] for d in forbidden})
        hits = hits.where(F.col("ctl").isin([d["ctl"] for d in forbidden]))
        frames.append(hits.select("project", "ctl", F.concat("path", F.lit(":"), F.get(pats[F.col("ctl")], F.col("pat"))).alias("item")))
    if guards := of("route_guard"):
        routes = judged_routes(tables["sources"] if texts is None else texts, tables["project_config"], guards)
        frames.append(routes.select("project", "ctl", "item"))
    control_of = constant_map({d["ctl"]: d["control"] for d in dets})
    if not frames:
        return tables["projects"].select("project", F.lit(0).alias("control"), F.lit("").alias("item")).where(F.lit(False))
    rows = union_all(frames)
    if (fits := _in_scope([controls[d["control"]] for d in dets], "ctl")) is not None:
        rows = rows.where(fits)
    return rows.select("project", control_of[F.col("ctl")].alias("control"), "item")


# --- dispatch, applicability, corroboration --------------------------------------------------


def number_detections(controls: list[dict]) -> list[dict]:
    """Primary and corroborating detections, each with its own number ``ctl``."""
    dets = []
    for i, c in enumerate(controls):
        for slot, det in enumerate([c["detection"], *c.get("corroborating_detection", [])]):
            dets.append({"ctl": len(dets), "control": i, "slot": slot, "id": c["id"], "detection": det,
                         "classification_tier": c.get("classification_tier"), "only": c.get("only")})
    return dets


def detect(tables: dict[str, DataFrame], dets: list[dict], as_of: str, path_rules: dict | None = None) -> DataFrame:
    """Every detection for every project, one branch per method in use.

    ``tables``: projects, corpus, sources, registry_fields, project_config,
    evidence_index, file_meta and, where used, config_values, companion_paths;
    ``texts`` is the ``text_stream`` of the same controls, if there is one.
    """
    projects = tables["projects"]
    texts = tables.get("texts")
    by_method: dict[str, list[dict]] = {}
    for d in dets:
        by_method.setdefault(d["detection"]["method"], []).append(d)
    frames = []
    registry = by_method.pop("ledger_obligation", []) + by_method.pop("ledger_tier_encrypted", [])
    if registry:
        frames.append(detect_registry(projects, tables["registry_fields"], registry))
    if "source_grep" in by_method:
        frames.append(detect_grep(projects, tables["corpus"] if texts is None else texts, by_method.pop("source_grep"), path_rules))
    if "route_guard" in by_method:
        frames.append(detect_route_guard(projects, tables["sources"] if texts is None else texts, tables["project_config"], by_method.pop("route_guard")))
    if "evidence_doc" in by_method:
        frames.append(detect_evidence(projects, tables["evidence_index"], tables["file_meta"], as_of, by_method.pop("evidence_doc")))
    if "config_present" in by_method:
        frames.append(detect_config(projects, tables["corpus"], tables["config_values"], by_method.pop("config_present")))
    if "companion_config" in by_method:
        frames.append(detect_companion(projects, tables["corpus"], by_method.pop("companion_config"), tables.get("companion_paths")))
    constant = [d for group in by_method.values() for d in group]
    if constant:
        frames.append(_constant(projects, constant))
    return union_all([f.select(*RESULT) for f in frames])


def _constant(projects: DataFrame, dets: list[dict]) -> DataFrame:
    """Methods without data: the judgement method and unknown ones."""
    rows = []
    for d in dets:
        method = d["detection"]["method"]
        if method in V.DETECTION_METHODS:
            verdict, message = "skipped", f"{method} skipped; pass --with-llm to enable"
        elif d["slot"] == 0:
            verdict, message = "missing", f"unknown detector: {method}"
        else:
            verdict, message = "unknown", f"unknown corroborating detector: {method}"
        rows.append({"ctl": d["ctl"], "verdict": verdict, "target": d["id"], "message": message})
    return _per_project(projects, rows, "ctl:int,verdict:string,target:string,message:string").withColumn("uncovered", _no_uncovered())


def control_applicability(projects: DataFrame, registries: DataFrame, fields: DataFrame, config: DataFrame, controls: list[dict]) -> DataFrame:
    """(project, control, target, message) for each control that is skipped.

    The first reason counts: no registry, missing tags, no field of the tiers.
    """
    rows = []
    for i, c in enumerate(controls):
        app = c.get("applicability") or {}
        if not any(app.get(k) for k in ("requires_ledger_registry", "tags", "data_tiers")):
            continue
        rows.append(
            {
                "control": i,
                "id": c["id"],
                "needs_registry": bool(app.get("requires_ledger_registry")),
                "tags": sorted(set(app.get("tags") or [])),
                "tiers": sorted({str(t).lower() for t in app.get("data_tiers") or []}),
            }
        )
    if not rows:
        return projects.select("project", F.lit(0).alias("control"), F.lit("").alias("target"), F.lit("").alias("message")).where(F.lit(False))
    wanted = sorted({t for r in rows for t in r["tiers"]})
    # only tiers some control asks for are kept, so the list per project is bounded
    tier = F.lower(F.coalesce("classification", F.lit("")))
    tiers = (
        fields.where("is_dict").where(tier.isin(wanted)).groupBy("project").agg(F.collect_set(tier).alias("present"))
        if wanted
        else fields.select("project", F.array().cast("array<string>").alias("present")).where(F.lit(False))
    )
    asked = _per_project(projects, rows, "control:int,id:string,needs_registry:boolean,tags:array,tiers:array")
    joined = (
        asked.join(registries.select("project", F.lit(True).alias("has_registry")).distinct(), "project", "left")
        .join(config.select("project", "project_tags"), "project", "left")
        .join(tiers, "project", "left")
    )
    none = F.array().cast("array<string>")
    no_registry = F.col("needs_registry") & F.col("has_registry").isNull()
    no_tags = F.size(F.array_except("tags", F.coalesce("project_tags", none))) > 0
    no_tier = (F.size("tiers") > 0) & ~F.arrays_overlap("tiers", F.coalesce("present", none))
    message = (
        F.when(no_registry, "control requires Ledger registry")
        .when(no_tags, F.concat(F.lit("missing project tag(s): "), F.array_join("tags", ", ")))
        .when(no_tier, F.concat(F.lit("no Ledger fields for tier(s): "), F.array_join("tiers", ", ")))
    )
    target = F.when(no_registry, "ledger").when(no_tags, F.col("id")).otherwise("ledger")
    return joined.select("project", "control", target.alias("target"), message.alias("message")).where(F.col("message").isNotNull())


def evaluate_controls(tables: dict[str, DataFrame], controls: list[dict], as_of: str, path_rules: dict | None = None) -> DataFrame:
    """(project, control, verdict, target, message, uncovered) of every control.

    Skipped by applicability, else the primary detection, else - if that one
    is present - the first corroborating detection that is not.
    """
    dets = number_detections(controls)
    found = detect(tables, dets, as_of, path_rules)
    if (fits := _in_scope([controls[d["control"]] for d in dets], "ctl")) is not None:
        found = found.where(fits)
    slots = {d["ctl"]: d for d in dets}
    outcome = F.struct("verdict", "target", "message", "uncovered")
    if any(d["slot"] for d in dets):
        control_of = constant_map({d["ctl"]: d["control"] for d in dets})
        slot_of = constant_map({d["ctl"]: d["slot"] for d in dets})
        tagged = found.select("project", control_of[F.col("ctl")].alias("control"), slot_of[F.col("ctl")].alias("slot"), outcome.alias("o"))
        combined = tagged.groupBy("project", "control").agg(
            F.min(F.when(F.col("slot") == 0, F.col("o"))).alias("p"),
            F.min(F.when((F.col("slot") > 0) & (F.col("o.verdict") != "present"), F.struct("slot", "o"))).alias("c"),
        )
        weak = (F.col("p.verdict") == "present") & F.col("c").isNotNull()
        unknown = F.col("c.o.verdict") == "unknown"
        results = combined.select(
            "project",
            "control",
            F.when(weak, "partial").otherwise(F.col("p.verdict")).alias("verdict"),
            F.when(weak & ~unknown, F.col("c.o.target")).otherwise(F.col("p.target")).alias("target"),
            F.when(weak & unknown, F.col("c.o.message"))
            .when(weak, F.concat(F.lit("corroborating check: "), "c.o.message"))
            .otherwise(F.col("p.message")).alias("message"),
            F.when(weak, F.col("c.o.uncovered")).otherwise(F.col("p.uncovered")).alias("uncovered"),
        )
    else:
        control_of = constant_map({c: d["control"] for c, d in slots.items()})
        results = found.select("project", control_of[F.col("ctl")].alias("control"), "verdict", "target", "message", "uncovered")
    skipped = control_applicability(
        tables["projects"], tables["registries"], tables["registry_fields"], tables["project_config"], controls
    ).select("project", "control", F.struct("target", "message").alias("skip"))
    joined = results.join(skipped, ["project", "control"], "left")
    off = F.col("skip").isNotNull()
    return joined.select(
        "project",
        "control",
        F.when(off, "skipped").otherwise(F.col("verdict")).alias("verdict"),
        F.when(off, F.col("skip.target")).otherwise(F.col("target")).alias("target"),
        F.when(off, F.col("skip.message")).otherwise(F.col("message")).alias("message"),
        F.when(off, F.array().cast("array<string>")).otherwise(F.col("uncovered")).alias("uncovered"),
    )


def verdict_to_check(results: DataFrame, controls: list[dict]) -> DataFrame:
    """Verdicts as check rows; the tool is the framework."""
    rows = [{"framework": c["framework"], "id": c["id"], "severity": c.get("severity", "must")} for c in controls]
    c = F.get(constant_rows(rows, ["framework", "id", "severity"]), F.col("control"))
    joined = results.withColumn("c", c)
    must = F.col("c.severity") == "must"
    status = (
        F.when(F.col("verdict") == "present", "PASS")
        .when(F.col("verdict") == "partial", "WARN")
        .when(F.col("verdict") == "skipped", "INFO")
        .when(must, "FAIL")
        .otherwise("WARN")
    )
    severity = F.when(status != "PASS", status).when(must, "FAIL").otherwise("WARN")
    message = F.when(
        F.size("uncovered") > 0,
        F.concat("message", F.lit("; uncovered: "), F.array_join(F.slice("uncovered", 1, V.UNCOVERED_SHOWN), ", ")),
    ).otherwise(F.col("message"))
    order = F.struct(
        F.lit(len(V.CHECK_TOOLS)).alias("tool"), F.lit(0).alias("section"), F.col("c.framework").alias("path"),
        F.lit(0).alias("step"), F.col("control").cast("bigint").alias("pos"), F.lit(0).alias("sub"),
    )
    return joined.select(
        "project", F.col("c.framework").alias("tool"), F.col("c.id").alias("check_id"), "target",
        severity.alias("severity"), status.alias("status"), message.alias("message"), order.alias("ord"),
    )


def chosen_controls(controls: list[dict] | None = None, frameworks: list[str] | None = None) -> list[dict]:
    """The controls (default: the packaged ones) of the chosen frameworks."""
    wanted = [f.lower() for f in frameworks or []]
    return [c for c in (packaged_controls() if controls is None else controls) if not wanted or c["framework"] in wanted]


def run_compliance(
    tables: dict[str, DataFrame],
    as_of: str,
    controls: list[dict] | None = None,
    frameworks: list[str] | None = None,
    path_rules: dict | None = None,
) -> DataFrame:
    """Check rows of all controls of the chosen frameworks, in slug order."""
    chosen = chosen_controls(controls, frameworks)
    if not chosen:
        return _no_checks(tables["projects"])
    return verdict_to_check(evaluate_controls(tables, chosen, as_of, path_rules), chosen)


def _no_checks(projects: DataFrame) -> DataFrame:
    texts = [F.lit("").alias(c) for c in CHECK_COLUMNS if c not in ("project", "ord")]
    return projects.select("project", *texts, check_order(V.CHECK_TOOLS[0], 0).alias("ord")).where(F.lit(False))
