"""Queries of the maps, the reports and the records' checks, each calling the operator, with SQL.

The maps are of the tree that code_queries writes from the documents; the SQL reads the same tree by patterns of its own. The
records (statuses, settings, artifacts) are made of the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import code_queries as code
from quarry.functions import paths
from quarry.operators import corpus_checks, graph, report, run_checks
from quarry.plans import audit, maps
from quarry.session import materialize
from quarry.sources import records, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MAPS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _maps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The maps of the tree, made once for an application. The guard on open conflicts is for real trees, so it stays out."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _MAPS:
        c = code.context(spark, sf_dir)
        s = materialize(spark, maps.structural(spark, c.files, c.facts), "structural")
        r = materialize(spark, maps.runtime(c.facts), "runtime")
        k = materialize(spark, maps.contracts(c.facts), "contracts")
        a = materialize(spark, maps.authority(c.facts, SEED), "authority")
        conf = materialize(spark, maps.conflicts(spark, s, r, k, a), "conflicts")
        hot = materialize(spark, maps.hotspots(s, r, k, a, conf, _churn(c.files)), "hotspots")
        _MAPS[key] = {"structural": s, "runtime": r, "contracts": k, "authority": a, "conflicts": conf, "hotspots": hot, "findings": materialize(spark, maps.findings(s, r, k, a, conf, hot), "findings")}
    return _MAPS[key]


SEED = [{"authority_domain": "shared_state", "target_file_patterns": ["data/shared_*.json"], "allowed_writers": []}]


def _churn(files: DataFrame) -> DataFrame:
    """Changes of each file: its lines added, none deleted."""
    return files.select("path", F.length("text").cast("int").alias("added"), F.lit(0).alias("deleted"))


def _k(path: str) -> int:
    return code.number(path)


@query(code.SQL_TREE + r""", i AS (SELECT path, regexp_extract(line, '^\s*from ([\w.]+) import', 1) AS m, regexp_extract(line, '^\s*from [\w.]+ import (.*)$', 1) AS names, regexp_extract(line, '^\s*import (.*)$', 1) AS plain FROM py),
one AS (SELECT path, unnest(string_split(regexp_replace(plain, '#.*$', ''), ',')) AS n FROM i WHERE plain <> ''), two AS (SELECT path, m, unnest(string_split(regexp_replace(names, '#.*$', ''), ',')) AS n FROM i WHERE m <> '')
SELECT DISTINCT path, name FROM (SELECT path, regexp_extract(trim(n), '^[\w.]+', 0) AS name FROM one UNION ALL SELECT path, m FROM two UNION ALL SELECT path, m || '.' || regexp_extract(trim(n), '^\w+', 0) FROM two)""")
def tree_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the tree's Python files (without those whose text has no code in every line)."""
    f = code.context(spark, sf_dir).facts
    return _plain(f.where("fact = 'import'")).select("path", "name").distinct()


def _plain(f: DataFrame) -> DataFrame:
    """Without the plants whose strings hold code, which the SQL's patterns can't tell from code."""
    return f.where(F.col("path").endswith(".py") & ~F.col("path").rlike("^core/(bad|d|e)"))


@query(code.SQL_TREE + r"""SELECT path, line_no::INT AS line, regexp_extract(line, '(?:def|class) (\w+)', 1) AS name, CASE WHEN regexp_matches(line, '^\s*class ') THEN 'class' ELSE 'function' END AS kind,
CASE WHEN regexp_matches(line, '(?:def|class) _') THEN 'private' ELSE 'public' END AS visibility FROM py WHERE regexp_matches(line, '^\s*(?:async )?(?:def|class) \w')""")
def tree_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with their kind and visibility."""
    f = _plain(code.context(spark, sf_dir).facts.where("fact = 'symbol'"))
    return f.select("path", "line", "name", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["visibility"].alias("visibility"))


@query(code.SQL_TREE + r"""SELECT path, line_no::INT AS line, CASE WHEN regexp_matches(line, 'except\s*:') THEN '' ELSE regexp_extract(line, 'except (\w+)', 1) END AS types FROM py WHERE regexp_matches(line, '^\s*except\b')""")
def tree_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers and what they catch."""
    return _plain(code.context(spark, sf_dir).facts.where("fact = 'handler'")).select("path", "line", F.col("name").alias("types"))


@query(code.SQL_TREE + r"""SELECT DISTINCT path, regexp_extract(line, 'os\.environ(?:\.get)?[\[(][''"](\w+)', 1) AS name FROM py WHERE regexp_matches(line, 'os\.environ(?:\.get)?[\[(]')""")
def tree_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment variables that files read."""
    return _plain(code.context(spark, sf_dir).facts.where("fact = 'env'")).select("path", "name").distinct()


@query(code.SQL_TREE + r"""SELECT path, (len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS line_count FROM files WHERE text <> ''""")
def tree_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file that has any."""
    return code.context(spark, sf_dir).lines.groupBy("path").agg(F.count("*").alias("line_count"))


@query(code.SQL_TREE + f""", r AS (SELECT d.doc_id, path, partner FROM d JOIN files ON d.doc_id = files.doc_id WHERE d.k = {_k("ring/r{id}.py")}),
u AS (SELECT path FROM files WHERE k IN ({_k("core/user{id}.py")}, {_k("tests/test_e{id}.py")}, {_k("tests/test_f{id}.py")}))
SELECT a.path AS src, b.path AS dst FROM r a JOIN r b ON a.partner = b.doc_id UNION ALL SELECT path, 'core/known.py' FROM u WHERE path LIKE 'core/user%'
UNION ALL SELECT path, x FROM u, (VALUES ('core/known.py'), ('core/__init__.py')) v(x) WHERE path LIKE 'tests/%'""")
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that name files of the tree."""
    c = code.context(spark, sf_dir)
    return maps.resolve_imports(c.facts, c.files)


_RING = f""", r AS (SELECT d.doc_id, path, partner FROM d JOIN files ON d.doc_id = files.doc_id WHERE d.k = {_k("ring/r{id}.py")}),
c AS (SELECT a.path, least(a.path, b.path) AS component FROM r a JOIN r b ON a.partner = b.doc_id)"""


@query(code.SQL_TREE + _RING + " SELECT path AS file, component, 2::INT AS n FROM c")
def map_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on import cycles, with their cycle."""
    s = _maps(spark, sf_dir)["structural"]
    return s.where("component IS NOT NULL").select("file", "component", F.size("cycles").alias("n"))


@query(code.SQL_TREE + _RING + " SELECT path AS file, component AS \"group\" FROM c")
def map_cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of files whose cycles overlap."""
    return audit.cycle_groups(spark, _maps(spark, sf_dir)["structural"])


@query("""WITH g AS (SELECT doc_id // 3 AS g, 'loop.y' || doc_id AS m FROM documents)
SELECT 'loop/' || substr(min(m), 6) || '.py' AS path, 2::INT AS line_no, '3 modules: ' || string_agg(m, ', ' ORDER BY m) AS detail FROM g GROUP BY g HAVING count(*) = 3""")
def map_import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textual import cycles of a tree in which each document is a module that imports the next one of its three; what stands
    in from the margin doesn't count."""
    d = F.col("doc_id")
    next_ = F.when(d % 3 == 2, d - 2).otherwise(d + 1).cast("string")
    base = F.when(F.floor(d / 3) % 2 == 0, F.lit(".y")).otherwise(F.lit("loop.y"))
    text = F.concat(F.lit("import os\nfrom "), base, next_, F.lit(" import go\ndef f():\n    from loop.y1 import go\n"))
    docs = _table(spark, sf_dir, "documents")
    lines = tables.lines(docs.select(F.concat(F.lit("loop/y"), d.cast("string"), F.lit(".py")).alias("path"), text.alias("text")))
    return corpus_checks.import_cycles(spark, lines).select("path", F.col("line_no").cast("int").alias("line_no"), "detail")


@query(code.SQL_TREE + _RING + f""", big AS (SELECT path FROM files WHERE k = {_k("tools/long{id}.py")}), bad AS (SELECT path FROM files WHERE k IN ({_k("core/bad{id}.py")}, {_k("web/a{id}.js")}, {_k("web/s{id}.js")})),
hub AS (SELECT 'core/known.py' AS path WHERE (SELECT count(*) FROM files WHERE k IN ({_k("core/user{id}.py")}, {_k("tests/test_e{id}.py")}, {_k("tests/test_f{id}.py")})) > 10),
pkg AS (SELECT 'core/__init__.py' AS path WHERE (SELECT count(*) FROM files WHERE k IN ({_k("tests/test_e{id}.py")}, {_k("tests/test_f{id}.py")})) > 10)
SELECT path AS file, 'cycle_member' AS tag FROM c UNION ALL SELECT path, 'large_file' FROM big UNION ALL SELECT path, 'unparseable' FROM bad UNION ALL SELECT path, 'fan_in' FROM hub UNION ALL SELECT path, 'fan_in' FROM pkg""")
def map_structural_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of files."""
    return _maps(spark, sf_dir)["structural"].select("file", F.explode("tags").alias("tag"))


@query(code.SQL_TREE + f""", m AS (SELECT doc_id, path FROM files WHERE k = {_k("tools/main{id}.py")})
SELECT path || '::__main__' AS node, path AS defined_in, 'main_entrypoint' AS kind FROM m UNION ALL SELECT path || '::main', path, 'entry_function' FROM m""")
def map_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points of the runtime map."""
    r = _maps(spark, sf_dir)["runtime"]
    return r.where("kind IN ('main_entrypoint') OR (kind = 'entry_function' AND defined_in LIKE 'tools/main%')").select("node", "defined_in", "kind")


@query(code.SQL_TREE + f"""SELECT path || '::main' AS node, 'API_KEY_' || doc_id AS env FROM files WHERE k = {_k("tools/main{id}.py")} UNION ALL SELECT path || '::' || f, e FROM files, (VALUES ('f', 'TOKEN_A'), ('g', 'TOKEN_B'), ('h', 'TOKEN_C'), ('h', 'TOKEN_D')) v(f, e) WHERE k = {_k("core/env{id}.py")}""")
def map_runtime_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and the settings they depend on."""
    return _maps(spark, sf_dir)["runtime"].select("node", F.explode("depends_on_env").alias("env"))


_ORDERS = code.SQL_TREE + f""", o AS (SELECT path, k FROM files WHERE k IN ({_k("core/ca{id}.py")}, {_k("tools/cb{id}.py")})), top AS (SELECT min(path) AS path, min_by(k, path) AS k FROM o)"""


@query(_ORDERS + " SELECT 'Order' AS entity, (SELECT path FROM top) AS canonical_path, count(*)::BIGINT AS n_variants FROM o HAVING count(*) > 0")
def map_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their canonical definition and how many there are."""
    return _maps(spark, sf_dir)["contracts"].select("entity", "canonical_path", "n_variants")


@query(_ORDERS + f""", v AS (SELECT o.path, o.k FROM o, top WHERE o.k <> top.k) SELECT 'Order' AS entity, unnest(CASE WHEN k = {_k("tools/cb{id}.py")} THEN ['extra:' || path || ':c', 'missing:' || path || ':b', 'annotation:' || path || ':a'] ELSE ['extra:' || path || ':b', 'missing:' || path || ':c', 'annotation:' || path || ':a'] END) AS flag FROM v""")
def map_contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of variants from the canonical definition."""
    return _maps(spark, sf_dir)["contracts"].select("entity", F.explode("drift_flags").alias("flag"))


_WRITES = code.SQL_TREE + f""", w AS (SELECT path, CASE k WHEN {_k("core/aw{id}.py")} THEN 'aw' ELSE 'common' END AS what, doc_id FROM files WHERE k IN ({_k("core/sa{id}.py")}, {_k("tools/sb{id}.py")}, {_k("core/aw{id}.py")})),
two_roots AS (SELECT count(DISTINCT split_part(path, '/', 1)) >= 2 AND count(*) >= 2 AS ok FROM w WHERE what = 'common')"""


@query(_WRITES + """ SELECT 'shared_write:data/common.json' AS authority_domain, 'data/common.json' AS target, path AS writer, 'shared_write' AS kind FROM w, two_roots WHERE what = 'common' AND ok
UNION ALL SELECT 'shared_state', 'data/shared_' || doc_id || '.json', path, 'illegal_write' FROM w WHERE what = 'aw'""")
def map_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains, targets and writers: seeded ones, and targets that writers of two roots share."""
    return _maps(spark, sf_dir)["authority"].select("authority_domain", "target", "writer", "kind")


@query(_WRITES + _RING + f""", o AS (SELECT path, k FROM files WHERE k IN ({_k("core/ca{id}.py")}, {_k("tools/cb{id}.py")}))
SELECT 'shared_state' AS domain, 'high' AS severity, count(*)::BIGINT AS n FROM w WHERE what = 'aw' HAVING count(*) > 0
UNION ALL SELECT 'shared_write', 'medium', 1 FROM two_roots WHERE ok UNION ALL SELECT 'contract_drift', 'medium', 1 FROM o HAVING count(DISTINCT k) = 2
UNION ALL SELECT 'contract_structural', 'medium', (count(*) - 1)::BIGINT FROM o HAVING count(*) > 1
UNION ALL SELECT 'env_coupling', 'low', (count(*) FILTER (WHERE k = {_k("tools/main{id}.py")}) + 3 * count(*) FILTER (WHERE k = {_k("core/env{id}.py")}))::BIGINT FROM files HAVING count(*) FILTER (WHERE k IN ({_k("tools/main{id}.py")}, {_k("core/env{id}.py")})) > 0""")
def map_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open conflicts by domain and severity."""
    c = _maps(spark, sf_dir)["conflicts"]
    return c.where("conflict_status = 'open'").groupBy("domain", "severity").agg(F.count("*").alias("n"))


@query(code.SQL_TREE + f""", m AS (SELECT doc_id, path FROM files WHERE k = {_k("tools/main{id}.py")}), e AS (SELECT count(*) AS n FROM files WHERE k = {_k("core/env{id}.py")}), o AS (SELECT count(DISTINCT k) AS n FROM files WHERE k IN ({_k("core/ca{id}.py")}, {_k("tools/cb{id}.py")}))
SELECT 'runtime_config_risk' AS category, 'API_KEY_' || doc_id AS subject, 'MEDIUM' AS severity, 'new' AS finding_status FROM m
UNION ALL SELECT 'runtime_config_risk', t, 'MEDIUM', 'new' FROM e, (VALUES ('TOKEN_A'), ('TOKEN_B'), ('TOKEN_C'), ('TOKEN_D')) v(t) WHERE n > 0""")
def map_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings synthesized from the maps."""
    return _maps(spark, sf_dir)["findings"].select("category", "subject", "severity", "finding_status")


@query(code.SQL_TREE + _RING + f""", o AS (SELECT path, k FROM files WHERE k IN ({_k("core/ca{id}.py")}, {_k("tools/cb{id}.py")}))
SELECT path AS target, greatest(0, least(130, 10 + 10 + least(25, floor(ln(1 + length(text)) * 4))::INT - 5))::INT AS hotspot_score FROM files WHERE k = {_k("tools/long{id}.py")}
UNION ALL SELECT path, greatest(0, least(130, 10 + least(25, floor(ln(1 + length(text)) * 4))::INT - 5))::INT FROM files WHERE k = {_k("core/k{id}.py")}""")
def map_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of large files and of plain ones without a test."""
    h = _maps(spark, sf_dir)["hotspots"]
    return h.where("target LIKE 'tools/long%' OR target RLIKE '^core/k[0-9]+[.]py$'").select("target", "hotspot_score")


@query(f"SELECT severity, split_part(check_id, '.', 1) AS category, count(*)::BIGINT AS n FROM ({' UNION ALL '.join(code.oracles().values())}) GROUP BY 1, 2")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of findings by severity and category, over the marked checks."""
    return report.counts(_marked(spark, sf_dir))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.found(spark, sf_dir).where(F.col("check_id").isin(*code.CHECKS))


_ALL_FOUND = f"SELECT * FROM ({' UNION ALL '.join(code.oracles().values())})"


@query(f"WITH f AS ({_ALL_FOUND}) SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL'))::BIGINT AS high, count(*) FILTER (WHERE severity = 'MEDIUM')::BIGINT AS medium, count(*) FILTER (WHERE severity IN ('LOW', 'INFO'))::BIGINT AS low FROM f")
def report_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's summary row."""
    return report.audit_summary(_marked(spark, sf_dir))


@query(f"WITH f AS ({_ALL_FOUND}) SELECT check_id, count(*)::BIGINT AS n FROM f GROUP BY check_id ORDER BY n DESC, check_id LIMIT 25")
def report_top_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 checks with most findings."""
    return report.top_checks(_marked(spark, sf_dir), 25)


@query(f"WITH f AS ({_ALL_FOUND}) SELECT check_id, path, line_no, severity FROM f WHERE severity IN ('HIGH', 'CRITICAL')")
def report_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at or above HIGH."""
    return report.floor(_marked(spark, sf_dir), "HIGH").select("check_id", "path", F.col("line_no").cast("int").alias("line_no"), "severity")


@query(f"WITH f AS ({_ALL_FOUND}) SELECT check_id, path, line_no, severity FROM f WHERE severity = 'CRITICAL' ORDER BY check_id, path, line_no LIMIT 20")
def report_first_of_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 findings of the highest severity."""
    return report.first_of_worst(_marked(spark, sf_dir)).select("check_id", "path", F.col("line_no").cast("int").alias("line_no"), "severity")


@query(f"WITH f AS ({_ALL_FOUND}) SELECT check_id, path, line_no, severity FROM f WHERE NOT (check_id = 'secrets_scan' AND path LIKE 'core/line%')")
def report_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings left after an allowlist of the secrets, written and read as entries."""
    found = report.identified(_marked(spark, sf_dir))
    entries = report.entry(found.where("check_id = 'secrets_scan'"), "not a real password", "reviewed by hand", "code", "2024-01-01")
    left = report.allowed(found, report.upsert(entries.limit(0), entries), code.context(spark, sf_dir).files, "2024-02-01")
    return left.select("check_id", "path", F.col("line_no").cast("int").alias("line_no"), "severity")


# --- records


@query(r"SELECT 'edit_consistency' AS check_id, doc_id::VARCHAR AS path FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '^[A-Z]')")
def record_edit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return run_checks.edit_consistency(docs, "^[A-Z]").select("check_id", "path")


@query("SELECT 'mutation_verified' AS check_id, doc_id::VARCHAR AS path FROM documents WHERE text IS NULL OR sha256(text) <> sha256(lower(text))")
def record_mutation_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return run_checks.mutation_verified(docs.select("path", F.sha2(F.lower("text"), 256).alias("hash")), docs.where("text IS NOT NULL")).select("check_id", "path")


@query("SELECT 'success_proof' AS check_id, doc_id::VARCHAR AS path, 'review' AS detail FROM labels WHERE quality = 1 AND toxic = 1")
def record_success_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("run"), (F.col("quality") == 1).alias("ok"), F.lit("done").alias("phase"), F.create_map(F.lit("log"), F.lit("x"), F.lit("review"), F.when(F.col("toxic") == 0, "y").otherwise("")).alias("fields"))
    return run_checks.success_proof(rows, ["log", "review"]).select("check_id", "path", "detail")


@query("SELECT 'source_truthfulness' AS check_id, doc_id::VARCHAR AS path FROM documents WHERE source IS DISTINCT FROM lang")
def record_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("label"), F.col("source").alias("stated"), F.col("lang").alias("actual"))
    return run_checks.sources_named(rows).select("check_id", "path")


@query("SELECT 'config_applied' AS check_id, doc_id::VARCHAR AS path, CASE WHEN quality <> 1 THEN 'not persisted' ELSE 'not consumed' END AS detail FROM labels WHERE quality <> 1 OR toxic <> 0")
def record_config_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), (F.col("quality") == 1).alias("persisted"), (F.col("toxic") == 0).alias("consumed"))
    return run_checks.config_applied(rows).select("check_id", "path", "detail")


@query("SELECT 'fallback_transparency' AS check_id, doc_id::VARCHAR AS path FROM labels WHERE quality = 0 AND toxic = 0")
def record_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.lit(True).alias("primary_available"), (F.col("quality") == 0).alias("fallback_used"), (F.col("toxic") == 1).alias("labeled"))
    return run_checks.fallback_transparency(rows).select("check_id", "path")


@query("SELECT 'roundtrip_check' AS check_id, n_nationkey::VARCHAR AS path, unnest(CASE WHEN n_regionkey = 1 THEN ['name'] WHEN n_regionkey = 2 THEN ['extra', 'region'] ELSE [] END) AS detail FROM nation")
def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    one = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    back = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("name"), F.upper(F.concat(F.col("n_name"), F.lit("!"))), F.lit("region"), F.col("n_regionkey").cast("string"))).when(F.col("n_regionkey") == 2, F.create_map(F.lit("name"), F.col("n_name"), F.lit("extra"), F.lit("x"))).otherwise(one)
    return run_checks.roundtrip(n.select(F.col("n_nationkey").cast("string").alias("name"), one.alias("original"), back.alias("back"))).select("check_id", "path", "detail")


@query("""WITH e AS (SELECT user_id, event_type, ts, list_position(['view', 'click', 'purchase'], event_type) AS p FROM events WHERE event_type IN ('view', 'click', 'purchase')),
l AS (SELECT user_id, p, max(ts) AS ts FROM e GROUP BY 1, 2) SELECT DISTINCT 'temporal.stale_artifact' AS check_id, e.user_id::VARCHAR AS path, e.event_type AS detail FROM e JOIN l ON e.user_id = l.user_id AND l.p < e.p WHERE e.ts < l.ts""")
def record_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return run_checks.temporal(rows, ["view", "click", "purchase"]).select("check_id", "path", "detail").distinct()


@query("""WITH c AS (SELECT source AS run, min(lang || '/' || doc_id || '.py') AS path FROM documents WHERE lang = 'en' GROUP BY source), v AS (SELECT d.source AS run, min(quality) AS q FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source)
SELECT CASE WHEN v.run IS NULL THEN 'testing.critical_unverified' ELSE 'testing.verification_failed' END AS check_id, c.path, c.run AS detail FROM c LEFT JOIN v USING (run) WHERE v.run IS NULL OR q = 0""")
def record_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    changed = docs.where("source IS NOT NULL").select(F.col("source").alias("run"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"))
    verified = _table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").where("source IS NOT NULL").select(F.col("source").alias("run"), (F.col("quality") == 1).alias("passed"))
    return run_checks.testing(changed, verified, ["en/"]).select("check_id", "path", "detail")


@query("SELECT 'hunter_artifact_completeness' AS check_id, event_id::VARCHAR AS path, CASE WHEN props IS NULL THEN 'not JSON' ELSE 'region' END AS detail FROM events WHERE props IS NULL OR NOT list_contains(json_keys(props), 'region')")
def record_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return run_checks.artifact_completeness(rows, ["region"]).select("check_id", "path", "detail")


@query("SELECT 'context_health.' || w AS check_id, doc_id::VARCHAR AS path FROM (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'no_files' END, CASE WHEN toxic > 0 THEN 'unreadable_files' END, CASE WHEN quality = 0 THEN 'no_maps' END], lambda x: x IS NOT NULL)) AS w FROM labels)")
def record_context_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("run"), F.col("quality").alias("n_files"), F.col("toxic").alias("n_unreadable"), F.col("quality").alias("n_maps"), F.lit(True).alias("has_profile"))
    return run_checks.context_health(rows).select("check_id", "path")


@query("SELECT 'PC02' AS check_id, s_suppkey::VARCHAR AS path, 'c' AS detail FROM supplier WHERE s_nationkey % 3 = 1 UNION ALL SELECT 'PC01', s_suppkey::VARCHAR, 'none declared' FROM supplier WHERE s_nationkey % 3 = 2")
def record_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("a"), F.lit("c"))).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return run_checks.provider_capabilities(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), caps.alias("capabilities")), ["a", "c"]).select("check_id", "path", "detail")


@query("SELECT 'runtime.claim_contradiction' AS check_id, doc_id::VARCHAR AS path FROM labels WHERE quality <> toxic UNION ALL SELECT 'runtime.identity_mismatch', doc_id::VARCHAR FROM labels WHERE toxic = 1")
def record_runtime_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    rows = _table(spark, sf_dir, "labels").select(s("doc_id").alias("run"), s("quality").alias("claimed"), s("toxic").alias("verified"), s("toxic").alias("identity"), F.lit("0").alias("expected_identity"))
    return run_checks.runtime_claims(rows).select("check_id", "path")


@query("SELECT 'reporting.artifact_missing' AS check_id, (o_orderkey + 1)::VARCHAR AS path, o_orderkey::VARCHAR AS detail FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1) UNION ALL SELECT 'reporting.acceptance_with_blockers', o_orderkey::VARCHAR, '1' FROM orders WHERE o_orderstatus = 'F'")
def record_reporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_orderkey").cast("string").alias("run"), F.lit(True).alias("accepted"), F.array((F.col("o_orderkey") + 1).cast("string")).alias("refs"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("blocking"))
    return run_checks.reporting(reports, o.select(F.col("o_orderkey").cast("string").alias("path"))).select("check_id", "path", "detail")


@query("""WITH c AS (SELECT source AS run, sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS tests, sum(CASE WHEN lang <> 'de' THEN 1 ELSE 0 END) AS sources FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source)
SELECT 'fix_without_test.no_tests' AS check_id, run AS path FROM c WHERE sources > 0 AND tests = 0""")
def record_fix_without_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    path = F.when(F.col("lang") == "de", F.concat(F.lit("tests/test_"), F.col("doc_id").cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")))
    return run_checks.fix_without_test(docs.select(F.col("source").alias("run"), F.lit("Fix a bug").alias("intent")).distinct(), docs.select(F.col("source").alias("run"), path.alias("path"))).select("check_id", "path")


@query("SELECT 'dirty_baseline' AS check_id, min(p) AS path, count(*)::VARCHAR AS detail FROM (SELECT source || '/' || doc_id AS p FROM documents WHERE source IS NOT NULL) WHERE p NOT LIKE 'web%' HAVING count(*) > 5")
def record_dirty_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("source IS NOT NULL")
    return run_checks.dirty_baseline(docs.select(F.concat(F.lit(" M "), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("value")), ["web"]).select("check_id", "path", "detail")


@query("SELECT d AS path, sum(a)::BIGINT AS added, sum(b)::BIGINT AS deleted FROM (SELECT l_suppkey::VARCHAR AS d, l_quantity::INT AS a, l_linenumber::INT AS b FROM lineitem) GROUP BY d")
def record_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change counts from numstat lines."""
    li = _table(spark, sf_dir, "lineitem")
    value = F.concat_ws("\t", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("int").cast("string"), F.col("l_suppkey").cast("string"))
    made = records.churn(li.select(value.alias("value")))
    return made.select("path", F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a/tests/x' || doc_id || '.py' WHEN 1 THEN 'a/fixtures/' || doc_id || '.json' WHEN 2 THEN 'src/migrations/' || doc_id || '.py' WHEN 3 THEN 'x/latest_' || doc_id || '.go' WHEN 4 THEN 'x/F' || doc_id || 'Test.java' WHEN 5 THEN 'ui/__tests__/' || doc_id || '.js' ELSE 'src/m' || doc_id || '.py' END AS path FROM documents)
SELECT path, CASE WHEN regexp_matches(lower(path), '/fixtures/|/snapshots/|/mocks/') THEN 'fixture' WHEN regexp_matches(lower(path), '/tests/|/test/|test_|_test[.]py|/conftest[.]py') THEN 'test' WHEN regexp_matches(lower(path), '/generated/|/migrations/|/alembic/') THEN 'generated' ELSE 'production' END AS role,
CASE WHEN path LIKE '%.py' THEN regexp_matches(path, 'test_|_test[.]py') WHEN path LIKE '%.js' THEN regexp_matches(path, '[.]test[.]js|[.]spec[.]js|__tests__/') WHEN path LIKE '%.go' THEN path LIKE '%\\_test.go%' ESCAPE '\\' WHEN path LIKE '%.java' THEN regexp_matches(path, 'Tests?[.]java|/test/') ELSE false END AS is_test FROM p""")
def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of paths and whether they are tests of their language."""
    i = F.col("doc_id").cast("string")
    forms = [("a/tests/x", ".py"), ("a/fixtures/", ".json"), ("src/migrations/", ".py"), ("x/latest_", ".go"), ("x/F", "Test.java"), ("ui/__tests__/", ".js"), ("src/m", ".py")]
    made = F.element_at(F.array(*[F.concat(F.lit(a), i, F.lit(b)) for a, b in forms]), (F.col("doc_id") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select(made.alias("path")).select("path", paths.role(F.col("path")).alias("role"), paths.is_test(F.col("path")).alias("is_test"))


@query("""WITH s AS (SELECT source || '/' || lang AS dir, CASE lang WHEN 'en' THEN 'a_checks' WHEN 'de' THEN 'b_utils' ELSE 'c' END AS stem, doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT 'c52.responsibility_proliferation' AS check_id, min(dir || '/' || doc_id || '_' || stem || '.py') AS path FROM s WHERE stem <> 'c' GROUP BY dir, stem HAVING count(*) >= 3""")
def tree_proliferation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder with one responsibility's suffix."""
    docs = _table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    stem = F.when(F.col("lang") == "en", "a_checks").when(F.col("lang") == "de", "b_utils").otherwise("c")
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), stem, F.lit(".py")).alias("path"), F.lit("x").alias("text"))
    return corpus_checks.proliferation(files).select("check_id", "path")


@query("""WITH n AS (SELECT s_suppkey AS i, count(*) OVER () AS n FROM supplier), e AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + s_nationkey) % n + 1 AS dst FROM supplier JOIN n ON i = s_suppkey),
d AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node) SELECT * FROM d""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of each node."""
    s = _table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"))
    e = s.join(F.broadcast(n)).select(F.col("s_suppkey").cast("long").alias("src"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.col("n") + 1).cast("long").alias("dst"))
    return graph.degrees(e)
