"""The engine's queries over the driver's tables, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import blocks, graph, line_checks, report, size, structure
from quarry.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(tables.documents_as_files(spark, sf_dir))


#: The lines of the documents, as files, for the oracles.
_SQL_LINES = r"""
l0 AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR) AS path, string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM l0),
lines AS (SELECT path, line_no, line FROM l1 WHERE NOT (line_no = n AND line = ''))
"""
_SQL_BLOCKS = (
    _SQL_LINES
    + r""",
m0 AS (SELECT path, line_no, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') AS s FROM lines),
m AS (SELECT path, line_no, s, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM m0 WHERE s <> ''),
w0 AS (SELECT path, k, line_no, list(substr(sha256(s), 1, 32)) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN CURRENT ROW AND {after} FOLLOWING) AS run FROM m),
w AS (SELECT path, k, line_no, md5(array_to_string(run, '')) AS hash FROM w0 WHERE len(run) = {after} + 1)
"""
)


@query(
    "WITH " + _SQL_BLOCKS.replace("{after}", "11") + "SELECT hash, count(DISTINCT path)::BIGINT AS n_files, count(*)::BIGINT AS n_places, min(path) AS first_path FROM w GROUP BY hash HAVING count(DISTINCT path) >= 2"
)
def text_block_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 12 meaningful lines that stand in two files or more."""
    return blocks.across_files(_lines(spark, sf_dir), 12)


@query(
    "WITH " + _SQL_BLOCKS.replace("{after}", "11") + ", b AS (SELECT hash, path, count(*)::BIGINT AS n, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, max(k) - min(k) AS span FROM w GROUP BY hash, path) "
    "SELECT path, hash, first_line, last_line, n FROM b WHERE span >= 12 AND hash IN (SELECT hash FROM b GROUP BY hash HAVING count(*) = 1)"
)
def text_block_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 12 lines repeated within one file only."""
    return blocks.within_file(_lines(spark, sf_dir), 12)


@query(
    "WITH " + _SQL_BLOCKS.replace("{after}", "3") + ", p0 AS (SELECT path, k, min(k) OVER (PARTITION BY path, hash) AS origin FROM w), "
    "p AS (SELECT path, k, origin, k - origin AS shift, k - row_number() OVER (PARTITION BY path, k - origin ORDER BY k) AS g FROM p0 WHERE k - origin >= 4) "
    "SELECT path, min(origin)::INT AS origin, min(k)::INT AS start, (count(*) + 3)::BIGINT AS n_lines FROM p GROUP BY path, shift, g HAVING count(*) + 3 >= 5"
)
def near_duplicate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of at least 5 lines that repeat an earlier place of the same file."""
    return blocks.regions(_lines(spark, sf_dir), 4, 5)


_SECRETS = [r for r in line_checks.RULES if r.check == "secrets_scan"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "WITH " + _SQL_LINES + ", h AS (SELECT path, line_no, CASE " + " ".join(f"WHEN regexp_matches(line, {_q(r.pattern)}) THEN {_q(r.detail)}" for r in _SECRETS) + " END AS detail FROM lines "
    "WHERE NOT regexp_matches(ltrim(line), '^(#|//|\\*)') AND NOT regexp_matches(lower(line), " + _q(line_checks.PLACEHOLDERS["secrets_scan"]) + ")) "
    "SELECT 'secrets_scan' AS check_id, path, line_no::INT AS line_no, detail, 'CRITICAL' AS severity, 'BLOCK' AS impact FROM h WHERE detail IS NOT NULL"
)
def secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard-coded secrets, the first rule for each line."""
    files = line_checks.candidates(tables.documents_as_files(spark, sf_dir), ["secrets_scan"])
    return line_checks.check_lines(tables.lines(files), ["secrets_scan"])


@query(
    "WITH " + _SQL_LINES + ", h AS (SELECT path, CASE " + " ".join(f"WHEN regexp_matches(line, {_q(r.pattern)}) THEN {_q(r.detail)}" for r in _SECRETS) + " END AS detail FROM lines "
    "WHERE NOT regexp_matches(ltrim(line), '^(#|//|\\*)') AND NOT regexp_matches(lower(line), " + _q(line_checks.PLACEHOLDERS["secrets_scan"]) + ")) "
    "SELECT severity, check_id, count(*)::BIGINT AS n FROM (SELECT 'CRITICAL' AS severity, 'secrets_scan' AS check_id FROM h WHERE detail IS NOT NULL) GROUP BY ROLLUP (severity, check_id) HAVING count(*) > 0"
)
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and check, with subtotals."""
    return report.summary(secrets_scan(spark, sf_dir))


@query(
    "WITH " + _SQL_LINES + r"""
SELECT path, count(*)::BIGINT AS line_count, CASE WHEN count(*) >= 20 THEN 'file_too_large' WHEN count(*) >= 12 THEN 'file_warn' ELSE 'ok' END AS size_class FROM lines GROUP BY path"""
)
def size_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size classes of files by line count, with thresholds that suit the documents (the profile's are 750 and 1000)."""
    return size.file_sizes(_lines(spark, sf_dir), warn=12, revise=20)


@query(
    """SELECT url AS path, CASE WHEN regexp_matches(lower(url), '/fixtures/|/snapshots/|/mocks/') THEN 'fixture' WHEN regexp_matches(lower(url), '/tests/|/test/|test_|_test[.]py|/conftest[.]py') THEN 'test'
WHEN regexp_matches(lower(url), '/generated/|/migrations/|/alembic/') THEN 'generated' ELSE 'production' END AS role FROM pages"""
)
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of paths."""
    return _table(spark, sf_dir, "pages").select(F.col("url").alias("path"), paths.role(F.col("url")).alias("role"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{0080}-\\x{FFFF}]'))::INT AS n_unsafe FROM documents WHERE regexp_matches(text, '[\\x{0080}-\\x{FFFF}]')")
def unsafe_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with characters that narrow consoles can't print."""
    docs = _table(spark, sf_dir, "documents")
    n = F.regexp_count("text", F.lit("[\\u0080-\\uFFFF]"))
    return docs.where(F.col("text").rlike("[\\u0080-\\uFFFF]")).select("doc_id", n.alias("n_unsafe"))


_TOK = "[A-Za-z_][A-Za-z0-9_]*"


@query(f"WITH t AS (SELECT unnest(regexp_extract_all(text, '{_TOK}')) AS name, doc_id FROM documents) SELECT name, min(doc_id) AS doc_id FROM t GROUP BY name HAVING count(*) = 1")
def singleton_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur once in the whole corpus: the reference count behind dead code."""
    t = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TOK), F.lit(0))).alias("name"))
    return t.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("name", "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS name FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(name, '^[a-z0-9]+$'))::BIGINT AS n_lower, count(*) FILTER (WHERE regexp_matches(name, '^[A-Z]'))::BIGINT AS n_capital, count(*)::BIGINT AS n_names FROM t GROUP BY doc_id HAVING count(*) >= 3"""
)
def naming_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of naming styles in each file with three names or more."""
    t = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TOK), F.lit(0))).alias("name"))
    n = t.groupBy("doc_id").agg(F.sum(F.col("name").rlike("^[a-z0-9]+$").cast("long")).alias("n_lower"), F.sum(F.col("name").rlike("^[A-Z]").cast("long")).alias("n_capital"), F.count("*").alias("n_names"))
    return n.where("n_names >= 3")


@query(f"SELECT p_name AS unit FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) d WHERE d.t = lower(p_name)) GROUP BY p_name")
def unused_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no document mentions: the caller index and an anti join."""
    seen = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("t")).distinct()
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("unit")).distinct().join(seen, F.lower("unit") == F.col("t"), "left_anti")


@query("""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS dir, regexp_extract(url, '/([a-z]+)/[^/]*$', 1) AS suffix FROM pages) SELECT dir, suffix, count(*)::BIGINT AS n FROM p GROUP BY dir, suffix HAVING count(*) >= 3""")
def sibling_proliferation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files or more with one folder and suffix."""
    p = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("dir"), F.regexp_extract("url", "/([a-z]+)/[^/]*$", 1).alias("suffix"))
    return p.groupBy("dir", "suffix").agg(F.count("*").alias("n")).where("n >= 3")


@query(
    """SELECT l_partkey AS target, count(DISTINCT l_suppkey)::BIGINT AS n_writers, count(DISTINCT s_nationkey)::BIGINT AS n_roots FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT s_nationkey) >= 2"""
)
def shared_write_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with writers from two roots or more: the automatic ownership domains."""
    writes = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return structure.shared_targets(writes.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("writer"), F.col("s_nationkey").alias("root")))


_GLOBS = [("blog", "http*://blog.*"), ("german", "**/de/*"), ("html", "*.html"), ("query", "*?page=*")]


@query("WITH g(domain, re) AS (VALUES " + ", ".join(f"({_q(d)}, {_q(paths.glob_regex(g))})" for d, g in _GLOBS) + ") SELECT domain, count(*)::BIGINT AS n FROM pages JOIN g ON regexp_matches(url, re) GROUP BY domain")
def glob_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths attributed to the domains whose patterns they match."""
    hits = structure.match_globs(_table(spark, sf_dir, "pages").select(F.col("url").alias("path")), _GLOBS)
    return hits.groupBy("domain").agg(F.count("*").alias("n"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and their suppliers."""
    return _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


_SQL_STEPS = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


@query(
    "WITH " + _SQL_STEPS + """, d AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
SELECT node, fan_in, fan_out, array_to_string(list_filter([CASE WHEN fan_in > 10 THEN 'fan_in' END, CASE WHEN fan_out > 15 THEN 'fan_out' END], lambda x: x IS NOT NULL), ',') AS tags FROM d"""
)
def fan_in_out_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and their tags."""
    d = graph.degrees(_links(spark, sf_dir))
    tags = F.array_compact(F.array(F.when(F.col("fan_in") > 10, "fan_in"), F.when(F.col("fan_out") > 15, "fan_out")))
    return d.select("node", "fan_in", "fan_out", F.array_join(tags, ",").alias("tags"))


_SQL_SPARSE = "e AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + s_nationkey) % (SELECT count(*) FROM supplier) + 1 AS dst FROM supplier)"


@query(
    "WITH RECURSIVE " + _SQL_SPARSE + """, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
m AS (SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT node::BIGINT AS node, component::BIGINT AS component FROM m"""
)
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of two nodes or a loop."""
    s = _table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"))
    e = s.join(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.col("n") + 1).alias("dst"))
    found = graph.components(spark, e.select(F.lpad(F.col("src").cast("string"), 12, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 12, "0").alias("dst")))
    return found.select(F.col("node").cast("long").alias("node"), F.col("component").cast("long").alias("component"))


@query(
    """WITH c AS (SELECT l_partkey AS target, count(*)::BIGINT AS churn, count(DISTINCT l_suppkey)::BIGINT AS fan_in, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned FROM lineitem GROUP BY l_partkey),
s AS (SELECT target, greatest(0, least(130, least(20, CASE WHEN fan_in > 10 THEN 8 ELSE 0 END + CASE WHEN churn > 25 THEN 10 ELSE 0 END) + least(20, 3 * returned) + least(25, floor(ln(1 + churn) * 4)::BIGINT) - 5))::BIGINT AS score FROM c)
SELECT target, score, CASE WHEN score >= 90 THEN 'do_not_touch' WHEN score >= 60 THEN 'forensic_first' WHEN score >= 30 THEN 'caution' ELSE 'safe' END AS mode FROM s"""
)
def hotspot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped weighted scores with churn, and their buckets."""
    c = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(
        F.count("*").alias("churn"), F.countDistinct("l_suppkey").alias("fan_in"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned")
    )
    structural = F.least(F.lit(20), F.when(F.col("fan_in") > 10, 8).otherwise(0) + F.when(F.col("churn") > 25, 10).otherwise(0))
    score = structural + F.least(F.lit(20), 3 * F.col("returned")) + structure.churn_points(F.col("churn")) - 5
    made = c.select("target", F.greatest(F.lit(0), F.least(F.lit(130), score)).cast("long").alias("score"))
    return made.withColumn("mode", structure.mode_for(F.col("score")))


_CUT = "2024-01-16"


@query(
    f"""WITH s AS (SELECT user_id, event_type, ts < TIMESTAMP '{_CUT}' AS before, count(*) AS n FROM events GROUP BY 1, 2, 3),
v AS (SELECT user_id || ':' || event_type AS finding_id, before, CASE WHEN n >= 10 THEN 4 WHEN n >= 6 THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END AS r FROM s),
j AS (SELECT coalesce(a.finding_id, b.finding_id) AS finding_id, a.r AS new, b.r AS old FROM (SELECT * FROM v WHERE NOT before) a FULL JOIN (SELECT * FROM v WHERE before) b ON a.finding_id = b.finding_id)
SELECT finding_id, CASE coalesce(new, old) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN new IS NULL THEN 'resolved' WHEN old IS NULL THEN 'new' WHEN new > old THEN 'worsened' ELSE 'existing' END AS finding_status FROM j"""
)
def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two snapshots: new, existing, worsened, resolved."""
    e = _table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("ts") < F.lit(_CUT).cast("timestamp")).alias("before")).agg(F.count("*").alias("n"))
    v = e.select(F.concat_ws(":", "user_id", "event_type").alias("finding_id"), "before", F.when(F.col("n") >= 10, "CRITICAL").when(F.col("n") >= 6, "HIGH").when(F.col("n") >= 3, "MEDIUM").otherwise("LOW").alias("severity"))
    return report.lifecycle(v.where("NOT before"), v.where("before"))


@query(
    f"""WITH k AS (SELECT event_type, ts < TIMESTAMP '{_CUT}' AS before, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL),
a AS (SELECT DISTINCT event_type, key FROM k WHERE before), b AS (SELECT DISTINCT event_type, key FROM k WHERE NOT before)
SELECT event_type, key, CASE WHEN a.key IS NULL THEN 'field_added' WHEN b.key IS NULL THEN 'field_removed' ELSE 'same' END AS drift FROM a FULL JOIN b USING (event_type, key)"""
)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each type before and after the cut."""
    k = _table(spark, sf_dir, "events").select("event_type", (F.col("ts") < F.lit(_CUT).cast("timestamp")).alias("before"), F.explode(F.expr("json_object_keys(props)")).alias("key")).distinct()
    return structure.field_drift(k.where("before").drop("before"), k.where("NOT before").drop("before"), ["event_type", "key"])


@query("WITH k AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events) SELECT key, CASE WHEN regexp_matches(upper(key), 'KEY|SECRET|TOKEN|PASS') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM k WHERE key NOT IN ('documented', 'region')")
def env_undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read but documented nowhere."""
    k = _table(spark, sf_dir, "events").select(F.explode(F.expr("json_object_keys(props)")).alias("key")).distinct()
    known = spark.createDataFrame([("documented",), ("region",)], "key string")
    return k.join(F.broadcast(known), "key", "left_anti").withColumn("severity", F.when(F.upper("key").rlike("KEY|SECRET|TOKEN|PASS"), "MEDIUM").otherwise("LOW"))


@query(
    """WITH c AS (SELECT DISTINCT regexp_extract(url, '([a-z-]+)[.]example', 1) AS name FROM pages WHERE length(regexp_extract(url, '([a-z-]+)[.]example', 1)) >= 5)
SELECT a.name AS name, b.name AS other, levenshtein(a.name, b.name)::INT AS distance FROM c a JOIN c b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2
WHERE levenshtein(a.name, b.name) <= 0.3 * greatest(length(a.name), length(b.name)) AND a.name || 's' <> b.name AND b.name || 's' <> a.name"""
)
def partial_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ by less than a third of their letters."""
    names = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "([a-z-]+)[.]example", 1).alias("name")).distinct()
    return structure.near_names(names, 5)


@query(
    """WITH q AS (SELECT conv_id, turn FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM q
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = q.conv_id AND c.role = 'assistant' AND c.turn > q.turn AND c.turn <= q.turn + 1)"""
)
def unchecked_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without a check within reach: a look-ahead anti range join."""
    c = _table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn")
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("c"), F.col("turn").alias("at"))
    return q.join(a, (F.col("conv_id") == F.col("c")) & (F.col("at") > F.col("turn")) & (F.col("at") <= F.col("turn") + 1), "left_anti")


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id AS check_id, b.event_id AS act_id FROM s a JOIN s b ON a.user_id = b.user_id AND b.k > a.k AND b.k <= a.k + 3 WHERE a.event_type = 'view' AND b.event_type = 'purchase'"""
)
def check_then_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check followed by an act within three steps: an ordered range join."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = F.array(*[F.lead(F.struct("event_id", "event_type"), i).over(w) for i in (1, 2, 3)])
    s = _table(spark, sf_dir, "events").withColumn("ahead", ahead).where("event_type = 'view'")
    acts = F.filter("ahead", lambda x: x["event_type"] == "purchase")
    return s.select(F.col("event_id").alias("check_id"), F.explode(acts).alias("a")).select("check_id", F.col("a.event_id").alias("act_id"))


@query("SELECT coalesce(source, '.') AS dir, count(*)::BIGINT AS n, (SELECT count(*) FROM documents)::BIGINT AS total FROM documents WHERE (SELECT count(*) FROM documents) > 800 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def subdir_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight largest folders, where there are over 800 files."""
    return tables.too_many(tables.documents_as_files(spark, sf_dir), 800, 8)


@query(
    """WITH h AS (SELECT regexp_replace(lower(regexp_replace(text, '[0-9]+', 'N', 'g')), '[ \\t\\n]+', ' ', 'g') AS t, doc_id FROM documents), k AS (SELECT sha256(t) AS h, doc_id FROM h)
SELECT h AS hash, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM k GROUP BY h HAVING count(*) > 1"""
)
def exact_duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose normalized text is equal."""
    t = F.regexp_replace(F.lower(F.regexp_replace("text", "[0-9]+", "N")), "[ \\t\\n]+", " ")
    return _table(spark, sf_dir, "documents").groupBy(F.sha2(t, 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    """WITH f AS (SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1) SELECT d.source AS dir, count(*)::BIGINT AS n FROM documents d JOIN f USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM labels a WHERE a.doc_id = d.doc_id AND a.quality = 0) GROUP BY d.source ORDER BY n DESC, dir LIMIT 25"""
)
def topk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with most findings left after an allowlist, an anti join."""
    labels = _table(spark, sf_dir, "labels")
    left = _table(spark, sf_dir, "documents").join(labels.where("toxic = 1").select("doc_id"), "doc_id").join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    return left.groupBy(F.col("source").alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(25)
