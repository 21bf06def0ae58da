"""Registered queries: rules and findings, clones, graphs, metrics, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import line_table
from ..operators import chaining, chunking, clones, filters, graphs, json_schema, metrics, near_clones, rules, snapshots, validators
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import spread, table
from ..streaming import events as ev, range_vectors, timers
from .views import CHUNKS, EXT_OF, FILES, LINES, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Rules for the driver's prose; the same engine runs the rules for code.
PROSE_RULES = (
    validators.LineRule("TXT001", "quality", "warning", r"[A-Z]{2,}!!", "shouted", skip_tests=False),
    validators.LineRule("TXT002", "security", "error", r"token = \"", "a secret", skip_tests=False),
    validators.LineRule("TXT003", "organization", "info", r"[0-9]{5,}", "a long number", skip_tests=False),
    validators.LineRule("TXT004", "licence", "info", r"License", "a licence line", skip_tests=False),
)
_HITS = " UNION ALL ".join(
    f"SELECT '{r.id}' AS id, '{r.category}' AS category, '{r.severity}' AS severity, doc_id::VARCHAR AS file, line_no + 1 AS line, '{r.message}' AS message FROM lines WHERE regexp_matches(line, '{r.pattern}')"
    for r in PROSE_RULES
)
FINDINGS = LINES + f", found AS ({_HITS})"


def _lines(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    return line_table(f)


def _findings(spark, sf_dir: str) -> DataFrame:
    return validators.line_findings(_lines(spark, sf_dir), PROSE_RULES)


@register(f"WITH {FINDINGS} SELECT id, file, CAST(line AS BIGINT) AS line FROM found")
def lint_regex_lines(spark, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("id", "file", "line")


@register(f"WITH {FINDINGS} SELECT id, category, severity, file, CAST(line AS BIGINT) AS line, message FROM found UNION ALL SELECT 'SIZE001', 'size', 'warning', doc_id::VARCHAR, 1, 'long text' FROM documents WHERE n_chars > 10000")
def all_violations(spark, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").where("n_chars > 10000")
    size = long.select(F.lit("SIZE001").alias("id"), F.lit("size").alias("category"), F.lit("warning").alias("severity"), F.col("doc_id").cast("string").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("long text").alias("message"))
    return _findings(spark, sf_dir).unionByName(size)


@register(f"""WITH {FINDINGS} SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
 count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM found""")
def violation_summary(spark, sf_dir: str) -> DataFrame:
    return validators.totals(_findings(spark, sf_dir))


@register(f"WITH {FINDINGS} SELECT category, count(*) AS n, md5(string_agg(id || ':' || file || ':' || line, ',' ORDER BY id, file, line)) AS entries_md5 FROM found GROUP BY 1")
def violations_by_category(spark, sf_dir: str) -> DataFrame:
    v = validators.by_category(_findings(spark, sf_dir))
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["id"], e["file"], e["line"].cast("string"))), ",")
    return v.select("category", "n", F.md5(text.cast("binary")).alias("entries_md5"))


@register(f"WITH {FINDINGS} SELECT '::' || severity || ' file=' || file || ',line=' || line || '::[' || id || '] ' || message AS annotation FROM found WHERE severity IN ('error', 'warning')")
def ci_annotations(spark, sf_dir: str) -> DataFrame:
    return validators.ci_annotations(_findings(spark, sf_dir))


@register(f"""WITH {LINES}, j AS (SELECT *, max(regexp_matches(line, 'License|token')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS justified FROM lines)
SELECT doc_id::VARCHAR AS file, line_no, justified FROM j WHERE regexp_matches(line, '[0-9]{{5,}}')""")
def lint_justified(spark, sf_dir: str) -> DataFrame:
    return validators.justified(_lines(spark, sf_dir), F.col("line").rlike("[0-9]{5,}"), F.col("line").rlike("License|token")).select("file", "line_no", "justified")


@register(r"""WITH p AS (SELECT page_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT page_id, string_split(replace(html, '<div', chr(10) || '{<div'), chr(10)) AS ls FROM pages)),
 d AS (SELECT page_id, sum((length(line) - length(replace(line, '{', ''))) - (length(line) - length(replace(line, '}', '')))) OVER (PARTITION BY page_id ORDER BY line_no) AS depth FROM p)
SELECT page_id AS file, CAST(max(depth) AS BIGINT) AS deepest FROM d GROUP BY 1""")
def nesting_depth_simple(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.split(F.regexp_replace("html", "<div", "\n{<div"), "\n")).alias("line_no", "line"))
    return validators.nesting(p).groupBy("file").agg(F.max("depth").cast("long").alias("deepest"))


@register(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')) AS value FROM documents)
SELECT value, count(DISTINCT doc_id) AS files, count(*) AS occurrences FROM w WHERE length(value) >= 15 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4""")
def duplicate_literals(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    return validators.duplicate_literals(d, "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", key="doc_id")


@register("""SELECT name, owners, folders, CASE WHEN owners > 1 THEN 'across' ELSE 'within' END AS kind FROM
 (SELECT string_split(p_name, ' ')[1] AS name, count(DISTINCT p_brand) AS owners, count(DISTINCT p_type) AS folders FROM part GROUP BY 1) WHERE owners > 1 OR folders > 1""")
def duplicate_definitions(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("name", F.get(F.split("p_name", " "), F.lit(0)))
    return validators.duplicate_definitions(p, "name", "p_brand", "p_type")


# ---- clones

_WIN = 12
WINDOWS = r"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
 st AS (SELECT doc_id, t, unnest(range(greatest(len(t) - 11, 0))) AS start FROM tok),
 win AS (SELECT doc_id, start, md5(array_to_string(t[start + 1 : start + 12], ' ')) AS hash FROM st),
 firsts AS (SELECT hash, min((doc_id, start)) AS f, count(*) AS n FROM win GROUP BY 1 HAVING count(*) > 1),
 pairs AS (SELECT f[1] AS file1, f[2] AS start1, w.doc_id AS file2, w.start AS start2, hash FROM win w JOIN firsts USING (hash) WHERE w.doc_id <> f[1] OR w.start >= f[2] + 12)"""


def _token_lists(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", clones.word_tokens(F.col("text")).alias("tokens"))


@register(f"WITH {WINDOWS} SELECT doc_id, count(*) AS windows, count(DISTINCT hash) AS distinct_windows, min(hash) AS least FROM win GROUP BY 1")
def fingerprints(spark, sf_dir: str) -> DataFrame:
    return clones.document_windows(_token_lists(spark, sf_dir), _WIN)


@register(f"WITH {WINDOWS}, b AS (SELECT hash, count(*) AS n FROM win GROUP BY 1) SELECT sum(n)::BIGINT AS locations, count(*) AS fingerprints, count(*) FILTER (n > 1) AS duplicated FROM b")
def fingerprint_stats(spark, sf_dir: str) -> DataFrame:
    return clones.fingerprint_stats(clones.window_keys(_token_lists(spark, sf_dir), _WIN), "k")


@register(f"""WITH {WINDOWS}, near AS (SELECT *, count(*) OVER (PARTITION BY hash, doc_id ORDER BY start RANGE BETWEEN 11 PRECEDING AND 11 FOLLOWING) AS near FROM win JOIN firsts USING (hash))
SELECT f[1] AS file1, f[2] AS start1, doc_id AS file2, start AS start2, n - near AS links FROM near WHERE n > near""")
def clone_pairs(spark, sf_dir: str) -> DataFrame:
    """Every place of a repeated window with its class's first place, and how many places it is a clone of."""
    return clones.clone_links(materialize(clones.repeated_windows(_token_lists(spark, sf_dir), _WIN)), _WIN)


_MERGED = WINDOWS + """, sh AS (SELECT *, start2 - start1 AS shift, start1 - row_number() OVER (PARTITION BY file1, file2, start2 - start1 ORDER BY start1) AS run FROM pairs),
 merged AS (SELECT file1, file2, min(start1) AS start1, min(start2) AS start2, count(*) + 11 AS n_tokens FROM sh GROUP BY file1, file2, shift, run)"""


def _merged(spark, sf_dir: str) -> DataFrame:
    return clones.merge_clones(clones.clone_pairs(materialize(clones.repeated_windows(_token_lists(spark, sf_dir), _WIN)), _WIN), _WIN)


@register(f"WITH {_MERGED} SELECT CASE WHEN n_tokens >= 50 THEN 'long' ELSE 'short' END AS kind, count(*) AS clones, sum(n_tokens)::BIGINT AS tokens, count(DISTINCT file2) AS files FROM merged GROUP BY 1")
def clone_stats(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_tokens") >= 50, "long").otherwise("short").alias("kind")
    return _merged(spark, sf_dir).groupBy(kind).agg(F.count(F.lit(1)).alias("clones"), F.sum("n_tokens").alias("tokens"), F.count_distinct("file2").alias("files"))


@register()
def clone_dedup(spark, sf_dir: str) -> DataFrame:
    return clones.suppress_overlaps(_merged(spark, sf_dir)).select("file1", "start1", "file2", "start2", "n_tokens")


@register()
def near_clones_prose(spark, sf_dir: str) -> DataFrame:
    """Exact, renamed (another case) and gapped copies of passages between documents."""
    found = near_clones.near_clones(near_clones.word_tokens(table(spark, sf_dir, "documents")), near_clones.Limits(min_lines=1))
    return found.select("file1", "start1", "end1", "file2", "start2", "end2", "n_tokens", "similarity", "clone_type", "rule_id")


@register("SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount >= 1.0 THEN 'exact' WHEN 1 - l_discount >= 0.95 THEN 'renamed' WHEN 1 - l_discount >= 0.80 THEN 'gapped' ELSE 'semantic' END AS clone_type FROM lineitem")
def clone_classify(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clones.clone_type(1 - F.col("l_discount")).alias("clone_type"))


@register()
def code_tokens(spark, sf_dir: str) -> DataFrame:
    t = clones.code_tokens(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return t.groupBy("page_id", "token_type").agg(F.count(F.lit(1)).alias("n"))


@register()
def block_lengths(spark, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    body = F.format_string("pub struct P%d {\n    size: u32,\n    price: f64,\n}\nimpl P%d {\n    pub fn size(&self) -> u32 {\n        self.size\n    }\n}\n", F.col("p_partkey"), F.col("p_partkey"))
    return validators.blocks(p.select(F.col("p_partkey").alias("file"), body.alias("content")))


# ---- graphs and joins


@register("""WITH o AS (SELECT doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def snapshot_diff(spark, sf_dir: str) -> DataFrame:
    """Two snapshots of the documents: the remainders make the fixture's added, removed and changed files."""
    d = table(spark, sf_dir, "documents")
    md5 = lambda c: F.md5(c.cast("binary")).alias("hash")
    old = d.where("doc_id % 5 != 0").select(F.col("doc_id").alias("path"), md5(F.col("text")))
    new = d.where("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return graphs.snapshot_diff(old, new)


@register(f"""WITH {FILES}, o AS (SELECT path, md5(content) AS hash FROM files WHERE doc_id % 50 <> 3), n AS (SELECT path, md5(CASE WHEN doc_id % 40 = 0 THEN content || '.' ELSE content END) AS hash FROM files WHERE doc_id % 60 <> 7)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def snapshot_tree_diff(spark, sf_dir: str) -> DataFrame:
    """Two snapshots of the source tree, compared by directories from the root down."""
    f = files(spark, sf_dir)
    md5 = lambda c: F.md5(c.cast("binary")).alias("hash")
    old = snapshots.tree(f.where("doc_id % 50 != 3").select("path", md5(F.col("content"))))
    new = snapshots.tree(f.where("doc_id % 60 != 7").select("path", md5(F.when(F.col("doc_id") % 40 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))))
    return snapshots.changes(old, new)


@register(f"""WITH {FILES}, owners AS (SELECT DISTINCT source AS owner FROM documents UNION SELECT DISTINCT source || '/src' FROM documents WHERE doc_id % 2 = 0)
SELECT path, max_by(owner, length(owner)) AS owner FROM files JOIN owners ON starts_with(path, owner || '/') GROUP BY 1""")
def nearest_ancestor(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    owners = f.select(F.col("source").alias("owner")).unionByName(f.where("doc_id % 2 = 0").select(F.concat("source", F.lit("/src")).alias("owner"))).distinct()
    return graphs.nearest_ancestor(f.select("path"), owners)


_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, CAST(l_partkey % (SELECT count(*) FROM supplier) AS BIGINT) + 1 AS dst FROM lineitem)"


def _edges(spark, sf_dir: str) -> DataFrame:
    """Suppliers that share parts, as a graph on supplier keys."""
    n = table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n + 1).alias("dst")).distinct()


#: Parts that refer to parts of their own fifty, and some to the next part or to one of the fifty before.
_REFERS = """refers AS (SELECT p_partkey AS src, p_partkey // 50 * 50 + (p_partkey * p_partkey + 1) % 50 AS dst FROM part
 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 17 = 0 UNION SELECT p_partkey, p_partkey - 60 FROM part WHERE p_partkey % 101 = 0)"""


def _refers(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").alias("src")
    p = table(spark, sf_dir, "part")
    own = p.select(k, (F.expr("p_partkey div 50 * 50") + (k * k + 1) % 50).alias("dst"))
    return own.unionByName(p.where("p_partkey % 17 = 0").select(k, (k + 1).alias("dst"))).unionByName(p.where("p_partkey % 101 = 0").select(k, (k - 60).alias("dst")))


@register(f"""WITH RECURSIVE {_REFERS}, r(src, dst) AS (SELECT src, dst FROM refers UNION SELECT r.src, e.dst FROM r JOIN refers e ON r.dst = e.src),
 same AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src)
SELECT node, min(other) AS component FROM same GROUP BY 1""")
def dep_components(spark, sf_dir: str) -> DataFrame:
    return graphs.components(_refers(spark, sf_dir)).select("node", "component")


@register(f"""WITH RECURSIVE {_REFERS}, r(src, dst) AS (SELECT src, dst FROM refers UNION SELECT r.src, e.dst FROM r JOIN refers e ON r.dst = e.src),
 roots AS (SELECT src AS component FROM (SELECT a.src, min(a.dst) AS least FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) WHERE src = least),
 d(component, node, depth) AS (SELECT component, dst, 1 FROM roots JOIN refers ON src = component UNION SELECT component, e.dst, depth + 1 FROM d JOIN refers e ON d.node = e.src WHERE node <> component AND depth < 1000)
SELECT component, min(depth)::BIGINT AS length FROM d WHERE node = component GROUP BY 1""")
def dep_shortest_cycles(spark, sf_dir: str) -> DataFrame:
    return graphs.shortest_cycles(_refers(spark, sf_dir)).select("component", "length")


_PLACE_RULES = [
    chaining.Rule("inside", (chaining.Condition("?x", "in", "?y"), chaining.Condition("?y", "in", "?z")), (("?x", "in", "?z"),)),
    chaining.Rule("urgent", (chaining.Condition("?o", "priority", "1-URGENT"), chaining.Condition("?o", "in", "?p")), (("?p", "waits_for", "?o"),)),
    chaining.Rule("alert", (chaining.Condition("?p", "waits_for", "?o"), chaining.Condition("?o", "total", "200000", ">")), (("?p", "state", "alert"),)),
]


@register("""WITH RECURSIVE f AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS v FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 inside(s, v) AS (SELECT s, v FROM f UNION SELECT i.s, f.v FROM inside i JOIN f ON i.v = f.s),
 waits AS (SELECT DISTINCT v AS s, s AS v FROM inside JOIN orders ON s = 'o' || o_orderkey WHERE o_orderpriority = '1-URGENT'),
 alert AS (SELECT DISTINCT w.s FROM waits w JOIN orders ON w.v = 'o' || o_orderkey WHERE o_totalprice > 200000)
SELECT s AS subject, 'in' AS attribute, v AS value FROM inside UNION ALL SELECT s, 'waits_for', v FROM waits UNION ALL SELECT s, 'state', 'alert' FROM alert""")
def forward_chaining(spark, sf_dir: str) -> DataFrame:
    """A rule that feeds itself and two that follow from it, over orders, customers, nations and regions as facts."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    fact = lambda df, s, a, v: df.select(s.alias("subject"), F.lit(a).alias("attribute"), v.cast("string").alias("value"))
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    given = fact(o, named("o", "o_orderkey"), "in", named("c", "o_custkey"))
    for x in (
        fact(c, named("c", "c_custkey"), "in", named("n", "c_nationkey")), fact(n, named("n", "n_nationkey"), "in", named("r", "n_regionkey")),
        fact(o, named("o", "o_orderkey"), "priority", F.col("o_orderpriority")), fact(o, named("o", "o_orderkey"), "total", F.col("o_totalprice")),
    ):
        given = given.unionByName(x)
    return chaining.forward_chain(given, _PLACE_RULES).where("attribute in ('in', 'waits_for', 'state')").select("subject", "attribute", "value")


@register(f"WITH {_EDGES}, ok AS (SELECT DISTINCT s_suppkey AS src, s_nationkey::BIGINT AS dst FROM supplier) SELECT src, dst FROM edges WHERE (src, dst) NOT IN (SELECT src, dst FROM ok)")
def forbidden_deps(spark, sf_dir: str) -> DataFrame:
    ok = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return graphs.forbidden(_edges(spark, sf_dir), ok)


@register(f"WITH {_EDGES} SELECT a.src AS a, a.dst AS b FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_deps(spark, sf_dir: str) -> DataFrame:
    return graphs.mutual(_edges(spark, sf_dir))


@register(f"WITH {_EDGES} SELECT dst, count(*) AS n, md5(string_agg(src, ',' ORDER BY src)) AS dependents_md5 FROM edges GROUP BY 1")
def reverse_deps(spark, sf_dir: str) -> DataFrame:
    r = graphs.reverse(_edges(spark, sf_dir))
    return r.select("dst", "n", F.md5(F.array_join(F.col("dependents").cast("array<string>"), ",").cast("binary")).alias("dependents_md5"))


@register("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + n_regionkey) % 25 AS dst FROM nation),
 w(root, tip, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst
   UNION ALL SELECT w.root, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON w.tip = e.src WHERE e.dst > w.root AND NOT list_contains(w.path, e.dst))
SELECT array_to_string(w.path, '>') AS path, len(w.path) AS length FROM w JOIN e ON e.src = w.tip AND e.dst = w.root UNION ALL SELECT src::VARCHAR, 1 FROM e WHERE src = dst""")
def dep_cycles(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    c = graphs.cycles(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("dst")))
    return c.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@register(f"""WITH {FILES}, t AS (SELECT DISTINCT regexp_replace(regexp_extract(path, '([^/]+)\\.[^.]+$', 1), '_tests?$', '') AS stem FROM files WHERE contains(path, '/tests/'))
SELECT path FROM files WHERE NOT contains(path, '/tests/') AND NOT contains(path, '_test.') AND regexp_extract(path, '([^/]+)\\.[^.]+$', 1) NOT IN (SELECT stem FROM t)""")
def missing_tests(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path").withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))
    tests = f.where(F.contains("path", F.lit("/tests/"))).select(F.regexp_replace("stem", "_tests?$", "").alias("stem"))
    return f.where(~F.contains("path", F.lit("/tests/")) & ~F.contains("path", F.lit("_test."))).join(tests, "stem", "left_anti").select("path")


@register(f"""WITH {FILES}, m AS (SELECT source, doc_id, 'f' || (doc_id + 20) AS module FROM documents)
SELECT m.source, m.module FROM m WHERE m.source || '/src/' || m.module || '.rs' NOT IN (SELECT path FROM files) AND m.source || '/src/' || m.module || '.py' NOT IN (SELECT path FROM files)""")
def missing_modules(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    m = f.select("source", F.concat(F.lit("f"), (F.col("doc_id") + 20).cast("string")).alias("module"))
    for ext in ("rs", "py"):
        there = f.select(F.col("path").alias("p"))
        m = m.join(there, F.concat("source", F.lit("/src/"), "module", F.lit(f".{ext}")) == F.col("p"), "left_anti")
    return m


@register("SELECT event_id, CASE event_type WHEN 'error' THEN 'QUAL001' WHEN 'click' THEN 'QUAL005' END AS rule_id FROM events WHERE event_type IN ('error', 'click')")
def lint_map(spark, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([("error", "QUAL001"), ("click", "QUAL005")], "event_type string, rule_id string")
    return table(spark, sf_dir, "events").join(F.broadcast(codes), "event_type").select("event_id", "rule_id")


# ---- rules


@register(f"WITH {FILES} SELECT path FROM files WHERE {EXT_OF} IN ('rs', 'py') AND (doc_id % 4 = 0 AND source IS NOT NULL) AND regexp_matches(path, '^(?:.*/)?src/.*$')")
def rule_filters(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("deps", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("serde"), F.lit("tokio"))).otherwise(F.array(F.lit("tokio"))))
    return f.where(filters.rule_applies(F.col("path"), F.col("language"), F.col("deps"), F.col("source"), ["rust", "python"], ["serde"], ["**/src/**"])).select("path")


@register("SELECT doc_id FROM documents WHERE (lang = 'en' AND n_chars > 1000) OR (NOT starts_with(source, 'src1') AND regexp_matches(text, 'token = '))")
def condition_tree(spark, sf_dir: str) -> DataFrame:
    tree = {"any": [
        {"all": [{"field": "lang", "operator": "==", "value": "en"}, {"field": "n_chars", "operator": ">", "value": 1000}]},
        {"all": [{"not": {"field": "source", "operator": "starts_with", "value": "src1"}}, {"field": "text", "operator": "matches", "value": "token = "}]},
    ]}
    return table(spark, sf_dir, "documents").where(rules.condition(tree)).select("doc_id")


_FACTS = """facts AS (SELECT count(*) AS file_count, coalesce(bool_or(contains(text, '.unwrap()')), false) AS has_unwrap, coalesce(bool_or(contains(text, '.expect(')), false) AS has_expect,
 coalesce(bool_or(contains(text, 'async fn')), false) AS has_async, coalesce(bool_or(contains(text, '#[test]')), false) AS has_tests FROM documents)"""


@register(f"WITH {_FACTS} SELECT * FROM facts")
def rule_facts(spark, sf_dir: str) -> DataFrame:
    return rules.facts(table(spark, sf_dir, "documents"), "text")


@register(f"WITH {_FACTS} SELECT 'R1' AS id, 'warning' AS severity, 'quality' AS category FROM facts WHERE file_count > 100 AND NOT has_tests UNION ALL SELECT 'R2', 'error', 'quality' FROM facts WHERE has_unwrap AND has_async UNION ALL SELECT 'R3', 'warning', 'configuration'")
def rule_expression(spark, sf_dir: str) -> DataFrame:
    some = [
        {"id": "R1", "expression": "file_count > 100 && !has_tests"},
        {"id": "R2", "expression": "has_unwrap && has_async", "severity": "error"},
        {"id": "R3", "expression": "no_such_fact > 1"},
    ]
    return rules.expression_rules(rules.facts(table(spark, sf_dir, "documents"), "text"), some).select("id", "severity", "category")


@register(f"WITH {LINES} SELECT doc_id AS file, CAST(len(ls) AS BIGINT) AS n_lines FROM bodies WHERE len(ls) > 20")
def rule_file_size(spark, sf_dir: str) -> DataFrame:
    from ..functions.text import lines

    f = files(spark, sf_dir)
    return rules.large_files(f, "doc_id", F.size(lines(F.col("content"))), 20)


@register("SELECT doc_id AS file, 'C1' AS id FROM documents WHERE contains(text, 'License') UNION ALL SELECT doc_id, 'C2' FROM documents WHERE contains(text, 'token = ')")
def rule_contains(spark, sf_dir: str) -> DataFrame:
    return rules.containing(table(spark, sf_dir, "documents"), "doc_id", {"C1": "License", "C2": "token = "}, "text")


@register("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN role WHEN contains(lower(text), 'when') AND contains(lower(text), 'then') THEN 'grl' ELSE 'conditions' END AS engine FROM conversations""")
def rule_route(spark, sf_dir: str) -> DataFrame:
    """Every turn's text taken for a rule's definition, its role for an explicit engine if it is a system turn."""
    engine = F.when(F.col("role") == "system", F.col("role"))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.route_column(F.to_json(F.struct(F.col("text").alias("rule"))), engine).alias("engine"))


@register("""SELECT 'size' AS rule, doc_id AS file, n_chars FROM documents WHERE n_chars > 10000 UNION ALL SELECT 'licence', doc_id, NULL FROM documents WHERE contains(text, 'License')""")
def rules_batch(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = {"size": d.where("n_chars > 10000").select(F.col("doc_id").alias("file"), "n_chars"), "licence": rules.containing(d, "doc_id", {"x": "License"}, "text").select("file")}
    return rules.run_batch(found).select("rule", "file", "n_chars")


@register()
def rules_catalog(spark, sf_dir: str) -> DataFrame:
    rows = [(r.id, r.category, r.severity, r.pattern, r.message) for r in validators.LINE_RULES]
    return spark.createDataFrame(rows, "id string, category string, severity string, pattern string, message string")


# ---- metrics


@register(f"""WITH {LINES} SELECT doc_id AS file, count(*) AS sloc, count(*) FILTER (regexp_matches(line, '^\\s*$')) AS blank, count(*) FILTER (regexp_matches(line, '^\\s*(//|#)')) AS cloc,
 count(*) FILTER (NOT regexp_matches(line, '^\\s*$') AND NOT regexp_matches(line, '^\\s*(//|#)')) AS ploc, max(strlen(line)) AS longest FROM lines GROUP BY 1""")
def line_metrics(spark, sf_dir: str) -> DataFrame:
    ls = line_table(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("content")))
    return metrics.line_metrics(ls, "file")


_PART = "SELECT p_partkey AS file, p_size::DOUBLE AS cyclomatic, (p_size % 20)::DOUBLE AS cognitive, p_retailprice / 20 AS function_length FROM part"


def _part_metrics(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("file"), F.col("p_size").cast("double").alias("cyclomatic"), (F.col("p_size") % 20).cast("double").alias("cognitive"), (F.col("p_retailprice") / 20).alias("function_length"))


@register(f"""WITH m AS ({_PART}), u AS (SELECT file, 'cyclomatic' AS metric, cyclomatic AS value, 15.0::DOUBLE AS threshold FROM m UNION ALL SELECT file, 'cognitive', cognitive, 10 FROM m UNION ALL SELECT file, 'function_length', function_length, 50 FROM m)
SELECT file, metric, round(value, 6) AS value, threshold FROM u WHERE value > threshold""")
def metric_violations(spark, sf_dir: str) -> DataFrame:
    limits = {k: metrics.LIMITS[k] for k in ("cyclomatic", "cognitive", "function_length")}
    return metrics.violations(_part_metrics(spark, sf_dir), "file", limits).withColumn("value", F.round("value", 6))


_MI = "171 - 5.2::DOUBLE * ln(greatest(p_retailprice, 1)) - 0.23::DOUBLE * p_size - 16.2::DOUBLE * ln(greatest(p_size, 1))"


@register(f"SELECT p_partkey AS file, round({_MI}, 6) AS mi, CASE WHEN {_MI} >= 85 THEN 'excellent' WHEN {_MI} >= 65 THEN 'good' WHEN {_MI} >= 50 THEN 'moderate' ELSE 'poor' END AS level FROM part")
def maintainability(spark, sf_dir: str) -> DataFrame:
    mi = metrics.maintainability(F.col("p_retailprice"), F.col("p_size"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.round(mi, 6).alias("mi"), metrics.level(mi, metrics.MI_LEVELS, "poor").alias("level"))


@register("SELECT p_partkey AS file, CASE WHEN p_size >= 50 THEN 'extreme' WHEN p_size >= 20 THEN 'high' WHEN p_size >= 10 THEN 'moderate' ELSE 'low' END AS level FROM part")
def metric_levels(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), metrics.level(F.col("p_size"), metrics.CYCLOMATIC_LEVELS, "low").alias("level"))


@register()
def fn_metrics(spark, sf_dir: str) -> DataFrame:
    from .search_queries import _sources

    return metrics.function_metrics(_sources(spark, sf_dir)).select("path", "name", "cyclomatic", "cognitive", F.round("halstead_volume", 6).alias("halstead_volume"), F.round("maintainability_index", 6).alias("mi"), "sloc", "nargs", "nexits")


# ---- events


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def events_by_type(spark, sf_dir: str) -> DataFrame:
    return ev.by_type(table(spark, sf_dir, "events"))


@register("""WITH RECURSIVE s(user_id, hit) AS (SELECT user_id, min((ts, event_id)) FROM events GROUP BY 1
 UNION ALL SELECT s.user_id, min((e.ts, e.event_id)) FROM s JOIN events e ON e.user_id = s.user_id AND epoch_us(e.ts) - epoch_us(s.hit[1]) >= 3600000000 GROUP BY 1)
SELECT hit[2] AS event_id, user_id FROM s""")
def debounce_events(spark, sf_dir: str) -> DataFrame:
    return ev.debounced(table(spark, sf_dir, "events"), 3600, "user_id").select("event_id", "user_id")


@register("SELECT o_orderkey AS id, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority FROM orders ORDER BY priority DESC, o_orderdate, id LIMIT 100")
def sync_queue(spark, sf_dir: str) -> DataFrame:
    """The next 100 batches of the queue."""
    o = table(spark, sf_dir, "orders").withColumn("priority", F.left("o_orderpriority", F.lit(1)).cast("int"))
    return o.orderBy(F.desc("priority"), "o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"), "priority")


_HEALTH = """last AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) AS ok FROM events GROUP BY 1),
 h AS (SELECT l.user_id AS provider, count(e.event_id) AS failures FROM last l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.ok IS NULL OR (e.ts, e.event_id) > l.ok) GROUP BY 1),
 health AS (SELECT *, CASE WHEN failures >= 5 THEN 'unhealthy' WHEN failures >= 2 THEN 'degraded' ELSE 'healthy' END AS state FROM h)"""


def _health(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), (F.col("event_type") != "error").alias("ok"), "ts", "event_id")
    return ev.health(e, "provider", "ok", ["ts", "event_id"])


@register(f"WITH {_HEALTH} SELECT provider, failures, state FROM health")
def health_state(spark, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir)


@register(f"WITH {_HEALTH} SELECT provider, state FROM health WHERE provider NOT IN (1, 2) ORDER BY CASE WHEN provider = 77 AND state <> 'unhealthy' THEN 1 WHEN provider = 5 AND state <> 'unhealthy' THEN 2 ELSE 1073741824 END, CASE state WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END, provider LIMIT 1")
def provider_select(spark, sf_dir: str) -> DataFrame:
    return ev.select_provider(_health(spark, sf_dir), "provider", [77, 5], [1, 2]).select("provider", "state")


@register("""WITH l AS (SELECT user_id AS key, max_by((event_type, value, ts), (ts, event_id)) AS r FROM events GROUP BY 1)
SELECT key, round(r[2], 6) AS value FROM l WHERE r[1] <> 'error' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(r[3]) <= 43200000000""")
def cache_fold(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ops = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("kind"), "value", "ts", "event_id")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast(e.schema["ts"].dataType)
    return ev.cache_fold(ops, "key", ["ts", "event_id"], 43_200, now).withColumn("value", F.round("value", 6))


@register("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir: str) -> DataFrame:
    w = ev.windowed(table(spark, sf_dir, "events"), "1 hour", "event_type", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    return w.withColumn("window_start", ev.seconds(F.col("window_start")))


@register("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 7200000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_session(spark, sf_dir: str) -> DataFrame:
    s = ev.sessions(table(spark, sf_dir, "events"), "2 hours", "user_id")
    return s.select("user_id", ev.micros(F.col("session_start")).alias("session_start"), ev.micros(F.col("session_end")).alias("session_end"), "n")


@register("""WITH s AS (SELECT event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS low FROM events)
SELECT event_id FROM s WHERE low > 20""")
def alert_hold(spark, sf_dir: str) -> DataFrame:
    return ev.held(table(spark, sf_dir, "events"), "value", 20, 300, "event_type").select("event_id")


@register("SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*) > 0.05")
def error_rate_5m(spark, sf_dir: str) -> DataFrame:
    w = ev.windowed(table(spark, sf_dir, "events"), "5 minutes", error_rate=F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)))
    return w.where("error_rate > 0.05").select(ev.seconds(F.col("window_start")).alias("window_start"), F.round("error_rate", 6).alias("error_rate"))


@register("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_p95(spark, sf_dir: str) -> DataFrame:
    q = ev.exact_quantile(table(spark, sf_dir, "events"), "value", 0.95, "event_type")
    return q.select("event_type", F.round("quantile", 6).alias("p95"))


@register("""WITH w AS (SELECT event_id, unnest(range(5)) AS k, epoch(time_bucket(INTERVAL '1 minute', ts))::BIGINT AS m FROM events)
SELECT m - k * 60 AS window_start, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM w GROUP BY 1""")
def request_rate(spark, sf_dir: str) -> DataFrame:
    w = ev.windowed(table(spark, sf_dir, "events"), "5 minutes", slide="1 minute", rate=F.count(F.lit(1)) / 300.0)
    return w.select(ev.seconds(F.col("window_start")).alias("window_start"), F.round("rate", 6).alias("rate"))


@register("SELECT user_id, round(1 - avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1 END), 6) AS downtime FROM events GROUP BY 1 HAVING 1 - avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1 END) > 0.001")
def uptime_slo(spark, sf_dir: str) -> DataFrame:
    up = F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((1 - up).alias("downtime")).where("downtime > 0.001").withColumn("downtime", F.round("downtime", 6))


@register("""WITH x AS (SELECT event_type, value, epoch(date_trunc('second', ts)) - 1704067200 AS x FROM events)
SELECT event_type, round(regr_slope(value, x) * 1000000, 4) AS slope, round(regr_intercept(value, x) + regr_slope(value, x) * (max(x) + 3600), 4) AS predicted FROM x GROUP BY 1""")
def predict_linear(spark, sf_dir: str) -> DataFrame:
    p = ev.predict_linear(table(spark, sf_dir, "events"), "value", 3600, "event_type")
    return p.select("event_type", F.round(F.col("slope") * 1_000_000, 4).alias("slope"), F.round("predicted", 4).alias("predicted"))


@register("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS avg_response FROM events")
def perf_metrics(spark, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("avg_response"))


@register("SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) = 0 THEN 0 ELSE round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')), 6) END AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf_dir: str) -> DataFrame:
    h, m = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(h.alias("hits"), m.alias("misses"))
    return g.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6)).otherwise(0.0))


@register(f"WITH {_HEALTH} SELECT CASE max(CASE state WHEN 'unhealthy' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall FROM health")
def overall_health(spark, sf_dir: str) -> DataFrame:
    worst = F.max(F.when(F.col("state") == "unhealthy", 2).when(F.col("state") == "degraded", 1).otherwise(0))
    return _health(spark, sf_dir).agg(worst.alias("w")).select(F.get(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), F.col("w")).alias("overall"))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_events(spark, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by type through a foreachBatch merge."""
    schema = table(spark, sf_dir, "events").schema
    out = scratch_path(spark)
    # a file source takes folders; the table may be one file
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    q = source.writeStream.foreachBatch(ev.upsert_counts(out)).option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p.batchId for p in q.recentProgress if p.numInputRows), default=None)
    # an empty table has no batch
    kind = "event_type string, n long"
    return spark.createDataFrame([], kind) if last is None else spark.read.schema(kind).parquet(f"{out}/{last}")


_ALERTS = """m AS (SELECT event_type AS k, epoch_us(ts) // 1000 AS ms, value, value > 20 AS above FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
 s AS (SELECT *, sum((NOT above)::INT) OVER (PARTITION BY k ORDER BY ms, value ROWS UNBOUNDED PRECEDING) AS streak FROM m),
 e AS (SELECT k, streak, min(ms) FILTER (above) AS since FROM s GROUP BY 1, 2), z AS (SELECT k, streak - 1 AS streak, min(ms) AS stop FROM s WHERE NOT above GROUP BY 1, 2),
 a AS (SELECT k, streak, since, since + 3600000 AS due FROM e LEFT JOIN z USING (k, streak) WHERE since IS NOT NULL AND least(coalesce(stop, {until}), {until}) > since + 3600000)
SELECT a.k AS event_type, since, due AS fires_at, max(value) AS peak FROM a JOIN s ON a.k = s.k AND a.streak = s.streak AND above AND ms <= due GROUP BY 1, 2, 3"""


def _alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select("event_type", F.unix_millis("since").alias("since"), F.unix_millis("fires_at").alias("fires_at"), "peak")


@register("WITH " + _ALERTS.format(until="4611686018427387904"))
def alert_fires(spark, sf_dir: str) -> DataFrame:
    """When a type of event has stood above 20 for an hour, though nothing came at that moment."""
    return _alert_rows(timers.hold_alerts_of(table(spark, sf_dir, "events"), "event_type", "value", 20, 3600))


@register("WITH " + _ALERTS.format(until="(SELECT max(epoch_us(ts) // 1000) - 600000 FROM events)"))
def stream_alerts(spark, sf_dir: str) -> DataFrame:
    """The same from a stream, with timers: what the watermark, ten minutes behind the last event, has passed."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    timers.use_rocksdb(spark)
    rows = source.withColumn("ts", F.col("ts").cast("timestamp"))
    return _alert_rows(ev.run_available(timers.hold_alerts(rows, "event_type", "value", 20, 3600, "10 minutes"), scratch_path(spark), scratch_path(spark)))


@register("""WITH m AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
 n AS (SELECT *, lead(ms) OVER (PARTITION BY event_type ORDER BY ms) AS nxt, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS n FROM m)
SELECT event_type, ms AS last_seen, ms + 7200000 AS silent_at, count(*) AS silences FROM n WHERE coalesce(nxt, 4611686018427387904) > ms + 7200000 GROUP BY 1, 2, 3""")
def event_silences(spark, sf_dir: str) -> DataFrame:
    """When a type of event was silent for two hours."""
    out = timers.silences_of(table(spark, sf_dir, "events"), "event_type", 7200)
    return out.groupBy("event_type", F.unix_millis("last_seen").alias("last_seen"), F.unix_millis("silent_at").alias("silent_at")).agg(F.count(F.lit(1)).alias("silences"))


@register("""WITH s AS (SELECT user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), e AS (SELECT user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT s.user_id, epoch_us(s.ts) // 1000 AS started_at, epoch_us(e.ts) // 1000 AS completed_at FROM s LEFT JOIN e ON s.user_id = e.user_id AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR""")
def event_completions(spark, sf_dir: str) -> DataFrame:
    """A user's events of the first type with those of the last one within an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()  # one row
    out = timers.completions(e.where(F.col("event_type") == ends.lo), e.where(F.col("event_type") == ends.hi), "user_id", "1 HOUR", "1 hour")
    return out.select("user_id", F.unix_millis("started_at").alias("started_at"), F.unix_millis("completed_at").alias("completed_at"))


@register("""WITH d AS (SELECT p_partkey AS id, p_size AS size, p_retailprice AS price, p_name AS name, p_brand AS brand, split(p_type, ' ') AS kinds FROM part)
SELECT id, '$.size' AS path, 'maximum' AS keyword FROM d WHERE size > 40 UNION ALL SELECT id, '$.name', 'maxLength' FROM d WHERE length(name) > 10
UNION ALL SELECT id, '$.brand', 'pattern' FROM d WHERE NOT regexp_matches(brand, '^Brand#[1-3]') UNION ALL SELECT id, '$', 'required' FROM d WHERE id % 7 = 0
UNION ALL SELECT id, '$', 'anyOf' FROM d WHERE price <= 920 AND size <= 10
UNION ALL SELECT id, '$.kinds[' || (i - 1) || ']', 'enum' FROM (SELECT id, kinds, unnest(range(1, len(kinds) + 1)) AS i FROM d) WHERE kinds[i] IN ('PROMO', 'SMALL')""")
def schema_violations(spark, sf_dir: str) -> DataFrame:
    """Parts as JSON documents, every seventh without a price, checked against a schema with nested items and alternatives."""
    p = spread(table(spark, sf_dir, "part"))
    price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price")
    doc = F.to_json(F.struct(F.col("p_size").alias("size"), price, F.col("p_retailprice").alias("cost"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.split("p_type", " ").alias("kinds")))
    schema = {
        "type": "object", "required": ["price", "name"],
        "properties": {
            "size": {"type": "integer", "maximum": 40}, "name": {"type": "string", "maxLength": 10}, "brand": {"pattern": "^Brand#[1-3]"},
            "kinds": {"type": "array", "items": {"enum": ["STANDARD", "MEDIUM", "LARGE", "ECONOMY"]}},
        },
        "anyOf": [{"properties": {"cost": {"exclusiveMinimum": 920}}}, {"properties": {"size": {"exclusiveMinimum": 10}}}],
    }
    return json_schema.violations(p.select(F.col("p_partkey").alias("id"), doc.alias("value")), schema).select("id", "path", "keyword")


#: Events of a type counted through the day: a counter that begins again at midnight.
_COUNTER = """c AS (SELECT event_type, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS value, ts FROM events),
 i AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS inc FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)),
 b AS (SELECT event_type, sec // 300 * 300 AS bucket, sum(inc) AS inc FROM i GROUP BY 1, 2),
 r AS (SELECT event_type, bucket + 300 AS until, sum(inc) OVER (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN {before} PRECEDING AND CURRENT ROW) / {length}::DOUBLE AS value FROM b)"""


def _counter(spark, sf_dir: str) -> DataFrame:
    """Stored buckets of the counter, five minutes each."""
    e = table(spark, sf_dir, "events")
    of_day = W.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    c = e.select("event_type", "ts", F.row_number().over(of_day).cast("double").alias("value"))
    return materialize(range_vectors.buckets(c, ["event_type"], counter=True))


@register("WITH " + _COUNTER.format(before=3300, length=3600) + " SELECT event_type, until::BIGINT AS until, round(value, 9) AS value FROM r")
def counter_rate_1h(spark, sf_dir: str) -> DataFrame:
    """A counter's rate over the last hour, over its resets."""
    return range_vectors.rate(_counter(spark, sf_dir), ["event_type"], 3600).withColumn("value", F.round("value", 9))


@register("WITH " + _COUNTER.format(before=604500, length=604800) + """, e AS (SELECT until, value FROM r WHERE event_type LIKE 'e%'), a AS (SELECT until, sum(value) AS value FROM r GROUP BY 1)
SELECT e.until::BIGINT AS until, round(sum(e.value) / max(a.value), 6) AS value FROM e JOIN a USING (until) WHERE a.value <> 0 GROUP BY 1""")
def error_ratio_7d(spark, sf_dir: str) -> DataFrame:
    """The share of errors in the rates over seven days, from the stored buckets."""
    rates = range_vectors.rate(_counter(spark, sf_dir), ["event_type"], 604_800)
    bad = range_vectors.summed(range_vectors.matching(rates, event_type=("=~", "e.*")))
    return range_vectors.ratio(bad, range_vectors.summed(rates), []).select("until", F.round("value", 6).alias("value"))
