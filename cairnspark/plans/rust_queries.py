"""Registered queries: the validators over Rust sources of differing structure.

The driver has no source trees, so sources are put together from lines chosen by
``part``'s keys: imports, functions, types, loops, tests and comments, in files of
differing length, on paths of every kind that the rules ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_table
from ..operators import block_tree, manifests, near_clones, organization, validators
from ..sources.scratch import materialize
from ..sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PATHS = (
    "crates/app/src/domain/order.rs", "crates/app/src/handlers/api.rs", "crates/app/src/adapters/store.rs", "crates/app/src/application/run.rs",
    "crates/app/src/di/container.rs", "crates/app/src/ports/store.rs", "crates/app/src/value_objects/id.rs", "crates/app/src/constants.rs", "crates/app/src/util.rs",
)
SNIPPETS = (
    "use app_infrastructure::db::Pool;", "use tokio::time::sleep;", "use crate::adapters::cache;", "use std::sync::Mutex;", "",
    "pub fn load(path: &str) -> Result<String, Error> {", "    let text = read(path).unwrap();", "    let n = parse(&text).expect(\"a number\");",
    "    panic!(\"no value\");", "    let total = 86400 * n;", "    Ok(text)", "}", "// TODO: handle the other case", "    todo!()",
    "pub struct InternalState {", "    pub cache: Arc<Mutex<bool>>,", "    store: Box<OrderRepository>,", "    service: Arc<PriceService>,", "}",
    "impl Order {", "    pub fn set_name(&mut self, name: String) {", "        self.name = name;", "    }", "#[allow(dead_code)]", "#[allow(unused_variables)]",
    "async fn poll(&self) {", "    let x = block_on(self.next());", "    tokio::spawn(work());", "    for item in items {", "        let copy = item.clone();", "        let v = Vec::new();", "    }", "}",
    "pub trait Store {", "const LIMIT: usize = 4096;", "    match kind.as_str() {", "        _ => {},", "    let url = \"http://localhost:8080\";", "    let h = \"X-Request-Id\";", "    namespace: \"orders\",",
    "    respond(err.to_string())", "    let s = OrderService::new(db);", "    fn find(&self) -> Result<Row, sqlx::Error>;", "    let v = it.collect::<Vec<_>>().iter();", "    let s = format!(\"{}\", name);",
    "pub fn helper_one() {", "    let r = client.send()?;", "#[cfg(test)]", "mod tests {", "    #[test]", "    #[ignore]", "    fn works() {", "        assert!(true);", "    }", "}",
)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sources(spark, sf_dir: str) -> DataFrame:
    """(file, content): a file for each part, of 3 to 42 lines."""
    k = F.col("p_partkey")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), 2 + k % 40), lambda j: (k * 31 + j * j * 7 + j * (k % 11 + 1)) % len(SNIPPETS))
    body = F.array_join(F.transform(at, lambda i: pick(SNIPPETS, i)), "\n")
    return spread(table(spark, sf_dir, "part")).select(F.concat_ws("#", pick(PATHS, k % len(PATHS)), k.cast("string")).alias("file"), body.alias("content"))


def _sql() -> str:
    """The line rules as SQL: a list of snippets, the lines, and a branch for each rule."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(text, xs)) + "]"
    # what DuckDB's expressions lack, a look ahead, is written as a second condition
    ahead = {"PAT001": r"\bArc<(dyn|Mutex|RwLock|Atomic|str\b|\[)", "SOLID004": r"(Box|Arc)<dyn\b"}
    found = []
    for r in validators.LINE_RULES:
        pattern = r.pattern.replace(r"(?!dyn\b|Mutex\b|RwLock\b|Atomic|str\b|\[)", "").replace(r"(?!dyn\b)", "")
        ok = [f"regexp_matches(line, {text(pattern)})"]
        if r.id in ahead:
            ok.append(f"NOT regexp_matches(line, {text(ahead[r.id])})")
        if r.unless:
            ok.append(f"NOT regexp_matches(line, {text(r.unless)})")
        if r.path.startswith("^(?!.*"):
            ok.append(f"NOT regexp_matches(file, {text(r.path[len('^(?!.*') : -len(').*$')])})")
        elif r.path:
            ok.append(f"regexp_matches(file, {text(r.path)})")
        if r.skip_tests:
            ok.append("(cut IS NULL OR line_no < cut) AND NOT starts_with(ltrim(line), '//')")
        found.append(f"SELECT {text(r.id)} AS id, {text(r.category)} AS category, {text(r.severity)} AS severity, file, line_no + 1 AS line, {text(r.message)} AS message FROM ls WHERE {' AND '.join(ok)}")
    n, m = len(SNIPPETS), len(PATHS)
    return f"""src AS (SELECT p_partkey AS k, {listed(PATHS)}[p_partkey % {m} + 1] || '#' || p_partkey AS file, unnest(range(3 + p_partkey % 40)) AS line_no FROM part),
 raw AS (SELECT *, {listed(SNIPPETS)}[(k * 31 + line_no * line_no * 7 + line_no * (k % 11 + 1)) % {n} + 1] AS line FROM src),
 ls AS (SELECT *, min(CASE WHEN contains(line, '#[cfg(test)]') THEN line_no END) OVER (PARTITION BY file) AS cut FROM raw),
 found AS ({" UNION ALL ".join(found)})"""


_FOUND = _sql()


@register(f"WITH {_FOUND} SELECT id, category, severity, file, line::BIGINT AS line, message FROM found")
def rust_line_findings(spark, sf_dir: str) -> DataFrame:
    """Every line rule over all sources."""
    return validators.line_findings(line_table(sources(spark, sf_dir)))


@register(f"WITH {_FOUND} SELECT category, id, count(*) AS n, count(DISTINCT file) AS files FROM found GROUP BY 1, 2")
def rust_findings_by_family(spark, sf_dir: str) -> DataFrame:
    """Findings and files by family and rule."""
    f = validators.line_findings(line_table(sources(spark, sf_dir)))
    return f.groupBy("category", "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@register()
def rust_validate_all(spark, sf_dir: str) -> DataFrame:
    """All validators, those on blocks, functions, files and paths too: findings by family and rule."""
    return validators.validate(sources(spark, sf_dir)).groupBy("category", "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


_DEPS = """m AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS crate, 'crates/n' || n_nationkey || '/Cargo.toml' AS file, 'n' || ((n_nationkey * 3 + n_regionkey) % 25) AS a, 'n' || ((n_nationkey + 7) % 25) AS b FROM nation),
 deps AS (SELECT DISTINCT crate, dependency, kind, file FROM (SELECT crate, a AS dependency, 'dependencies' AS kind, file FROM m UNION ALL SELECT crate, 'serde', 'dependencies', file FROM m UNION ALL SELECT crate, b, 'dev-dependencies', file FROM m))"""


def _manifests(spark, sf_dir: str) -> DataFrame:
    """A manifest for each nation: a path dependency, one from the workspace, and a section of its own."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = (
        "[package]\nname = \"n%d\"\nversion = \"0.1.0\"\n\n[dependencies]\n"
        "n%d = { path = \"../x\" } # internal\nserde.workspace = true\n\n[dev-dependencies.n%d]\nversion = \"1\"\n\n[features]\nall = []\n"
    )
    body = F.format_string(text, k, (k * 3 + r) % 25, (k + 7) % 25)
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("crates/n"), k.cast("string"), F.lit("/Cargo.toml")).alias("file"), body.alias("content"))


@register(f"WITH {_DEPS} SELECT * FROM deps")
def manifest_dependencies(spark, sf_dir: str) -> DataFrame:
    return manifests.manifest_dependencies(_manifests(spark, sf_dir))


@register(f"""WITH RECURSIVE {_DEPS}, ok AS (SELECT 'n' || n_nationkey AS crate, 'n' || (n_nationkey * 3 + n_regionkey) % 25 AS dependency FROM nation WHERE n_nationkey % 2 = 0),
 u AS (SELECT crate, b AS dependency, 'crates/' || crate || '/src/lib.rs' AS file, k % 9 + 1 AS line FROM m),
 e AS (SELECT crate AS src, dependency AS dst FROM deps WHERE kind = 'dependencies' AND dependency <> 'serde'),
 w(root, tip, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT w.root, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON w.tip = e.src WHERE e.dst > w.root AND NOT list_contains(w.path, e.dst)),
 c AS (SELECT w.path FROM w JOIN e ON e.src = w.tip AND e.dst = w.root UNION ALL SELECT [src] FROM e WHERE src = dst)
SELECT 'DEP001' AS id, file, 1::BIGINT AS line, crate || ' -> ' || dependency AS message FROM deps WHERE kind = 'dependencies' AND dependency <> 'serde' AND crate <> dependency AND (crate, dependency) NOT IN (SELECT * FROM ok)
UNION ALL SELECT 'DEP002', file, line, crate || ' -> ' || dependency FROM u WHERE crate <> dependency AND (crate, dependency) NOT IN (SELECT * FROM ok)
UNION ALL SELECT 'DEP003', 'crates/' || path[1] || '/Cargo.toml', 1, array_to_string(list_append(path, path[1]), ' -> ') FROM c""")
def dependency_findings(spark, sf_dir: str) -> DataFrame:
    """Even crates may use what their manifests name; every crate also imports the seventh after it."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    crate = lambda c: F.concat(F.lit("n"), c.cast("string"))
    allowed = n.where("n_nationkey % 2 = 0").select(crate(k).alias("crate"), crate((k * 3 + r) % 25).alias("dependency"))
    uses = n.select(crate(k).alias("crate"), crate((k + 7) % 25).alias("dependency"), F.concat(F.lit("crates/"), crate(k), F.lit("/src/lib.rs")).alias("file"), (k % 9 + 1).cast("long").alias("line"))
    out = manifests.dependency_findings(manifests.manifest_dependencies(_manifests(spark, sf_dir)), uses, allowed)
    return out.select("id", "file", "line", "message")


@register("""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'tests/f' || p_partkey // 3 || '_test.rs' ELSE 'src/f' || p_partkey || '.rs' END AS file FROM part),
 t AS (SELECT file, 1 AS line, 'T' || k % 50 AS name FROM f), m AS (SELECT file, 2 AS line, 'f' || k * 2 AS name FROM f WHERE file LIKE 'src/%'),
 stems AS (SELECT 'f' || k // 3 AS stem FROM f WHERE k % 3 = 0)
SELECT 'REF002' AS id, file, line::BIGINT AS line, name AS message FROM t WHERE name IN (SELECT name FROM t GROUP BY 1 HAVING count(DISTINCT file) > 1)
UNION ALL SELECT 'REF003', file, 1, 'f' || k FROM f WHERE file LIKE 'src/%' AND 'f' || k NOT IN (SELECT stem FROM stems)
UNION ALL SELECT 'REF005', file, line, name FROM m WHERE 'src/' || name || '.rs' NOT IN (SELECT file FROM f)""")
def refactoring_findings(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cs])
    file = F.when(k % 3 == 0, text("tests/f", F.expr("p_partkey div 3"), "_test.rs")).otherwise(text("src/f", k, ".rs"))
    body = text("pub struct T", k % 50, " {\n", F.when(k % 3 != 0, text("mod f", k * 2, ";\n")).otherwise(F.lit("")), "}\n")
    f = table(spark, sf_dir, "part").select(file.alias("file"), body.alias("content"))
    return manifests.refactoring_findings(f).select("id", "file", "line", "message")


@register()
def near_clones_rust(spark, sf_dir: str) -> DataFrame:
    """Clones of the strict preset's size, with gaps, over the generated sources."""
    t = near_clones.source_tokens(sources(spark, sf_dir), "file", "content")
    return near_clones.near_clones(t, near_clones.Limits(4, 30, 0.70)).select("file1", "start1", "end1", "file2", "start2", "end2", "similarity", "clone_type", "rule_id")


@register("""WITH u AS (SELECT 'n' || n_nationkey AS crate, 'n' || (n_nationkey * 24) % 25 AS dependency, n_nationkey::BIGINT AS line FROM nation)
SELECT 'LAYER002' AS id, u.crate || '.rs' AS file, u.line AS line, u.crate || ' <-> ' || u.dependency AS message FROM u JOIN u v ON u.crate = v.dependency AND u.dependency = v.crate WHERE u.crate <> u.dependency""")
def mutual_layers(spark, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    crate = lambda c: F.concat(F.lit("n"), c.cast("string"))
    uses = table(spark, sf_dir, "nation").select(crate(k).alias("crate"), crate((k * 24) % 25).alias("dependency"), F.concat(crate(k), F.lit(".rs")).alias("file"), k.cast("long").alias("line"))
    return manifests.mutual_layers(uses).select("id", "file", "line", "message")


# ---- the block tree

#: The same windows in SQL; the snippets hold no comment over several lines, so a line's code is the line without strings and comment.
_NODES = r"""src AS (SELECT file, content FROM (SELECT k, paths[k % {paths} + 1] || '#' || k || '.rs' AS file, array_to_string(list_transform(range(3 + k % 40), lambda j: snippets[(k * 31 + j * j * 7 + j * (k % 11 + 1)) % {n} + 1]), chr(10)) AS content
   FROM (SELECT p_partkey AS k, {listed_paths} AS paths, {listed} AS snippets FROM part))),
 ln AS (SELECT file, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT file, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS ls FROM src)),
 code AS (SELECT file, line_no, regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'), '//.*$', '') AS code FROM ln),
 ev AS (SELECT file, line_no, i, marks[i] AS mark, trim(regexp_split_to_array(code, '[{{}}]')[i]) AS header FROM
   (SELECT file, line_no, code, marks, unnest(range(1, len(marks) + 1)) AS i FROM (SELECT *, regexp_extract_all(code, '[{{}}]') AS marks FROM code))),
 s1 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no, i) AS seq, sum(CASE WHEN mark = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file ORDER BY line_no, i) AS s FROM ev),
 s2 AS (SELECT *, least(min(s) OVER (PARTITION BY file ORDER BY seq), 0) AS low, coalesce(least(min(s) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS before FROM s1),
 s3 AS (SELECT *, s - low + CASE WHEN mark = '{{' THEN 0 ELSE 1 END AS depth FROM s2 WHERE mark = '{{' OR low = before),
 s4 AS (SELECT *, lead(seq) OVER (PARTITION BY file, depth ORDER BY seq) AS post, lead(line_no) OVER (PARTITION BY file, depth ORDER BY seq) AS end_line FROM s3),
 nodes AS (SELECT file, seq AS pre, coalesce(post, 2147483648) AS post, depth::INT AS depth, line_no::INT AS start_line, coalesce(end_line, (SELECT max(line_no) FROM ln WHERE ln.file = s4.file))::INT AS end_line,
   header, {kind} AS kind FROM s4 WHERE mark = '{{'),
 tree AS (SELECT n.*, (SELECT max(p.pre) FROM nodes p WHERE p.file = n.file AND p.pre < n.pre AND p.post > n.post OR p.file = n.file AND p.pre < n.pre AND p.post = 2147483648) AS parent FROM nodes n)"""


def _tree_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(text, xs)) + "]"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(header, {text(p)}) THEN '{k}'" for k, p in block_tree.KINDS.items()) + " ELSE 'block' END"
    return _NODES.format(paths=len(PATHS), n=len(SNIPPETS), listed=listed(SNIPPETS), listed_paths=listed(PATHS), kind=kind)


def _tree(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sources(spark, sf_dir).select(F.concat("file", F.lit(".rs")).alias("file"), "content")
    lines = materialize(line_table(s))
    return materialize(block_tree.block_nodes(lines)), lines


@register(f"WITH {_tree_sql()} SELECT file, pre, depth, parent, kind, start_line, end_line FROM tree")
def block_tree_nodes(spark, sf_dir: str) -> DataFrame:
    """Every block of the generated sources, with its parent."""
    return _tree(spark, sf_dir)[0].select("file", "pre", "depth", "parent", "kind", "start_line", "end_line")


@register(f"WITH {_tree_sql()} SELECT file, count(*) AS blocks, max(depth) AS deepest, max(end_line - start_line + 1)::BIGINT AS longest FROM nodes GROUP BY 1")
def block_nesting(spark, sf_dir: str) -> DataFrame:
    return block_tree.nesting(_tree(spark, sf_dir)[0])


@register(f"""WITH {_tree_sql()} SELECT file, pre, start_line FROM tree t WHERE kind = 'loop' AND end_line - start_line >= 2
 AND EXISTS (SELECT 1 FROM nodes a WHERE a.file = t.file AND a.kind = 'function' AND a.pre < t.pre AND (a.post > t.post OR a.post = 2147483648)) AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.file = t.file AND c.parent = t.pre AND c.kind = 'condition')""")
def block_query(spark, sf_dir: str) -> DataFrame:
    """Loops of three lines or more, somewhere inside a function, without a condition as a child."""
    found = block_tree.select_nodes(_tree(spark, sf_dir)[0], "loop", F.expr("end_line - start_line >= 2"), no_child="condition", inside="function")
    return found.select("file", "pre", "start_line")


@register()
def block_metrics(spark, sf_dir: str) -> DataFrame:
    """Length, parameters and complexity of every function."""
    return block_tree.function_metrics(*_tree(spark, sf_dir))


# ---- organization: one file a part, its folder and lines chosen by the part's key

FOLDERS = (
    "crates/domain/src/model/", "crates/domain/src/ports/", "crates/domain/src/adapters/", "crates/infrastructure/src/ports/", "crates/infrastructure/src/cache/",
    "crates/app/src/server/", "crates/app/src/server/handlers/", "crates/app/src/application/", "crates/app/tests/",
)
NAMES = ("order", "my_config", "error", "builder", "constants")
ORG_LINES = (
    "pub trait PayGateway {", "pub trait OrderService {", "pub trait OrderServiceExt {", "let s = Arc::new(OrderService::new(db));", "use crate::server::state;", "pub use crate::server::other;",
    "impl OrderRepository for Db {", "pub struct PageHandler {", "let n = 123456 + 86400;", "const N: u32 = 777777;", "// let n = 999999;", "let a = \"a rather long literal\";", "let b = \"Cannot do this at all\";", "#[cfg(test)]",
)


def _organized(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda j: (k * 5 + j * 3 + j * j) % len(ORG_LINES))
    path = F.concat(pick(FOLDERS, k % len(FOLDERS)), F.lit("d"), k.cast("string"), F.lit("/"), pick(NAMES, k % len(NAMES)), F.lit(".rs"))
    return line_table(spread(table(spark, sf_dir, "part")).select(path.alias("file"), F.array_join(F.transform(at, lambda i: pick(ORG_LINES, i)), "\n").alias("content")))


def _organization_sql() -> str:
    listed = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return f"""WITH raw AS (SELECT k, file, n AS line_no, {listed(ORG_LINES)}[(k * 5 + n * 3 + n * n) % {len(ORG_LINES)} + 1] AS line FROM
   (SELECT k, {listed(FOLDERS)}[k % {len(FOLDERS)} + 1] || 'd' || k || '/' || {listed(NAMES)}[k % {len(NAMES)} + 1] || '.rs' AS file, unnest(range(k % 5 + 1)) AS n FROM (SELECT p_partkey AS k FROM part))),
 cut AS (SELECT *, min(line_no) FILTER (line = '#[cfg(test)]') OVER (PARTITION BY file) AS cut FROM raw WHERE NOT contains(file, '/tests/')),
 p AS (SELECT file, line_no + 1 AS line, line AS t, regexp_extract(file, '[^/]*$') AS name FROM cut WHERE (cut IS NULL OR line_no < cut) AND NOT starts_with(line, '//')),
 f AS (SELECT DISTINCT file, regexp_extract(file, '[^/]*$') AS name FROM raw)
SELECT 'ORG001' AS id, file, line::BIGINT AS line FROM p WHERE contains(t, '123456') AND name NOT IN ('my_config.rs', 'constants.rs')
UNION ALL SELECT 'ORG002', min(file), NULL FROM p WHERE contains(t, '"a rather') AND name <> 'constants.rs' HAVING count(DISTINCT file) >= 4
UNION ALL SELECT 'ORG005', file, NULL FROM f WHERE contains(file, 'domain/src/adapters/') UNION ALL SELECT 'ORG005', file, NULL FROM f WHERE contains(file, 'infrastructure/src/ports/')
UNION ALL SELECT 'ORG005', file, NULL FROM f WHERE name = 'my_config.rs' AND contains(file, '/src/') UNION ALL SELECT 'ORG005', file, NULL FROM f WHERE name = 'error.rs' AND contains(file, '/src/')
UNION ALL SELECT 'ORG007', file, line FROM p WHERE t = 'pub trait OrderService {{' AND NOT contains(file, 'domain/') AND NOT contains(file, '/ports/')
UNION ALL SELECT 'ORG013', file, line FROM p WHERE contains(t, 'Arc::new(') AND contains(file, '/server/') AND name <> 'builder.rs'
UNION ALL SELECT 'ORG014', file, line FROM p WHERE t = 'use crate::server::state;' AND regexp_matches(file, '/(application|infrastructure)/')
UNION ALL SELECT 'ORG015', file, line FROM p WHERE starts_with(t, 'impl OrderRepository') AND NOT contains(file, '/adapters/')
UNION ALL SELECT 'ORG017', file, line FROM p WHERE starts_with(t, 'pub struct Page') AND contains(file, '/server/') AND NOT contains(file, '/handlers/')
UNION ALL SELECT 'ORG018', file, line FROM p WHERE t = 'pub trait PayGateway {{' AND contains(file, 'domain/') AND NOT contains(file, '/ports/')"""


@register(_organization_sql())
def organization_findings(spark, sf_dir: str) -> DataFrame:
    """Placement and layer rules over sources in every kind of folder."""
    found = organization.organization_findings(_organized(spark, sf_dir))
    return found.where("id != 'ORG016'").select("id", "file", "line")
