"""Where things belong in a layered Rust workspace: placement and layer rules.

All rules work on (file, line_no, line) and the file's path with Spark's own
functions; test files, test modules and comments do not count.  A finding has
id, category, severity, file, line (1-based, null for a whole file) and message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import block_tree
from .validators import production_lines

# Numbers and strings that may repeat, names of traits and methods that may stand anywhere.
COMMON_NUMBERS = (
    "16384", "32768", "65535", "65536", "131072", "262144", "524288", "1048576", "2097152", "4194304", "100000", "1000000", "10000000", "100000000",
    "86400", "604800", "2592000", "31536000",
)
STRING_HOLDS = ("{}", "://", ".rs", ".json", ".toml", "serde_json", ".to_string()")
STRING_BEGINS = ("test_", "Error", "error", "Failed", "Invalid", "Cannot", "Unable", "Missing", "pub ", "fn ", "let ", "CARGO_")
STRING_ENDS = ("_id", "_key")
TRAIT_ENDS = ("Ext", "Factory", "Builder", "Helper", "Internal", "Impl", "Adapter", "Handler", "Listener", "Callback", "Module", "Component")
INNER_TRAITS = ("CacheProvider", "HttpClientProvider", "ConfigProvider", "LogProvider", "MetricsProvider", "TracingProvider", "StorageProvider")
PLAIN_METHODS = (
    "new", "default", "from", "into", "as_ref", "as_mut", "clone", "fmt", "eq", "cmp", "hash", "partial_cmp", "is_empty", "len", "iter", "into_iter",
    "total_changes", "from_ast", "from_fallback",
)
METHOD_BEGINS = ("from_", "into_", "as_", "to_", "get_", "is_", "has_", "with_")

TEST_PATH = r"_test\.rs|/tests?/|test_"


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _finding(rows: DataFrame, id: str, severity: str, line: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(id).alias("id"), F.lit("organization").alias("category"), F.lit(severity).alias("severity"), "file", line.cast("long").alias("line"), text.alias("message"))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def magic_numbers(lines: DataFrame) -> DataFrame:
    """ORG001: numbers of five digits or more that are not well known, outside constants, one row a number."""
    code = lines.where(~file_name("file").rlike("constant|config") & ~F.col("line").rlike(r"^\s*(pub\s+)?(const|static)\b|^\s*#|assert"))
    each = code.select("file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\b([0-9]{5,})\b"), F.lit(1))).alias("value"))
    return _finding(each.where(~F.col("value").isin(*COMMON_NUMBERS)), "ORG001", "info", F.col("line_no") + 1, F.concat(F.lit("magic number "), "value"))


def repeated_strings(lines: DataFrame, least_files: int = 4) -> DataFrame:
    """ORG002: string literals of 15 characters or more in ``least_files`` files; the file is the first of them."""
    code = lines.where(~file_name("file").contains("constant") & ~F.col("line").rlike(r"^\s*(#\[|(pub )?(const|static) )"))
    each = code.select("file", F.explode(F.regexp_extract_all("line", F.lit(r'"([^"\\]{15,})"'), F.lit(1))).alias("value"))
    v = F.col("value")
    usual = _any([v.contains(x) for x in STRING_HOLDS] + [v.startswith(x) for x in STRING_BEGINS] + [v.endswith(x) for x in STRING_ENDS])
    # a file counts once for a value before the value is shuffled
    by = each.where(~usual).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("file"))
    return _finding(by.where(F.col("files") >= least_files), "ORG002", "info", F.lit(None), F.concat(F.lit("in "), F.col("files").cast("string"), F.lit(" files: "), "value"))


def misplaced_files(files: DataFrame) -> DataFrame:
    """ORG005: adapters in the domain, ports in the infrastructure, settings and errors scattered; paths alone are read."""
    f, name = F.col("file"), file_name("file")
    inner = F.size(F.split(F.regexp_extract("file", r"(?:^|/)src/(.*)$", 1), "/"))
    rules = (
        (f.rlike("domain[^/]*/(.*/)?adapters/"), "error", "adapters belong to the infrastructure"),
        (f.rlike("infrastructure[^/]*/(.*/)?ports/"), "error", "ports belong to the domain"),
        (name.contains("config") & ~name.contains("handler") & ~f.rlike(r"/config/|/config\.rs|/admin/") & (inner > 1), "info", "settings are scattered"),
        ((name == "error.rs") & ~f.contains("/error/") & (inner > 2), "info", "errors are scattered"),
    )
    hits = F.array(*[F.when(ok, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for ok, s, m in rules])
    rows = files.select("file", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r"))
    return rows.select(F.lit("ORG005").alias("id"), F.lit("organization").alias("category"), "r.severity", "file", F.lit(None).cast("long").alias("line"), "r.message")


def traits_outside_ports(lines: DataFrame) -> DataFrame:
    """ORG007: public traits that look like ports, outside the domain's ports and the wiring."""
    name = F.regexp_extract("line", r"^\s*pub\s+(?:unsafe\s+)?trait\s+([A-Z]\w*)", 1)
    rows = lines.where(~F.col("file").rlike(r"domain[^/]*/|/ports/|/di/")).withColumn("name", name)
    port = F.col("name").rlike("Provider|Service|Repository|Interface$")
    spared = _any([F.col("name").endswith(x) for x in TRAIT_ENDS]) | F.col("name").isin(*INNER_TRAITS)
    return _finding(rows.where(port & ~spared), "ORG007", "warning", F.col("line_no") + 1, F.concat(F.lit("port outside ports: "), "name"))


def built_services(lines: DataFrame) -> DataFrame:
    """ORG013: the server builds its services itself, outside builders, factories and bootstraps."""
    rows = lines.where(F.col("file").contains("/server/") & ~file_name("file").rlike("builder|factory|bootstrap"))
    name = F.regexp_extract("line", r"Arc::new\s*\(\s*([A-Z]\w*(?:Service|Provider|Repository))::new", 1)
    return _finding(rows.withColumn("name", name).where("name != ''"), "ORG013", "warning", F.col("line_no") + 1, F.concat(F.lit("server builds "), "name"))


def server_imports(lines: DataFrame) -> DataFrame:
    """ORG014: application or infrastructure import the server."""
    rows = lines.where(F.col("file").rlike("/(application|infrastructure)/") & F.col("line").rlike(r"\buse\s+(crate::|super::)*server::") & ~F.col("line").contains("pub use"))
    return _finding(rows, "ORG014", "warning", F.col("line_no") + 1, "the server is imported from an inner layer")


def strict_directories(lines: DataFrame) -> DataFrame:
    """ORG015, ORG017, ORG018: adapters, handlers and ports by name, outside their directories."""
    of = lambda p: F.regexp_extract("line", p, 1)
    rules = (
        ("ORG015", of(r"^\s*impl\s+\w*(?:Provider|Repository)\s+for\s+([A-Z]\w*)"), ~F.col("file").rlike("/(adapters|providers|repositories|di)/"), "adapter outside adapters: "),
        ("ORG017", of(r"^\s*pub\s+struct\s+([A-Z]\w*Handler)\b"), F.col("file").contains("/server/") & ~F.col("file").rlike("/(handlers|admin)/"), "handler outside handlers: "),
        ("ORG018", of(r"^\s*pub\s+trait\s+([A-Z]\w*(?:Port|Gateway))\b"), F.col("file").rlike("domain[^/]*/") & ~F.col("file").contains("/ports/"), "port outside ports: "),
    )
    hits = F.array(*[F.when((name != "") & where, F.struct(F.lit(i).alias("id"), F.concat(F.lit(m), name).alias("message"))) for i, name, where, m in rules])
    rows = lines.select("file", "line_no", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r"))
    return rows.select("r.id", F.lit("organization").alias("category"), F.lit("warning").alias("severity"), "file", (F.col("line_no") + 1).cast("long").alias("line"), "r.message")


def domain_behaviour(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """ORG016: methods that do more than make, read or convert, in an implementation in the domain; ``nodes`` is the files' block tree."""
    around = nodes.where("kind = 'implementation'").select("file", F.col("pre").alias("parent"), F.col("name").alias("type"))
    fn = nodes.where((F.col("kind") == "function") & F.col("file").rlike("domain[^/]*/") & ~F.col("file").contains("/ports/")).join(around, ["file", "parent"])
    plain = F.col("name").isin(*PLAIN_METHODS) | _any([F.col("name").startswith(x) for x in METHOD_BEGINS])
    # of production code: its header is one of these lines
    kept = lines.select("file", F.col("line_no").alias("start_line"))
    return _finding(fn.where(~plain).join(kept, ["file", "start_line"]), "ORG016", "info", F.col("start_line") + 1, F.concat("type", F.lit("::"), "name", F.lit(" is behaviour in the domain")))


def organization_findings(lines: DataFrame) -> DataFrame:
    """All rules of this module on (file, line_no, line)."""
    production = production_lines(lines.where(~F.col("file").rlike(TEST_PATH)), "file").where(~F.ltrim("line").startswith("//"))
    parts = [rule(production) for rule in (magic_numbers, repeated_strings, traits_outside_ports, built_services, server_imports, strict_directories)]
    parts.append(misplaced_files(lines.select("file").distinct()))
    parts.append(domain_behaviour(production, block_tree.block_nodes(lines)))
    return reduce(DataFrame.unionByName, parts)
