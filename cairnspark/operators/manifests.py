"""Crate manifests: dependencies read from their text, and findings on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import line_table
from . import graphs

SECTION, ENTRY = r"^\s*\[+\s*([^\]]+?)\s*\]+", r"^\s*\"?([A-Za-z0-9_-]+)\"?(?:\.[a-z-]+)?\s*="
KINDS = r"^(?:workspace\.|target\..*\.)?((?:dev-|build-)?dependencies)(?:\.\"?([A-Za-z0-9_-]+)\"?)?$"


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """crate, dependency, kind (the section), file of the manifests (file, content).

    Reads ``name = ...`` lines below ``[dependencies]`` and its relatives, and
    ``[dependencies.name]`` sections.  A manifest without a package name has none.
    """
    ls = line_table(files.select("file", "content")).withColumn("line", F.regexp_replace("line", r"\s*#.*$", ""))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(SECTION), F.regexp_extract("line", SECTION, 1))
    ls = ls.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(w))
    name = F.when((F.col("section") == "package") & F.col("line").rlike(r"^\s*name\s*="), F.regexp_extract("line", r"\"([^\"]*)\"", 1))
    names = ls.select("file", name.alias("crate")).where("crate is not null").groupBy("file").agg(F.min("crate").alias("crate"))
    kind, own = F.regexp_extract("section", KINDS, 1), F.regexp_extract("section", KINDS, 2)
    # an entry of a list of dependencies, or the head of a dependency's own section
    entry = F.when((own == "") & F.col("head").isNull(), F.regexp_extract("line", ENTRY, 1)).when((own != "") & F.col("head").isNotNull(), own)
    deps = ls.where(F.col("section").rlike(KINDS)).select("file", kind.alias("kind"), entry.alias("dependency")).where("dependency != ''")
    return deps.join(names, "file").select("crate", "dependency", "kind", "file").distinct()


def dependency_findings(deps: DataFrame, uses: DataFrame, allowed: DataFrame) -> DataFrame:
    """id, category, severity, file, line, message of DEP001 (a manifest names an internal crate
    that is not allowed), DEP002 (a source imports one) and DEP003 (crates in a cycle).

    ``deps``: as manifest_dependencies gives them.  ``uses``: crate, dependency, file, line of
    imports.  ``allowed``: crate, dependency.  Internal crates are those with a manifest.
    """
    crates = deps.select("crate").distinct()
    inside = lambda df: df.join(crates.select(F.col("crate").alias("dependency")), "dependency", "left_semi")
    beyond = lambda df: inside(df).where("crate != dependency").join(allowed.select("crate", "dependency").distinct(), ["crate", "dependency"], "left_anti")
    row = lambda df, i, line, text: df.select(F.lit(i).alias("id"), F.lit("dependency").alias("category"), F.lit("error").alias("severity"), "file", line.alias("line"), text.alias("message"))
    edge = F.concat("crate", F.lit(" -> "), "dependency")
    plain = deps.where("kind = 'dependencies'")
    one = row(beyond(plain), "DEP001", F.lit(1).cast("long"), edge)
    two = row(beyond(uses), "DEP002", F.col("line").cast("long"), edge)
    loops = graphs.cycles(inside(plain).select(F.col("crate").alias("src"), F.col("dependency").alias("dst")).distinct())
    homes = deps.groupBy("crate").agg(F.min("file").alias("file"))
    loops = loops.withColumn("crate", F.get("path", F.lit(0))).join(homes, "crate")
    three = row(loops, "DEP003", F.lit(1).cast("long"), F.concat_ws(" -> ", "path", F.get("path", F.lit(0))))
    return one.unionByName(two).unionByName(three)


def refactoring_findings(files: DataFrame, skip: tuple[str, ...] = ("mod", "lib", "main")) -> DataFrame:
    """REF002 (a public type defined in several files), REF003 (a source without a test file) and
    REF005 (``mod x;`` with neither x.rs nor x/mod.rs beside it) of (file, content)."""
    ls = line_table(files.select("file", "content"))
    row = lambda df, i, line, text: df.select(F.lit(i).alias("id"), F.lit("refactoring").alias("category"), F.lit("warning").alias("severity"), "file", line.cast("long").alias("line"), text.alias("message"))
    define = r"^\s*pub\s+(?:struct|enum|trait)\s+(\w+)"
    types = ls.where(F.col("line").rlike(define)).select("file", (F.col("line_no") + 1).alias("line"), F.regexp_extract("line", define, 1).alias("name"))
    several = types.groupBy("name").agg(F.min("file").alias("x"), F.max("file").alias("y")).where("x != y").select("name")
    two = row(types.join(several, "name"), "REF002", F.col("line"), F.col("name"))

    stem, folder = F.regexp_extract("file", r"([^/]+)\.rs$", 1), F.regexp_extract("file", r"^(.*/)?[^/]+$", 1)
    sources = files.select("file", stem.alias("stem"), folder.alias("folder"))
    tests = sources.where(F.contains("file", F.lit("tests/"))).select(F.regexp_replace("stem", r"^test_|_tests?$", "").alias("stem")).distinct()
    owners = sources.where(F.contains("file", F.lit("src/")) & (F.col("stem") != "") & ~F.col("stem").isin(*skip))
    three = row(owners.join(tests, "stem", "left_anti"), "REF003", F.lit(1), F.col("stem"))

    declared = r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)\s*;"
    mods = ls.where(F.col("line").rlike(declared)).select("file", (F.col("line_no") + 1).alias("line"), F.regexp_extract("line", declared, 1).alias("name"))
    mods = mods.withColumn("folder", F.regexp_extract("file", r"^(.*/)?[^/]+$", 1))
    there = sources.select(F.concat("folder", "stem").alias("at")).unionByName(sources.where("stem = 'mod'").select(F.regexp_replace("folder", "/$", "").alias("at"))).distinct()
    five = row(mods.join(there, F.concat(mods["folder"], mods["name"]) == there["at"], "left_anti"), "REF005", F.col("line"), F.col("name"))
    return two.unionByName(three).unionByName(five)


def mutual_layers(uses: DataFrame) -> DataFrame:
    """LAYER002: pairs of crates that import each other, at each one's first import of the other."""
    first = uses.where("crate != dependency").groupBy("crate", "dependency").agg(F.min(F.struct("file", "line")).alias("at"))
    back = first.select(F.col("dependency").alias("crate"), F.col("crate").alias("dependency"))
    both = first.join(back, ["crate", "dependency"], "left_semi")
    return both.select(
        F.lit("LAYER002").alias("id"), F.lit("layers").alias("category"), F.lit("error").alias("severity"),
        "at.file", F.col("at.line").cast("long").alias("line"), F.concat("crate", F.lit(" <-> "), "dependency").alias("message"),
    )
