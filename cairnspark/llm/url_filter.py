"""URL filters: host/path rules first, then a path-template tree per host.

Native: DataFrame functions only.

Tree.  A path is cut into segments and every digit run of a segment becomes
``#``.  Urls are pre-aggregated by (host, shaped path) before anything else, so
that a host with a third of all pages costs a few rows.  Level by level, a child
segment keeps a branch of its own only if it has ``min_labels`` labelled pages
and its labelled bad rate differs from that of its siblings (two-proportion
z test, ``z2`` = critical value of z squared).  All other children are
statistically similar, whatever their names (names, dates, hashes), and merge into
the wildcard ``*``.  Of those that differ, the ones with a higher rate than their
siblings are compared with each other likewise, and so are the ones with a lower
rate: those that do not differ merge into one branch, ``(first..)``.  A branch
grows as long as it has both kinds of labels, more than ``min_labels`` in all;
else what lies deeper merges into ``**``.  A segment that itself begins like a
wildcard (with ``*``, ``(`` or a backslash) is written with a backslash before it.
No depth is fixed: a round takes each open branch past all segments that its urls
share, which can only be ``*``, to where they part.

Purity.  A template's bad rate is smoothed towards its host's and the host's
towards the global rate, each with ``prior`` pseudo-counts.  A template with a
smoothed rate of ``reject`` or more, and ``min_labels`` labelled pages, is
blocked.

Edge cases.  A null url or one without ``://`` has an empty host and path, fits
no rule, and is judged like any other (empty) template.  Repeated pages are
judged alike; pages without a label count as unlabelled; with no labels at all
everything is allowed; column names may differ in case and extra columns do no
harm; an empty table gives an empty result.  Very long urls
cost their length in every round they stay open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, pick

#: (verdict, rule) of the registered query; a rule is host + path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_LABELS, Z2, PRIOR, REJECT = 5, 3.84, 5.0, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        if rule is None:
            rule, verdict = F.when(fits, text), F.when(fits, kind)
        else:
            rule, verdict = rule.when(fits, text), verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape_of(path: Column) -> Column:
    """The path without outer slashes, with ``#`` for digit runs."""
    return F.regexp_replace(F.regexp_replace(path, r"^/|/$", ""), r"[0-9]+", "#")


def _differs(n: Column, bad: Column, all_n: Column, all_bad: Column, z2: float) -> Column:
    """Does a part's rate differ from that of the rest?  z squared, with the pooled variance."""
    rest, rate = F.when(all_n > n, all_n - n), all_bad / all_n
    gap = bad / n - (all_bad - bad) / rest
    return rest.isNotNull() & (all_bad > 0) & (all_bad < all_n) & (gap * gap >= z2 * rate * (1 - rate) * (1 / n + 1 / rest))


def template_tree(urls: DataFrame, min_labels: int = MIN_LABELS, z2: float = Z2) -> DataFrame:
    """(host, shape, template, n, lab, bad) of (host, shape, bad): bad is 1, 0 or null."""
    rows = materialize(
        urls.groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("*", F.lit("").alias("template"), F.lit(0).alias("level"), F.lit(True).alias("open"))
    )
    c, grows = F.col, f"pb > 0 and pb < pl and pl > {min_labels}"
    segs = F.split("shape", "/")
    closed = [rows.limit(0)]
    while not rows.isEmpty():
        # the segments that all open urls of a branch share
        ends = rows.groupBy("host", "template").agg(F.sum("lab").alias("pl"), F.sum("bad").alias("pb"), F.min(segs).alias("lo"), F.max(segs).alias("hi"))
        same = F.aggregate(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.get("lo", n) == F.get("hi", n)), k).otherwise(n))
        t = rows.join(ends.where(grows).select("host", "template", same.alias("same")), ["host", "template"], "left")
        run = F.greatest(F.coalesce("same", F.lit(0)) - c("level"), F.lit(0))
        t = materialize(t.select("host", "shape", "n", "lab", "bad", F.concat("template", F.repeat(F.lit("/*"), run)).alias("template"), (c("level") + run).alias("level")).withColumn("seg", F.get(segs, c("level"))))
        child = t.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("lab").alias("cl"), F.sum("bad").alias("cb"))
        node = child.groupBy("host", "template").agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb")).where(grows)
        own = child.where(c("cl") >= min_labels).join(node, ["host", "template"]).where(_differs(c("cl"), c("cb"), c("pl"), c("pb"), z2))
        own = own.select("host", "template", "seg", "cl", "cb", (c("cb") * c("pl") > c("pb") * c("cl")).alias("high"))
        alike = own.groupBy("host", "template", "high").agg(F.sum("cl").alias("gl"), F.sum("cb").alias("gb"), F.count(F.lit(1)).alias("k"), F.min("seg").alias("first"))
        own = own.join(alike, ["host", "template", "high"])
        alone = (c("k") == 1) | F.coalesce(_differs(c("cl"), c("cb"), c("gl"), c("gb"), z2), F.lit(False))
        plain = F.when(c("seg").rlike(r"^[*(\\]"), F.concat(F.lit("\\"), "seg")).otherwise(c("seg"))
        own = own.select("host", "template", "seg", F.when(alone, plain).otherwise(F.concat(F.lit("("), c("first"), F.lit("..)"))).alias("name"))
        t = t.join(own, ["host", "template", "seg"], "left").join(node.select("host", "template", F.lit(True).alias("grows")), ["host", "template"], "left")
        step = F.when(c("grows"), F.coalesce("name", F.lit("*"))).otherwise(F.lit("**"))
        t = materialize(t.select(
            "host", "shape", "n", "lab", "bad",
            F.when(c("seg").isNull(), c("template")).otherwise(F.concat("template", F.lit("/"), step)).alias("template"),
            (c("level") + 1).alias("level"), (c("seg").isNotNull() & c("grows").isNotNull()).alias("open"),
        ))
        closed.append(t.where("not open"))
        rows = t.where("open")
    return reduce(DataFrame.unionByName, closed).drop("level", "open")


def rejected_shapes(tree: DataFrame, min_labels: int = MIN_LABELS, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """(host, shape, template) of the templates that their labels condemn."""
    leaf = tree.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    host = leaf.groupBy("host").agg(F.sum("lab").alias("hl"), F.sum("bad").alias("hb"))
    every = host.agg(F.sum("hl").alias("al"), F.sum("hb").alias("ab"))
    # one row, an aggregate without keys: its size is fixed
    rates = host.join(F.broadcast(every), F.col("al") > 0).select(
        "host", ((F.col("hb") + prior * F.col("ab") / F.col("al")) / (F.col("hl") + prior)).alias("host_rate")
    )
    bad = (
        leaf.where(F.col("lab") >= min_labels)
        .join(rates, "host")
        .where((F.col("bad") + prior * F.col("host_rate")) / (F.col("lab") + prior) >= reject)
    )
    return tree.join(bad.select("host", "template"), ["host", "template"]).select("host", "shape", "template")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict and, if the tree blocks it, the template.

    ``pages``: page_id, url.  ``labels``: page_id and bad (1 or 0), one row a page at most.
    """
    host, path = url_parts(F.col("url"))
    urls = (
        pick(pages, page_id="long", url="string")
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("shape", shape_of(F.col("path")))
    )
    lab = pick(labels, page_id="long", bad="int").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = {k: v for k, v in limits.items() if k in ("min_labels", "z2")}
    tree = template_tree(urls.join(lab, "page_id", "left"), **known)
    known = {k: v for k, v in limits.items() if k in ("min_labels", "prior", "reject")}
    bad = rejected_shapes(tree, **known)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return (
        urls.join(bad, ["host", "shape"], "left")
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("template").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            "template",
        )
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) for pages whose last path number is a labelled document.

    A page is bad if its document has quality 0 or is toxic.
    """
    _, path = url_parts(F.col("url"))
    num = F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1)
    ids = pick(pages, page_id="long", url="string").select("page_id", F.when(num != "", num.cast("long")).alias("doc_id"))
    lab = (
        pick(labels, doc_id="long", quality="int", toxic="int")
        .groupBy("doc_id")
        .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    )
    return ids.join(lab, "doc_id").select("page_id", "bad")
