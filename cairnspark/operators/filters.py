"""Search filters, argument checks, include and exclude globs, rule filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import extension

COLLECTION_NAME = r"^[A-Za-z0-9_-]{1,100}$"
SYSTEM_DIRS = ("/etc", "/proc", "/sys", "/dev", "/boot")


def glob_regex(glob: str) -> str:
    """``**`` crosses directories, ``*`` and ``?`` do not, ``{a,b}`` and ``[..]`` as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]")
            i = end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c)))
        i += 1
    return "^" + "".join(out) + "$"


def loose_glob(glob: str) -> str | None:
    """The looser reading of globs that clone exclusions have: found anywhere in a path,
    ``*`` stays within a segment, ``**`` is one character more, the rest is a regular
    expression; None if it is none."""
    out = re.sub(r"\*\*?", lambda m: ".[^/]*" if m[0] == "**" else "[^/]*", glob)
    try:
        re.compile(out)
    except re.error:
        return None
    return out


def matches_any(path: Column, globs: list[str]) -> Column:
    """Fits one of the include patterns and no ``!`` pattern; nothing fits an empty list."""
    return matches_globs(path, globs) if any(not g.startswith("!") for g in globs) else F.lit(False)


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Included by a pattern (or there is none) and excluded by no ``!`` pattern."""
    include = [glob_regex(g) for g in globs if not g.startswith("!")]
    exclude = [glob_regex(g[1:]) for g in globs if g.startswith("!")]
    ok = path.rlike("|".join(include)) if include else F.lit(True)
    return ok & ~path.rlike("|".join(exclude)) if exclude else ok


@dataclass(frozen=True)
class SearchFilters:
    extensions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_score: float | None = None

    def __post_init__(self) -> None:
        if self.min_score is not None and not 0 <= self.min_score <= 1:
            raise ValueError("min_score must lie in [0, 1]")

    def column(self, path: str = "path", language: str = "language", score: str = "score") -> Column:
        out = F.lit(True)
        if self.extensions:
            out &= extension(F.col(path)).isin(*[e.lower().lstrip(".") for e in self.extensions])
        if self.languages:
            out &= F.lower(language).isin(*[x.lower() for x in self.languages])
        if self.exclude:
            out &= matches_globs(F.col(path), [f"!{g}" for g in self.exclude])
        if self.min_score is not None:
            out &= F.col(score) >= self.min_score
        return out


@dataclass(frozen=True)
class SearchArgs:
    query: str
    limit: int = 10
    collection: str = "default"
    filters: SearchFilters = field(default_factory=SearchFilters)

    def __post_init__(self) -> None:
        if not 1 <= len(self.query.strip()) <= 1000:
            raise ValueError("a query has 1 to 1000 characters")
        if re.search(r"<\s*script|javascript:|on\w+\s*=", self.query, re.IGNORECASE):
            raise ValueError("a query holds no script")
        if not 1 <= self.limit <= 1000:
            raise ValueError("a limit lies in 1 to 1000")
        if not re.fullmatch(COLLECTION_NAME[1:-1], self.collection):
            raise ValueError("a collection name has 1 to 100 letters, digits, _ or -")


def check_path(path: str) -> str:
    if not path or ".." in path.split("/") or any(path == d or path.startswith(f"{d}/") for d in SYSTEM_DIRS):
        raise ValueError("the path may not leave its root nor name a system folder")
    return path


def valid_collection(name: Column) -> Column:
    return F.coalesce(name.rlike(COLLECTION_NAME), F.lit(False))


def rule_applies(path: Column, language: Column, dependencies: Column, owner: Column, languages: list[str], needs: list[str], globs: list[str]) -> Column:
    """Languages and all needed dependencies and file patterns; no owner, no match where dependencies are asked for."""
    out = F.lit(True)
    if languages:
        out &= language.isin(*languages)
    if needs:
        out &= owner.isNotNull() & F.coalesce(F.forall(F.array(*map(F.lit, needs)), lambda d: F.array_contains(dependencies, d)), F.lit(False))
    return out & matches_globs(path, globs) if globs else out
