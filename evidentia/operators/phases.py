"""Detector phases in their order: each a function of a scan to findings of one form, with its potential; run united, potentials summed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import classes, detectors, graph, python_imports, resolve, review, script_rules, summaries
from evidentia.sources.written import written


@dataclass
class Scan:
    """What phases work on: lines (path, line, text) of the scanned files, zones (path, zone), edges (src, dst, deferred) between paths, and reviews (path, hash, day)."""

    lines: DataFrame
    zones: DataFrame
    edges: DataFrame
    reviews: DataFrame
    today: int
    entries: tuple[str, ...] = ("main", "__main__", "setup", "conftest")
    barrels: tuple[str, ...] = ("__init__.py", "index.ts", "index.tsx")

    @cached_property
    def sizes(self) -> DataFrame:
        """(path, loc, hash), one row per file: read by most phases, so written once."""
        return written(self.lines.groupBy("path").agg(F.count("*").alias("loc"), F.sha2(F.sum(F.xxhash64("line", "text").cast("decimal(38,0)")).cast("string"), 256).alias("hash")))

    @cached_property
    def links(self) -> DataFrame:
        return written(self.edges.select("src", "dst", "deferred"))

    @cached_property
    def members(self) -> DataFrame:
        return written(classes.members(self.lines))


@dataclass(frozen=True)
class Phase:
    """rows: (file, key) of its findings. potential: one row (n); without it, the number of files."""

    label: str
    detector: str
    rows: Callable[[Scan], DataFrame]
    potential: Callable[[Scan], DataFrame] = lambda s: s.sizes.agg(F.count("*").alias("n"))


def _rows(df: DataFrame, file: str, *key: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), F.concat_ws("::", *(F.col(k).cast("string") for k in key)).alias("key"))


def _nodes(s: Scan) -> DataFrame:
    return s.sizes.select(F.col("path").alias("node"), "path", "loc")


_FOLDERS = lambda s: s.sizes.select(F.regexp_replace("path", "/?[^/]*$", "")).distinct().agg(F.count("*").alias("n"))
STRUCTURAL = [
    Phase("large files", "structural", lambda s: _rows(detectors.large_files(s.lines), "path", "loc")),
    Phase("cycles", "cycles", lambda s: _rows(graph.strong_components(s.links.where("not deferred").select("src", "dst")).select("component", "size").distinct(), "component", "size"), lambda s: graph.nodes(s.links).agg(F.count("*").alias("n"))),
    Phase("coupling", "coupling", lambda s: _rows(graph.coupled(s.links), "node", "confidence")),
    Phase("orphaned files", "orphaned", lambda s: _rows(graph.orphans(_nodes(s), s.links, [*s.entries], [*s.barrels]), "path")),
    Phase("flat directories", "flat_dirs", lambda s: _rows(summaries.flat_directories(s.sizes), "dir", "files"), _FOLDERS),
    Phase("naming", "naming", lambda s: _rows(summaries.naming_minority(s.sizes), "dir", "convention")),
    Phase("single use", "single_use", lambda s: _rows(graph.single_use(s.links, _nodes(s).select("node", "loc")), "node", "importer")),
    Phase("complexity", "structural", lambda s: _rows(detectors.complexity(s.lines), "path", "score")),
    Phase("security", "security", lambda s: _rows(detectors.rule_hits(s.lines, detectors.SECURITY), "path", "rule", "line")),
]
COVERAGE = [
    Phase("test coverage", "test_coverage", lambda s: _rows(detectors.uncovered(s.zones), "path")),
    Phase("review coverage", "review_coverage", lambda s: _rows(review.coverage(s.sizes.select("path", "hash"), s.reviews, s.today, 30).where("state <> 'fresh'"), "path", "state")),
]
PYTHON = [
    *STRUCTURAL,
    Phase("signature drift", "signature", lambda s: _rows(summaries.signature_drift(detectors.functions(s.lines)), "name", "defs"), lambda s: detectors.functions(s.lines).agg(F.count("*").alias("n"))),
    Phase("god classes", "structural", lambda s: _rows(resolve.god_classes(s.members), "path", "name", "rules"), lambda s: s.members.agg(F.count("*").alias("n"))),
    Phase("smells", "smells", lambda s: _rows(detectors.mutable_globals(s.lines), "path", "name", "line")),
    Phase("unused imports", "unused", lambda s: _rows(python_imports.unused(s.lines), "path", "name", "line")),
    Phase("uncalled functions", "uncalled_functions", lambda s: _rows(detectors.uncalled(s.lines), "file", "name", "line")),
    Phase("facades", "facade", lambda s: _rows(resolve.facades(s.lines), "path", "reexports")),
    Phase("private imports", "private_imports", lambda s: _rows(script_rules.private_imports(s.lines, s.sizes), "path", "private_name", "resolved")),
    Phase("dict keys", "dict_keys", lambda s: _rows(detectors.dict_keys(s.lines), "path", "keys")),
    Phase("responsibility", "responsibility_cohesion", lambda s: _rows(resolve.responsibilities(s.members), "path", "name", "kind")),
    *COVERAGE,
]
TYPESCRIPT = [
    *STRUCTURAL,
    Phase("console logs", "ts_logs", lambda s: _rows(detectors.console_logs(s.lines), "path", "n")),
    Phase("script smells", "ts_smells", lambda s: _rows(detectors.counted_hits(s.lines, detectors.TS_SMELLS), "path", "rule")),
    Phase("script security", "ts_security", lambda s: _rows(detectors.rule_hits(s.lines, detectors.TS_SECURITY), "path", "rule", "line")),
    Phase("unused script imports", "ts_unused", lambda s: _rows(script_rules.unused_script_imports(s.lines), "path", "name", "line")),
    Phase("component patterns", "react", lambda s: _rows(script_rules.empty_effects(s.lines).unionByName(script_rules.hooks_in_conditions(s.lines)), "path", "line")),
    *COVERAGE,
]


def run(phases: list[Phase], scan: Scan) -> DataFrame:
    """(place, phase, detector, file, key) of the findings of all phases, in one union."""
    parts = [p.rows(scan).select(F.lit(n).alias("place"), F.lit(p.label).alias("phase"), F.lit(p.detector).alias("detector"), "file", "key") for n, p in enumerate(phases)]
    return reduce(DataFrame.union, parts)


def potentials(phases: list[Phase], scan: Scan) -> DataFrame:
    """(detector, potential): summed over the phases that share a detector."""
    parts = [p.potential(scan).select(F.lit(p.detector).alias("detector"), "n") for p in phases]
    return reduce(DataFrame.union, parts).groupBy("detector").agg(F.sum("n").alias("potential"))


def summary(phases: list[Phase], scan: Scan) -> DataFrame:
    """(place, phase, detector, findings), one row per phase, also for those that find nothing."""
    listed = scan.lines.sparkSession.createDataFrame([(n, p.label, p.detector) for n, p in enumerate(phases)], "place int, phase string, detector string")
    counts = run(phases, scan).groupBy("place").agg(F.count("*").alias("found"))
    return listed.join(counts, "place", "left").select("place", "phase", "detector", F.coalesce("found", F.lit(0)).cast("long").alias("findings"))
