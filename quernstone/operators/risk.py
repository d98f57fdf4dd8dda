"""Sources, sinks and sanitizers in code: local taint by lines, flows along calls, summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.operators.keyed import top_n
from quernstone.runtime import cut


@dataclass(frozen=True)
class Rule:
    """One pattern of risk. kind: source, sink or sanitizer."""

    id: str
    kind: str
    pattern: str
    category: str = ""
    severity: str = ""
    confidence: float = 0.5


# What counts as input, as danger and as cleaning: eleven sources, seven sinks, two sanitizers.
RULES = [
    Rule("request-body", "source", r"\b(?:req|request)\.(?:body|json|form|files)\b", "input", confidence=0.6),
    Rule("request-query", "source", r"\b(?:req|request)\.(?:query|params|args|GET|POST)\b", "input", confidence=0.6),
    Rule("request-headers", "source", r"\b(?:req|request)\.(?:headers|cookies)\b", "input", confidence=0.55),
    Rule("environment", "source", r"\bprocess\.env\b|\bos\.environ\b|\bos\.[gG]etenv\b|\bstd::env::var\b", "config", confidence=0.55),
    Rule("arguments", "source", r"\bprocess\.argv\b|\bsys\.argv\b|\bos\.Args\b|\benv::args\b|\bargv\s*\[", "input", confidence=0.55),
    Rule("stdin", "source", r"\binput\s*\(|\breadline\s*\(|\bstdin\b|\bscanf\s*\(|\bgets\s*\(", "input", confidence=0.5),
    Rule("file-read", "source", r"\breadFile(?:Sync)?\s*\(|\bopen\s*\([^)]*\)\s*\.read|\bioutil\.ReadFile\b|\bfs::read\w*\s*\(|\bfread\s*\(", "file", confidence=0.45),
    Rule("network-read", "source", r"\bfetch\s*\(|\brequests\.(?:get|post)\s*\(|\bhttp\.Get\s*\(|\baxios\b|\brecv\s*\(", "network", confidence=0.45),
    Rule("location", "source", r"\b(?:window|document)\.location\b|\blocation\.(?:hash|search|href)\b", "input", confidence=0.55),
    Rule("storage", "source", r"\b(?:local|session)Storage\.getItem\s*\(", "storage", confidence=0.45),
    Rule("message", "source", r"\bevent\.data\b|\bonmessage\b", "input", confidence=0.45),
    Rule("eval", "sink", r"\beval\s*\(|\bnew\s+Function\s*\(|\bexec\s*\(\s*compile\b", "code-exec", "critical", 0.8),
    Rule("command", "sink", r"\b(?:exec|execSync|spawn|spawnSync|system|popen)\s*\(|\bsubprocess\.\w+\s*\(|\bexec\.Command\s*\(|\bCommand::new\s*\(", "command", "high", 0.7),
    Rule("query", "sink", r"\.(?:query|execute|executemany|raw)\s*\(", "sql", "high", 0.6),
    Rule("markup", "sink", r"\binnerHTML\s*=|\bouterHTML\s*=|\bdangerouslySetInnerHTML\b|\bdocument\.write\s*\(", "xss", "high", 0.65),
    Rule("file-write", "sink", r"\bwriteFile(?:Sync)?\s*\(|\bunlink(?:Sync)?\s*\(|\bos\.remove\s*\(|\bfs::write\s*\(", "file", "medium", 0.5),
    Rule("deserialize", "sink", r"\bpickle\.loads?\s*\(|\byaml\.load\s*\(|\bunserialize\s*\(", "deserialization", "high", 0.7),
    Rule("redirect", "sink", r"\.redirect\s*\(|\blocation\.(?:href|assign|replace)\s*(?:=|\()", "redirect", "medium", 0.5),
    Rule("escape", "sanitizer", r"\b(?:escape|encodeURIComponent|quote|htmlspecialchars)\w*\s*\(", confidence=0.5),
    Rule("sanitize", "sanitizer", r"\b(?:sanitize|DOMPurify|validate|clean)\w*[.(]", confidence=0.5),
]
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
_ASSIGN = re.compile(r"(?:(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*:?=(?![=>])\s*(.+)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def scan(text: str, rules: list[Rule], compiled: dict | None = None) -> list[tuple[int, str, str, float]]:
    """(line, source, sink, confidence) of flows within a text.

    An assignment from a source, or from a tainted name, taints its name; from a sanitizer it is clean, as are names that a
    sanitizer is given. A sink on a line with a tainted name or a source is a flow of each.
    """
    compiled = compiled or {r.id: re.compile(r.pattern) for r in rules}
    by = {k: [r for r in rules if r.kind == k] for k in ("source", "sink", "sanitizer")}
    tainted: dict[str, frozenset[str]] = {}
    confidence = {r.id: r.confidence for r in rules}
    flows = []
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare.startswith(("//", "#", "*", "/*")):
            continue
        here = [r.id for r in by["source"] if compiled[r.id].search(bare)]
        clean = any(compiled[r.id].search(bare) for r in by["sanitizer"])
        names = set(_NAME.findall(bare))
        if clean:
            for name in names & tainted.keys():
                del tainted[name]
        carried = {s for name in names & tainted.keys() for s in tainted[name]}
        sources = sorted(({*here} | carried)) if not clean else []
        for sink in by["sink"]:
            if compiled[sink.id].search(bare):
                for s in sources:
                    flows.append((n, s, sink.id, (confidence[s] * sink.confidence) ** 0.5))
        m = None if any(x in bare for x in ("==", "!=", ">=", "<=")) else _ASSIGN.match(bare)
        if m:
            rhs = set(_NAME.findall(m.group(2)))
            got = frozenset() if clean else frozenset(here) | frozenset(s for name in rhs & tainted.keys() for s in tainted[name])
            if got:
                tainted[m.group(1)] = got
            else:
                tainted.pop(m.group(1), None)
    return flows


_FLOW = StructType([StructField("id", LongType()), StructField("line", IntegerType()), StructField("source", StringType()), StructField("sink", StringType()), StructField("confidence", DoubleType())])


def local_flows(chunks: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(id, line, source, sink, confidence) of flows in chunks (id, text)."""
    def make():
        compiled = {r.id: re.compile(r.pattern) for r in rules}

        def kernel(id_, text):
            for n, s, k, c in scan(text or "", rules, compiled):
                yield id_, n, s, k, c
        return kernel

    return map_rows(chunks.select("id", "text"), make, _FLOW)


def signals(chunks: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(id, rule, kind, category, severity, confidence) of each rule a chunk's text matches. Patterns run in the engine."""
    matched = F.array_compact(F.array(*[F.when(F.col("text").rlike(r.pattern), F.struct(*[F.lit(getattr(r, f)).alias(f if f != "id" else "rule") for f in ("id", "kind", "category", "severity", "confidence")])) for r in rules]))
    return chunks.select("id", F.explode(matched).alias("m")).select("id", "m.*")


def rollup(found: DataFrame) -> DataFrame:
    """(id, categories, confidence, severity) of a chunk's signals; sources without a sink are low."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    worst = F.max(F.when(F.col("kind") == "sink", F.struct(rank[F.col("severity")].alias("r"), "severity")))
    return found.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))).alias("categories"), F.max("confidence").alias("confidence"),
        F.coalesce(worst["severity"], F.when(F.max((F.col("kind") == "source").cast("int")) == 1, "low")).alias("severity"))


def hop_confidence(source: Column, sink: Column, hops: Column, barriers: Column) -> Column:
    """Confidence of a flow over calls: it falls with hops and with sanitizers on the way, within 0.05 and 1."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.sqrt(source * sink) * F.pow(F.lit(0.85), hops) * F.pow(F.lit(0.9), barriers)))


def interprocedural(found: DataFrame, calls: DataFrame, depth: int = 4, paths: int = 3, most: int | None = None) -> DataFrame:
    """(source_id, sink_id, source, sink, hops, confidence): flows from chunks with a source along calls to others with a sink.

    found: signals of chunks; calls: src, dst. Each pair of chunks counts at its least number of hops. The frontier is cut at each level, and each pair keeps
    its `paths` most confident flows; most, if given, bounds all flows, the most confident first.
    """
    sources = found.filter("kind = 'source'").select(F.col("id").alias("source_id"), F.col("rule").alias("source"), F.col("confidence").alias("sc")).distinct()
    sinks = found.filter("kind = 'sink'").select(F.col("id").alias("sink_id"), F.col("rule").alias("sink"), F.col("confidence").alias("kc")).distinct()
    barrier = found.filter("kind = 'sanitizer'").select(F.col("id").alias("node")).distinct().withColumn("b", F.lit(1))
    steps = calls.select("src", "dst").distinct()
    frontier = cut(sources.select("source_id").distinct().select("source_id", F.col("source_id").alias("node"), F.lit(0).alias("hops"), F.lit(0).alias("barriers")))
    seen = frontier
    for d in range(1, depth + 1):
        nxt = frontier.join(steps, frontier["node"] == steps["src"]).select("source_id", F.col("dst").alias("node"), "barriers")
        nxt = nxt.join(seen.select("source_id", "node"), ["source_id", "node"], "left_anti").join(barrier, "node", "left")
        frontier = cut(nxt.groupBy("source_id", "node").agg(F.min(F.col("barriers") + F.coalesce("b", F.lit(0))).alias("barriers")).select("source_id", "node", F.lit(d).alias("hops"), "barriers"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    reached = seen.filter("hops > 0").withColumnRenamed("node", "sink_id")
    flows = reached.join(sinks, "sink_id").join(sources, "source_id").select("source_id", "sink_id", "source", "sink", "hops", F.round(hop_confidence(F.col("sc"), F.col("kc"), F.col("hops"), F.col("barriers")), 6).alias("confidence"))
    kept = top_n(flows, ["source_id", "sink_id"], [F.desc("confidence"), F.asc("source"), F.asc("sink")], paths)
    return kept if most is None else kept.orderBy(F.desc("confidence"), "source_id", "sink_id", "source", "sink").limit(most)


def ranked(flows: DataFrame, seeds: DataFrame, severity: Column, most: int) -> DataFrame:
    """The `most` first flows of each source chunk: those that touch a seed (column id) first, then severity, confidence, fewer hops, ids."""
    near = seeds.select(F.col("id").alias("sink_id")).distinct().withColumn("near", F.lit(1))
    level = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[severity]
    f = flows.join(near, "sink_id", "left").withColumns({"near": F.coalesce("near", F.lit(0)), "level": F.coalesce(level, F.lit(0))})
    return top_n(f, ["source_id"], [F.desc("near"), F.desc("level"), F.desc("confidence"), F.asc("hops"), F.asc("sink_id"), F.asc("sink"), F.asc("source")], most).drop("near", "level")


def sarif(flows: DataFrame) -> DataFrame:
    """(result): a SARIF result of each flow (id, line, source, sink), as JSON."""
    return flows.select(F.to_json(F.struct(
        F.col("sink").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.concat(F.col("source"), F.lit(" -> "), F.col("sink")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))).alias("result"))
