"""Diagnosis of an evaluation: issues by rules over its metrics, a taxonomy of row issues, and semantic scores of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Issue, category, metric, and beyond what it is medium or high. Any of an issue's metrics raises it.
RULES = (
    ("generation_failures", "inference_reliability", "failure_rate", ">", 0.0, ">=", 0.10),
    ("semantic_fidelity_gap", "model_behavior", "semantic_similarity_mean", "<", 0.82, "<", 0.70),
    ("semantic_fidelity_gap", "model_behavior", "pct_above_0.8_similarity", "<", 0.78, "<", 0.50),
    ("textual_distance_gap", "model_behavior", "edit_distance_mean", ">", 0.40, ">", 0.55),
    ("textual_distance_gap", "model_behavior", "pct_below_0.4_edit_dist", "<", 0.82, "<", 0.60),
    ("structured_replication_gap", "model_behavior", "replication_f1_micro", "<", 0.75, "<", 0.50),
    ("structured_replication_gap", "model_behavior", "replication_recall_micro", "<", 0.75, "<", 0.55),
    ("structured_replication_gap", "model_behavior", "replication_category_gaps", ">", 0.0, None, None),
    ("grounded_hallucinations", "model_behavior", "replication_hallucination_rate", ">", 0.05, ">", 0.15),
    ("grounded_hallucinations", "model_behavior", "replication_groundedness_score_mean", "<", 0.95, "<", 0.85),
    ("solidity_validity_gap", "syntax_and_deployability", "solidity_valid_mean", "<", 0.95, "<", 0.75),
    ("bytecode_grounding_coverage_gap", "evaluation_data", "bytecode_semantic_checked_mean", "<", 0.95, None, None),
    ("bytecode_semantic_gap", "model_behavior", "bytecode_semantic_score_mean", "<", 0.80, "<", 0.60),
    ("deployability_gap", "syntax_and_deployability", "bytecode_deployable_mean", "<", 0.95, None, None),
    ("runtime_bytecode_mismatch", "model_behavior", "bytecode_runtime_match_mean", "<", 0.95, "<", 0.50),
    ("prompt_truncation", "prompting_and_context", "prompt_truncated_rate", ">", 0.0, ">=", 0.20),
    ("baseline_regressions", "regression_risk", "num_regressions", ">", 0.0, ">=", 3.0),
    ("quality_taxonomy_findings", "evaluation_data", "quality_issue_count", ">", 0.0, None, None),
)
#: A metric that counts only where another one is above 0, ranks, and priorities.
ONLY_IF = {"bytecode_runtime_match_mean": "bytecode_runtime_checked_mean"}
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
PRIORITIES = {"critical": "P0", "high": "P1", "medium": "P2", "low": "P3", "info": "P3"}
FEW = 30  # rows below which an evaluation tells little


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _beyond(value: Column, rules: list[tuple[str, float]]) -> Column:
    out = F.lit(False)
    for metric, op, bound in rules:
        hit = {"<": value < bound, ">": value > bound, ">=": value >= bound}[op]
        out = out | ((F.col("metric") == metric) & hit)
    return out


def diagnose(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, issue, category, severity, priority and evidence of ``metrics`` (``by``, metric, value); null values tell nothing.

    The rules are constants and become one expression, so metrics are read once and only issues are grouped.
    """
    known = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    for metric, other in ONLY_IF.items():
        checked = known.where((F.col("metric") == other) & (F.col("value") > 0)).select(*by, F.lit(metric).alias("metric")).distinct()
        counted = known.where(F.col("metric") == metric).join(checked, [*by, "metric"], "left_semi")
        known = known.where(F.col("metric") != metric).unionByName(counted)
    issue, category = (_map({r[2]: r[i] for r in RULES})[F.col("metric")] for i in (0, 1))
    medium = _beyond(F.col("value"), [(r[2], r[3], r[4]) for r in RULES])
    high = _beyond(F.col("value"), [(r[2], r[5], r[6]) for r in RULES if r[5]])
    found = known.where(medium | high).select(*by, issue.alias("issue"), category.alias("category"), F.when(high, 3).otherwise(2).alias("_rank"), F.struct("metric", "value").alias("e"))
    grouped = found.groupBy(*by, "issue", "category").agg(F.max("_rank").alias("_rank"), F.sort_array(F.collect_list("e")).alias("evidence"))
    severity = F.when(F.col("_rank") == 3, "high").otherwise("medium")
    return grouped.select(*by, "issue", "category", severity.alias("severity"), _map(PRIORITIES)[severity].alias("priority"), "evidence")


def overall(metrics: DataFrame, issues: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by`` and status: by the worst issue; without issues, by whether enough rows were evaluated (num_evaluated)."""
    rank = _map(RANKS)[F.col("severity")]
    worst = issues.groupBy(*by).agg(F.max(rank).alias("worst"))
    few = metrics.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("metric") == "num_evaluated", F.col("value") < FEW)), F.lit(False)).alias("few"))
    status = F.when(F.col("worst") == 4, "blocked").when(F.col("worst") == 3, "needs_attention").when(F.col("worst").isNotNull(), "watch").when(F.col("few"), "insufficient_evidence").otherwise("healthy")
    return few.join(worst, list(by), "left").select(*by, status.alias("status"))


def row_issues(success: Column, valid: Column, compiled: Column, deployable: Column, grounded: Column, runtime_checked: Column, runtime_match: Column, truncated: Column) -> Column:
    """The categories of a row: a flag that is null tells nothing, but for ``success``, which counts as true."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    pairs = [
        (no(success), "generation_failure"), (no(valid), "syntax_or_scaffold"), (no(compiled) | no(deployable), "compiler_or_deployability"), (no(grounded), "bytecode_grounding"),
        (yes(runtime_checked) & no(runtime_match), "runtime_mismatch"), (yes(truncated), "prompt_truncation"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def issue_summary(rows: DataFrame, issues: str, buckets: str) -> DataFrame:
    """(category, n): a category of ``issues`` counts once a row, a bucket of the map ``buckets`` as often as it has values."""
    once = rows.select(F.explode(F.array_distinct(issues)).alias("category"), F.lit(1).cast("long").alias("n"))
    each = rows.select(F.explode(buckets).alias("bucket", "values")).select(F.concat(F.lit("bytecode:"), "bucket").alias("category"), F.size("values").cast("long").alias("n"))
    return once.unionByName(each).groupBy("category").agg(F.sum("n").alias("n")).where("n > 0")


# The fact categories whose difference is a mismatch, and what an opcode group asks of the candidate.
MISMATCHES = {
    "selector_mismatch": ("abi", "visibility", "mutability", "modifier"), "event_mismatch": ("event",), "storage_write_mismatch": ("state_write",), "call_mismatch": ("call", "member_call"),
    "guard_mismatch": ("guard",), "return_mismatch": ("return",), "control_flow_mismatch": ("control_flow",),
}
ASKED_FACTS = {"storage": ("storage_write_mismatch", "state_write"), "event_log": ("event_mismatch", "event"), "revert": ("guard_mismatch", "guard")}
ASKED_WORDS = {"delegatecall": "call_mismatch", "create2": "call_mismatch"}


def mismatches(reference: Column, candidate: Column, opcodes: Column, code: Column, valid: Column, runtime_match: Column | None = None, failures: Column | None = None) -> Column:
    """The kinds of mismatch between two maps of facts by category, with what the byte code asks for."""
    of = lambda m, c: F.array_sort(F.array_distinct(F.coalesce(F.try_element_at(m, F.lit(c)), F.array().cast("array<string>"))))
    kinds = {name: F.lit(False) for name in MISMATCHES}
    for name, categories in MISMATCHES.items():
        for c in categories:
            kinds[name] = kinds[name] | (of(reference, c) != of(candidate, c))
    for group, (name, c) in ASKED_FACTS.items():
        kinds[name] = kinds[name] | (F.array_contains(opcodes, group) & (F.size(of(candidate, c)) == 0))
    for group, name in ASKED_WORDS.items():
        kinds[name] = kinds[name] | (F.array_contains(opcodes, group) & ~F.lower(code).contains(group))
    kinds["deployability_failure"] = ~valid
    if runtime_match is not None:
        kinds["runtime_bytecode_mismatch"] = F.coalesce(~runtime_match, F.lit(False))
    if failures is not None:
        kinds["differential_call_failure"] = F.size(failures) > 0
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]), lambda x: x.isNotNull())


def semantic_score(reference: Column, candidate: Column, kinds: Column, valid: Column, runtime_match: Column | None = None) -> Column:
    """Share of common facts, at most 0.5 if the runtime code differs and 0.25 if not valid, and a tenth less than 1 for each kind of mismatch, to 0.1."""
    flat = lambda m: F.array_distinct(F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("k"), v.alias("v"))))))
    a, b = flat(reference), flat(candidate)
    common = F.size(F.array_intersect(a, b))
    score = common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))
    if runtime_match is not None:
        score = F.when(F.coalesce(~runtime_match, F.lit(False)), F.least(score, F.lit(0.5))).otherwise(score)
    score = F.when(valid, score).otherwise(F.least(score, F.lit(0.25)))
    return F.when(F.size(kinds) > 0, F.least(score, 1.0 - F.least(F.lit(0.9), 0.1 * F.size(kinds)))).otherwise(score)


def evaluated(reference: Column, candidate: Column, numbers: dict[str, Column], flags: dict[str, Column], distance: str = "normalized_edit_distance", least: int = 5) -> Column:
    """The metrics of a pair as a struct; where either text has fewer than ``least`` characters, all are 0, the distance
    1, and all flags false, with the issue named."""
    short = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) < least
    bad = short(reference) | short(candidate)
    worst = lambda n: F.lit(1.0 if n == distance else 0.0)
    return F.struct(
        *[F.when(bad, worst(n)).otherwise(c.cast("double")).alias(n) for n, c in numbers.items()], *[(~bad & F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        F.when(bad, "malformed_input_output").alias("quality_issue"),
    )


SKIPPED = ("details", "detailed_results")  # fixed values: parts of a summary that hold no metrics


def flattened(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, metric and value of each number or boolean in nested structs, named by its path joined with ``_``; NaN and null go."""
    found: list[Column] = []

    def walk(kind: T.StructType, path: tuple[str, ...]) -> None:
        for f in kind.fields:
            here = (*path, f.name)
            if f.name in SKIPPED or (not path and f.name in keep):
                continue
            c = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            elif isinstance(f.dataType, T.BooleanType):
                found.append(F.struct(F.lit("_".join(here)).alias("metric"), c.cast("int").cast("double").alias("value")))
            elif isinstance(f.dataType, T.NumericType):
                found.append(F.struct(F.lit("_".join(here)).alias("metric"), c.cast("double").alias("value")))

    walk(df.schema, ())
    if not found:
        return df.select(*keep, F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)
    return df.select(*keep, F.explode(F.array(*found)).alias("m")).select(*keep, "m.metric", "m.value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def aliases(summary: DataFrame, by: tuple[str, ...] = (), parts: tuple[str, ...] = ("mean", "std", "median", "min", "max")) -> DataFrame:
    """(``by``, name, value): ``<metric>_<part>`` of each metric of a summary."""
    pairs = F.array(*[F.struct(F.concat("metric", F.lit(f"_{p}")).alias("name"), F.col(p).cast("double").alias("value")) for p in parts])
    return summary.select(*by, F.explode(pairs).alias("x")).select(*by, "x.name", "x.value")
