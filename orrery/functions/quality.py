"""Predicates on training rows: each gives a flag or an array of reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.text import collapse_whitespace, instruction_lines, lines, normalize_body, text, token_estimate

# Bodies that teach nothing.
TRIVIAL = (
    r"^\s*\{\s*return\s+\w+\s*;\s*\}\s*$",
    r"^\s*\{\s*return\s+\d+\s*;\s*\}\s*$",
    r"^\s*\{\s*\}\s*$",
    r"^\s*\{\s*return\s+\w+(\.\w+)*\s*;\s*\}\s*$",
    r"^\s*\{\s*\w+\s*=\s*\w+\s*;\s*\}\s*$",
    r"^\s*\{\s*emit\s+\w+\([^)]*\)\s*;\s*\}\s*$",
    r"^\s*\{\s*return\s+(true|false)\s*;\s*\}\s*$",
    r"^\s*\{\s*return\s+\w+\([^)]*\)\s*;\s*\}\s*$",
    r"^\s*\{\s*_\s*;\s*\}\s*$",
)
LEXICAL_TOKEN = r"[A-Za-z_]\w*|[0-9]+|[^\s\w]"
# Marks of failed analysis in three-address code, and the reason each gives.
TAC_MARKS = (
    ("tac_stack_underflow", r"(?i)\bstack[_\s-]*underflow\b"),
    ("tac_extraction_error", r"(?i)\berror\s+extracting\s+tac\b"),
    ("tac_analysis_error", r"(?i)\btac\s+(?:analysis|extraction)\s+(?:failed|error)\b"),
    ("tac_unresolved_jump", r"(?i)\b(?:goto|jump)\s+(?:unresolved|unknown|error)\b"),
    ("tac_unresolved_jump", r"(?i)\bunresolved[_\s-]*(?:jump|goto|target)\b"),
)
# Comments and headers in a prompt that quote the source, and what a completion must hold.
SOURCE_COMMENT = (
    r"(?im)^\s*(?://\s*)?(?:(?:Solidity\s+compiler|Compiler|Optimizer|Visibility|Payable|View/Pure|State\s+mutability|Storage\s+layout|"
    r"Function\s+signature|ABI|Source|Contract\s+name|Returns?|Parameters?|Inputs?)\s*:|Function\s*:(?!\s*selector\b)|param\[[^\]]+\]\b)"
)
SOURCE_HEADER = (
    r"(?i)^\s*function\s+(?!selector_[0-9a-fA-F]{8}\b|function_0x[0-9a-fA-F]{8}\b|bytecode(?:_[A-Za-z0-9_]+)?\b|"
    r"fallback(?:_function)?\b|receive\b|internal_[A-Za-z0-9_]+\b)[A-Za-z_$][A-Za-z0-9_$]*\s*\([^)]*\)\s*:\s*$"
)
ENTRY_POINT = r"\b(?:function\s+[A-Za-z_$][A-Za-z0-9_$]*\s*\(|constructor\s*\(|fallback\s*\(|receive\s*\(|modifier\s+[A-Za-z_$][A-Za-z0-9_$]*\s*\()"
PARTIAL_MARKS = ("Partial decompilation", "TODO: Full logic not reconstructed")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def is_trivial(body: Column | str, least_tokens: int = 15, patterns: tuple[str, ...] = TRIVIAL) -> Column:
    t, hit = text(body), F.lit(False)
    for p in patterns:
        hit = hit | t.rlike(f"(?s){p}")
    return hit | (F.regexp_count(t, F.lit(LEXICAL_TOKEN)) < least_tokens)


def is_proxy_only(body: Column | str, mark: str = "delegatecall", most: int = 3) -> Column:
    statements = F.filter(F.split(normalize_body(body), ";"), lambda s: F.trim(s) != "")
    return text(body).rlike(rf"\b{mark}\b") & (F.size(statements) <= most)


def is_partial(code: Column | str, name: Column | str | None = None, flag: Column | None = None, marks: tuple[str, ...] = PARTIAL_MARKS) -> Column:
    t, hit = text(code), F.lit(False)
    for m in marks:
        hit = hit | t.contains(m)
    hit = hit | t.rlike(r"\bfunction\s+unknown_[0-9A-Za-z_]*\s*\(")
    if name is not None:
        hit = hit | text(name).startswith("unknown_")
    return hit | F.coalesce(flag, F.lit(False)) if flag is not None else hit


def tac_reasons(tac: Column | str, marks: tuple[tuple[str, str], ...] = TAC_MARKS) -> Column:
    t = text(tac)
    blank = collapse_whitespace(t) == ""
    return F.array_distinct(reasons((blank, "tac_empty"), *[(t.rlike(p), n) for n, p in marks], (~blank & (instruction_lines(t) == 0), "tac_no_operations")))


def leakage_reasons(prompt: Column | str) -> Column:
    """Comments or headers that quote the source; a header stands on one line."""
    t = text(prompt)
    return reasons((t.rlike(SOURCE_COMMENT), "prompt_source_metadata_leak"), (F.exists(lines(t), lambda x: x.rlike(SOURCE_HEADER)), "prompt_source_signature_leak"))


def completion_reasons(output: Column | str, entry: str = ENTRY_POINT) -> Column:
    t = collapse_whitespace(output)
    empty = t == ""
    return reasons((empty, "output_empty"), (~empty & is_partial(output), "partial_placeholder"), (~empty & ~text(output).rlike(entry), "output_missing_solidity_entrypoint"))


def selector_name(selector: Column | str) -> Column:
    """``selector_`` and the eight hexadecimal digits of a selector, whatever else is in it; null without just eight."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(selector))), "^0x", ""), "[^0-9a-f]", "")
    return F.when(F.length(digits) == 8, F.concat(F.lit("selector_"), digits))


def alignment_reasons(prompt: Column | str, selector: Column | str) -> Column:
    """The prompt must hold the selector as it is written, or the name made of it."""
    s, name, t = F.lower(F.trim(text(selector))), selector_name(selector), F.lower(text(prompt))
    return reasons((name.isNotNull() & ~t.contains(s) & ~t.contains(name), "selector_input_mismatch"))


def canonical_contract(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(F.trim(text(name)), ":"), -1), "[^A-Za-z0-9_]", ""))


def auxiliary_reasons(target: Column | str, compiled: Column | str) -> Column:
    a, b = canonical_contract(target), canonical_contract(compiled)
    return reasons(((text(target) != "") & (text(compiled) != "") & ~((a != "") & (a == b)), "auxiliary_compiled_contract"))


def length_report(prompt: Column | str, output: Column | str, most: int) -> Column:
    """Estimates and the reasons to reject: a target as long as allowed, a total beyond it."""
    context, target = token_estimate(prompt), token_estimate(output)
    total = context + target
    return F.struct(
        context.alias("context_tokens"), target.alias("target_tokens"), total.alias("total_tokens"),
        reasons((target >= most, "target_overlength"), (total > most, "context_overlength")).alias("reasons"),
    )


def bytecode_errors(hex_: Column | str) -> Column:
    """Empty code is valid."""
    t = F.regexp_replace(F.trim(text(hex_)), "^0[xX]", "")
    return reasons(((t != "") & ~t.rlike("^[0-9a-fA-F]*$"), "non_hex"), (F.length(t) % 2 == 1, "odd_length"))
