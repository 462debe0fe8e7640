"""Checks of training rows that are given as JSON text: what is wrong with which field, and why a row is rejected.

Rows are parsed once into a variant, whose types tell ``1`` from ``"1"`` and from ``true``. A row is an object with the
strings ``input`` and ``output`` and an object ``metadata``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import quality
from orrery.functions.text import instruction_lines, let, line_count, text, token_estimate

VERSION = 1
ERROR = "array<struct<field:string,code:string,message:string>>"
# Fields of the metadata, their formats, and the code and message of each error.
ADDRESS, SELECTOR = r"^0x[0-9a-fA-F]{40}$", r"^0x[0-9a-fA-F]{8}$"
HASH, COMPILER = r"^[0-9a-fA-F]{32}([0-9a-fA-F]{32})?$", r"^v?\d+\.\d+\.\d+(?:[+-].*)?$"
HASHES = ("source_hash", "source_code_hash", "body_hash", "input_hash", "output_hash", "pair_norm_hash", "tac_hash", "final_row_hash")
BOOLEANS = ("optimizer_enabled", "is_payable", "is_view")
MESSAGES = {
    "metadata_type_error": "metadata must be an object",
    "schema_version_missing": "metadata.schema_version is required for schema v1 rows",
    "schema_version_unsupported": "unsupported metadata schema version ",
    "contract_address_format": "contract_address must be a 20-byte 0x-prefixed hex string",
    "selector_format": "selector must be a 4-byte 0x-prefixed hex string",
    "hash_format": " must be a 32- or 64-byte lowercase/uppercase hex digest",
    "boolean_type_error": " must be a boolean when present",
    "compiler_version_format": "compiler_version must look like a Solidity semver string",
    "optimizer_runs_type_error": "optimizer_runs must be a non-negative integer when present",
    "row_type_error": "row must be an object",
    "required_string": " must be a non-empty string",
}


def parsed(raw: Column | str) -> Column:
    """The variant of a JSON text; null if it is none."""
    return F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw)


def part(row: Column, path: str) -> Column:
    """A part of a variant; null only if it is absent."""
    return F.try_variant_get(row, path, "variant")


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean, null; SQL null if absent."""
    name = lambda t: (
        F.when(t.isNull(), F.lit(None).cast("string")).when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
        .when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer").otherwise("number")
    )
    return let(F.schema_of_variant(v), name)


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _filled(v: Column) -> Column:
    """Neither absent, null nor empty."""
    return v.isNotNull() & (kind(v) != "null") & ~((kind(v) == "string") & (_string(v) == ""))


def _shaped(v: Column, pattern: str) -> Column:
    return (kind(v) == "string") & _string(v).rlike(pattern)


def _error(when: Column, field: str, code: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), said.alias("message")))


def _found(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull()).cast(ERROR)


def _selector(meta: Column) -> Column:
    """The selector, under its other name only where the first is absent."""
    return F.coalesce(part(meta, "$.selector"), part(meta, "$.function_selector"))


def _shown(v: Column) -> Column:
    """As the message writes a value: strings in quotes, True and False."""
    s = _string(v)
    return F.when(kind(v) == "string", F.concat(F.lit("'"), s, F.lit("'"))).when(kind(v) == "boolean", F.initcap(s)).otherwise(s)


def metadata_errors(meta: Column, allow_legacy: bool = False) -> Column:
    """What is wrong with a metadata variant, in the order of the fields; null counts as no object."""
    return let(meta, lambda m: _metadata_errors(m, allow_legacy))


def _metadata_errors(meta: Column, allow_legacy: bool) -> Column:
    named = lambda name, code: _error(_filled(part(meta, f"$.{name}")), f"metadata.{name}", code, f"{name}{MESSAGES[code]}")
    version, runs = part(meta, "$.schema_version"), part(meta, "$.optimizer_runs")
    there = version.isNotNull() & (kind(version) != "null")
    supported = kind(version).isin("integer", "number", "boolean") & (F.try_variant_get(version, "$", "double") == VERSION)
    address, selector, compiler = part(meta, "$.contract_address"), _selector(meta), part(meta, "$.compiler_version")
    errors = [
        _error(~there & F.lit(not allow_legacy), "metadata.schema_version", "schema_version_missing", MESSAGES["schema_version_missing"]),
        _error(there & ~F.coalesce(supported, F.lit(False)), "metadata.schema_version", "schema_version_unsupported", F.concat(F.lit(MESSAGES["schema_version_unsupported"]), _shown(version))),
        _error(_filled(address) & ~_shaped(address, ADDRESS), "metadata.contract_address", "contract_address_format", MESSAGES["contract_address_format"]),
        _error(_filled(selector) & ~_shaped(selector, SELECTOR), "metadata.selector", "selector_format", MESSAGES["selector_format"]),
    ]
    errors += [F.when(~_shaped(part(meta, f"$.{h}"), HASH), named(h, "hash_format")) for h in HASHES]
    errors += [F.when(kind(part(meta, f"$.{b}")) != "boolean", named(b, "boolean_type_error")) for b in BOOLEANS]
    errors += [
        _error(_filled(compiler) & ~_shaped(compiler, COMPILER), "metadata.compiler_version", "compiler_version_format", MESSAGES["compiler_version_format"]),
        _error(
            _filled(runs) & ~((kind(runs) == "integer") & (F.try_variant_get(runs, "$", "decimal(38,0)") >= 0)),
            "metadata.optimizer_runs", "optimizer_runs_type_error", MESSAGES["optimizer_runs_type_error"],
        ),
    ]
    no_object = _found(_error(F.lit(True), "metadata", "metadata_type_error", MESSAGES["metadata_type_error"]))
    return F.when(F.coalesce(kind(meta) == "object", F.lit(False)), _found(*errors)).otherwise(no_object)


def _empty_object() -> Column:
    return F.parse_json(F.lit("{}"))


def row_errors(row: Column, allow_legacy: bool = False) -> Column:
    """What is wrong with a row variant: its strings, then its metadata, which may be absent but not null."""
    return let(row, lambda r: _row_errors(r, allow_legacy))


def _row_errors(row: Column, allow_legacy: bool) -> Column:
    strings = [
        _error(~F.coalesce((kind(part(row, f"$.{f}")) == "string") & _string(part(row, f"$.{f}")).rlike(r"(?U)\S"), F.lit(False)), f, f"{f}_required_string", f"{f}{MESSAGES['required_string']}")
        for f in ("input", "output")
    ]
    meta = F.coalesce(part(row, "$.metadata"), _empty_object())
    no_object = _found(_error(F.lit(True), "$", "row_type_error", MESSAGES["row_type_error"]))
    return F.when(F.coalesce(kind(row) == "object", F.lit(False)), F.concat(_found(*strings), metadata_errors(meta, allow_legacy))).otherwise(no_object)


def reject_reasons(row: Column, validate_schema: bool = True, allow_legacy: bool = False) -> Column:
    """Why a row is rejected: by its input's analysis, by what the input quotes, by its output, by the selector, by its schema."""
    errors = F.size(row_errors(row, allow_legacy)) > 0 if validate_schema else F.lit(False)
    return let(_facets(row, errors), _reasons)


def _facets(row: Column, errors: Column) -> Column:
    meta = part(row, "$.metadata")  # an object, or one written as a string
    selector = let(meta, lambda m: _string(_selector(F.when(kind(m) == "string", F.try_parse_json(_string(m))).otherwise(m))))
    one = lambda path: text(_string(part(row, path)))
    return F.struct(one("$.input").alias("source"), one("$.output").alias("target"), selector.alias("selector"), errors.alias("wrong"))


def _reasons(x: Column) -> Column:
    source = x["source"]
    return F.concat(
        quality.tac_reasons(source), quality.leakage_reasons(source), quality.completion_reasons(x["target"]), quality.alignment_reasons(source, x["selector"]),
        quality.reasons((x["wrong"], "metadata_schema_invalid")),
    )


def report(raw: Column | str, validate_schema: bool = True, allow_legacy: bool = False) -> Column:
    """status, reasons, sizes and schema errors of a row of JSON text."""
    def written(row: Column) -> Column:
        errors = row_errors(row, allow_legacy)
        return let(F.struct(_facets(row, F.size(errors) > 0 if validate_schema else F.lit(False)).alias("x"), errors.alias("errors")), told)

    def told(y: Column) -> Column:
        source, target = y["x"]["source"], y["x"]["target"]
        return let(_reasons(y["x"]), lambda why: F.struct(
            F.when(F.size(why) > 0, "failed").otherwise("passed").alias("status"), why.alias("reasons"),
            F.length(source).cast("long").alias("input_chars"), F.length(target).cast("long").alias("output_chars"), line_count(source).alias("input_lines"), line_count(target).alias("output_lines"),
            token_estimate(source).alias("input_token_estimate"), token_estimate(target).alias("output_token_estimate"), instruction_lines(source).alias("tac_instruction_lines"),
            y["errors"].alias("schema_errors"),
        ))

    return let(parsed(raw), written)
