"""Validation and preflight of JSON rows that are made of the orders, so that SQL knows what is wrong with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import records, validation
from orrery.operators import preflight
from orrery.plans.base import query, t

# A row's shape is its priority and status; its input and output go by its customer. Both engines run these texts.
INPUT = """case o_custkey % 8 when 0 then concat('function f(uint a):', chr(92), 'n  v = 1') when 1 then '  ' when 2 then concat('block_1:', chr(92), 'n// note')
 when 3 then 'v = 1 // stack underflow' when 4 then concat('// Visibility: public', chr(92), 'nv = 2') when 5 then concat('goto unknown', chr(92), 'nunresolved jump') when 6 then 'error extracting tac' else concat('v = selector_', h) end"""
OUTPUT = "case o_custkey % 5 when 0 then '' when 1 then 'function f() { } // TODO: Full logic not reconstructed' when 2 then 'uint x = 1;' when 3 then 'modifier only() { _; }' else 'function g() public { }' end"
META = """case concat(substr(o_orderpriority, 1, 1), o_orderstatus)
 when '1F' then '"schema_version": 1' when '1O' then '"schema_version": 2' when '1P' then '"body_hash": ""'
 when '2F' then '"schema_version": 1, "contract_address": "0x12"' when '2O' then concat('"schema_version": 1, "contract_address": "0x', md5(h), h, '"') when '2P' then '"schema_version": "1", "contract_address": 12'
 when '3F' then concat('"schema_version": 1, "selector": "0x', h, '"') when '3O' then '"schema_version": 1, "selector": "zz", "function_selector": "0x12345678"' when '3P' then concat('"schema_version": 1, "function_selector": 7, "body_hash": "', md5(h), '", "source_code_hash": "xyz", "pair_norm_hash": null')
 when '4F' then '"schema_version": 1, "optimizer_enabled": true, "optimizer_runs": 200, "compiler_version": "0.8.17+commit"' when '4O' then '"schema_version": true, "optimizer_enabled": "true", "is_payable": 0, "optimizer_runs": -1, "compiler_version": "eight"'
 when '4P' then '"schema_version": null, "optimizer_enabled": null, "optimizer_runs": 2.5, "compiler_version": 7' else '"schema_version": 1' end"""
RAW = f"""case concat(substr(o_orderpriority, 1, 1), o_orderstatus) when '5F' then concat('{{"input": ', h) when '5O' then '[1, 2]' when '5P' then concat('{{"input": 5, "metadata": "', h, '"}}')
 else concat('{{"input": "', {INPUT}, '", "output": "', {OUTPUT}, '", "metadata": {{', {META}, '}}}}') end"""
HEAD = "substr(md5(concat('k', cast(o_orderkey as {0}))), 1, 8)"

# What SQL expects, by shape: codes of the metadata, and of the input and the output.
SHAPE = "concat(substr(o_orderpriority, 1, 1), o_orderstatus)"
META_CODES = f"""case {SHAPE} when '1O' then 'metadata.schema_version:schema_version_unsupported' when '1P' then 'metadata.schema_version:schema_version_missing'
 when '2F' then 'metadata.contract_address:contract_address_format' when '2P' then 'metadata.schema_version:schema_version_unsupported,metadata.contract_address:contract_address_format'
 when '3O' then 'metadata.selector:selector_format' when '3P' then 'metadata.selector:selector_format,metadata.source_code_hash:hash_format'
 when '4O' then 'metadata.optimizer_enabled:boolean_type_error,metadata.is_payable:boolean_type_error,metadata.compiler_version:compiler_version_format,metadata.optimizer_runs:optimizer_runs_type_error'
 when '4P' then 'metadata.schema_version:schema_version_missing,metadata.compiler_version:compiler_version_format,metadata.optimizer_runs:optimizer_runs_type_error' end"""
ROW_CODES = f"""case {SHAPE} when '5F' then '$:row_type_error' when '5O' then '$:row_type_error' when '5P' then 'input:input_required_string,output:output_required_string,metadata:metadata_type_error'
 else concat_ws(',', case when o_custkey % 8 = 1 then 'input:input_required_string' end, case when o_custkey % 5 = 0 then 'output:output_required_string' end, {META_CODES}) end"""
REASONS = f"""concat_ws(',', case when {SHAPE} in ('5F', '5O') then 'tac_empty' when {SHAPE} = '5P' then null else
 case o_custkey % 8 when 0 then 'prompt_source_signature_leak' when 1 then 'tac_empty' when 2 then 'tac_no_operations' when 3 then 'tac_stack_underflow' when 4 then 'prompt_source_metadata_leak' when 5 then 'tac_unresolved_jump' when 6 then 'tac_extraction_error' end end,
 case when {SHAPE} in ('5F', '5O', '5P') then 'output_empty' else case o_custkey % 5 when 0 then 'output_empty' when 1 then 'partial_placeholder' when 2 then 'output_missing_solidity_entrypoint' end end,
 case when {SHAPE} = '3F' and o_custkey % 8 <> 7 then 'selector_input_mismatch' end,
 case when length({ROW_CODES}) > 0 then 'metadata_schema_invalid' end)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("h", F.expr(HEAD.format("string")))
    return orders.select("o_orderkey", "o_orderstatus", F.expr(RAW.replace("chr(92)", "char(92)")).alias("value"))


def _written(errors):
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(":", e["field"], e["code"])), ",")


@query(f"select o_orderkey, {ROW_CODES} as errors from orders")
def row_validation(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("o_orderkey", _written(validation.row_errors(validation.parsed("value"))).alias("errors"))


@query(f"select o_orderkey, coalesce({META_CODES}, '') as errors from orders where substr(o_orderpriority, 1, 1) <> '5'")
def metadata_validation(spark: SparkSession, d: str) -> DataFrame:
    row = F.try_parse_json("value")
    rows = _rows(spark, d).where(F.coalesce(validation.kind(validation.part(row, "$.metadata")) == "object", F.lit(False)))
    return rows.select("o_orderkey", _written(validation.metadata_errors(validation.part(row, "$.metadata"))).alias("errors"))


@query(f"with r as (select o_orderkey, {REASONS} as reasons from orders) select o_orderkey, case when reasons = '' then 'passed' else 'failed' end as status, reasons from r")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("o_orderkey", validation.report("value").alias("r"))
    return rows.select("o_orderkey", "r.status", F.array_join("r.reasons", ",").alias("reasons"))


@query(f"with r as (select unnest(string_split({REASONS}, ',')) as reason from orders) select reason, count(*) as n from r where reason <> '' group by 1")
def quality_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select(F.explode(validation.report("value")["reasons"]).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


MOST = 4
# Words of inputs and outputs that are valid, and the codes of a line.
WORDS_IN = "case o_custkey % 8 when 0 then 6 when 2 then 3 when 3 then 6 when 4 then 6 when 5 then 4 when 6 then 3 else 3 end"
WORDS_OUT = "case o_custkey % 5 when 1 then 10 when 2 then 4 when 3 then 5 else 5 end"
LINE_CODES = f"""case {SHAPE} when '5F' then ['json_parse_error'] when '5O' then ['row_type_error'] when '5P' then ['input_type_error', 'missing_output', 'metadata_type_error']
 else list_filter(list_concat([case when o_custkey % 8 = 1 then 'empty_input' end, case when o_custkey % 5 = 0 then 'empty_output' end], list_transform(string_split(coalesce({META_CODES}, ''), ','), lambda x: nullif(split_part(x, ':', 2), ''))), lambda x: x is not null) end"""
LINES = f"""l as (select o_orderkey + 1 as line, o_orderstatus, {LINE_CODES} as codes, cast({WORDS_IN} as bigint) as context, cast({WORDS_OUT} as bigint) as target from orders),
v as (select *, len(codes) = 0 as valid from l),
c as (select line, o_orderstatus, valid, context, target, list_concat(codes, list_filter([case when valid and target >= {MOST} then 'target_overlength' end, case when valid and context + target > {MOST} then 'context_overlength' end], lambda x: x is not null)) as codes from v)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select((F.col("o_orderkey") + 1).alias("line"), "o_orderstatus", "value")


@query(f"with {LINES} select code, count(*) as n from (select unnest(codes) as code from c) group by 1")
def preflight_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return preflight.error_counts(preflight.checked(_lines(spark, d), MOST))


@query(f"with {LINES}, e as (select line, unnest(codes) as code, generate_subscripts(codes, 1) as pos from c) select line, code from e order by line, pos limit 50")
def preflight_first_errors(spark: SparkSession, d: str) -> DataFrame:
    return preflight.first_errors(preflight.checked(_lines(spark, d), MOST)).select("line", "code")


SUMMARY = f"""case when sum(len(codes)) > 0 then 'failed' else 'passed' end as status, count(*) as row_count, cast(sum(case when valid then 1 else 0 end) as bigint) as valid_row_count, cast(0 as bigint) as blank_line_count,
  coalesce(max(case when valid then context end), 0) as max_context_tokens, coalesce(max(case when valid then target end), 0) as max_target_tokens, coalesce(max(case when valid then context + target end), 0) as max_total_tokens,
  cast(sum(case when valid and target >= {MOST} then 1 else 0 end) as bigint) as target_overlength_count, cast(sum(case when valid and context + target > {MOST} then 1 else 0 end) as bigint) as context_overlength_count from c"""


@query(f"with {LINES} select {SUMMARY}")
def preflight_summary(spark: SparkSession, d: str) -> DataFrame:
    return preflight.summary(preflight.checked(_lines(spark, d), MOST), MOST)


@query(f"with {LINES} select o_orderstatus as dataset, {SUMMARY} group by 1")
def preflight_datasets(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    return preflight.over_datasets({s: rows.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}, MOST)


# A prompt of each order: comments on the source, a layout, a header that quotes it, and notes behind lines.
PROMPT = ["concat('function ', case o_custkey % 4 when 0 then 'transfer(address)' when 1 then concat('selector_', h) when 2 then 'fallback()' else 'bytecode_7' end, ':')",
          "case o_custkey % 3 when 0 then concat('  // Function selector: 0x', h) when 1 then '  // Visibility: public' else '  // plain note' end", "'// Storage layout:'", "'// slot 0: owner'", "''", "'// [slot 3] x'",
          "concat('  s = v', o_custkey, '  // likely: owner')", "'// Storage variables stay'", "'function approve(x):'", "'// 12: y'", "''", "'STOP'"]
CLEAN = ["concat('function ', case when o_custkey % 3 = 0 then concat('selector_', h) when o_custkey % 4 = 1 then concat('selector_', h) when o_custkey % 4 = 2 then 'fallback()' when o_custkey % 4 = 3 then 'bytecode_7' else 'bytecode_function' end, ':')",
         "case o_custkey % 3 when 0 then concat('  // Function selector: 0x', h) when 2 then '  // plain note' end", "concat('  s = v', o_custkey)", "'// Storage variables stay'", "'function bytecode_function:'", "''", "'STOP'"]


@query(f"""with p as (select o_orderkey, o_custkey, {HEAD.format('varchar')} as h from orders) select o_orderkey, md5(concat_ws(chr(10), {', '.join(CLEAN)})) as clean from p""")
def prompt_sanitised(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(HEAD.format("string")).alias("h"))
    prompt = F.concat_ws("\n", *map(F.expr, PROMPT))
    return rows.select("o_orderkey", F.md5(records.sanitized(prompt)).alias("clean"))
