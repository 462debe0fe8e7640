"""Byte code and source queries over fixed contracts, and those on tables that SQL can check."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scores, solidity
from orrery.operators import evm, features
from orrery.plans.base import query, t

# Fixed inputs.
CODES = (
    ("minimal", "0x600000"), ("selfdestruct", "0x6000ff"), ("timestamp", "0x4200"), ("unchecked_add", "0x600160020100"), ("subtract", "0x600560020300"),
    ("truncated", "0x6080604052600080fd5b56"), ("push0_create2", "0x5ff5"), ("invalid", "0xfe"), ("sstore", "0x6001600055"),
    ("dispatcher", "0x60003560e01c8063893d20e814601c578063a6f9dae114602057600080fd5b3360005500" "5b60015460005260206000f3"), ("empty", ""),
)
SOURCES = (
    ("transfer", "function transfer(address to, uint amount) public returns (bool) { require(to != address(0)); balances[msg.sender] -= amount; balances[to] += amount; emit Transfer(msg.sender, to, amount); return true; }"),
    ("owner", "contract A { address owner; /* none */ function owner_() external view returns (address) { return owner; } // end\n function set(address a) public { owner = a; } }"),
)


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES), "contract string, code string")


@query()
def evm_disassemble(spark: SparkSession, d: str) -> DataFrame:
    return evm.instructions(_codes(spark), "contract", "code")


@query()
def evm_blocks(spark: SparkSession, d: str) -> DataFrame:
    return evm.blocks(_codes(spark), "contract", "code").drop("tac")


@query()
def evm_tac(spark: SparkSession, d: str) -> DataFrame:
    return evm.blocks(_codes(spark), "contract", "code").select("contract", "block", F.posexplode("tac").alias("line", "text"))


@query()
def evm_functions(spark: SparkSession, d: str) -> DataFrame:
    return evm.functions(_codes(spark), "contract", "code")


@query()
def evm_fragments(spark: SparkSession, d: str) -> DataFrame:
    return evm.fragments(evm.blocks(_codes(spark), "contract", "code"), "contract")


@query()
def evm_findings(spark: SparkSession, d: str) -> DataFrame:
    codes = _codes(spark)
    return evm.findings(evm.fragments(evm.blocks(codes, "contract", "code"), "contract"), codes, "contract")


@query()
def evm_semantic_plan(spark: SparkSession, d: str) -> DataFrame:
    return evm.semantic_plan(evm.blocks(_codes(spark), "contract", "code"), "contract")


@query()
def opcode_coverage(spark: SparkSession, d: str) -> DataFrame:
    ops = evm.instructions(_codes(spark), "contract", "code").groupBy("contract").agg(F.sort_array(F.collect_list(F.struct("idx", "op"))).alias("o")).select("contract", F.transform("o", lambda x: x["op"]).alias("ops"))
    return ops.select("contract", evm.opcode_groups(F.col("ops")).alias("groups"), evm.control_flow(F.col("ops")).alias("control_flow"))


@query()
def malicious_heuristic(spark: SparkSession, d: str) -> DataFrame:
    counts = evm.opcode_frequencies(evm.instructions(_codes(spark), "contract", "code"), "contract")
    return features.heuristic_score(counts, "contract", "op", "n")


def _map(df: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame([row for x in batch[columns].itertuples(index=False) for row in f(*x)], columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(*columns).mapInPandas(run, schema)


@query()
def solidity_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(SOURCES), "name string, source string")
    return _map(rows, ["name", "source"], lambda n, s: [(n, k, v) for k, vs in solidity.facts(s).items() for v in vs], "name string, category string, value string")


@query()
def solidity_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(SOURCES), "name string, source string")
    pick = ("name", "contract", "signature", "visibility", "is_payable", "is_view")
    return _map(rows, ["name", "source"], lambda n, s: [(n, *[f[k] for k in pick]) for f in solidity.functions(s)], "source_name string, name string, contract string, signature string, visibility string, is_payable boolean, is_view boolean")


@query()
def version_pragma_match(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("^0.8.0",), (">=0.4.22 <0.6.0",), ("~0.5.3 || 0.7.6",), ("!=0.8.1",)], "pragma string")
    versions = ("0.4.25", "0.5.3", "0.5.17", "0.7.6", "0.8.1", "0.8.20")
    return _map(rows, ["pragma"], lambda p: [(p, v, solidity.satisfies(v, p)) for v in versions], "pragma string, version string, matches boolean")


@query()
def translation_scores(spark: SparkSession, d: str) -> DataFrame:
    from orrery.plans.signals import _turns

    both = _turns(spark, d).select("conv_id", "turn", "ua", "va")
    return _map(both, ["conv_id", "turn", "ua", "va"], lambda c, n, a, b: [(c, n, scores.bleu(a, b), scores.rouge_l(a, b))], "conv_id long, turn long, bleu double, rouge_l double")


@query("select doc_id, md5(text) || sha256(text) as code, substr(md5(text) || sha256(text), 1, 40) as head from documents")
def bytecode_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = t(spark, d, "documents").select("doc_id", F.concat(F.lit(" 0x"), F.upper(F.concat(F.md5("text"), F.sha2("text", 256))), F.lit("a165627a7a7230aabb")).alias("c"))
    out = raw.select("doc_id", evm.normalize_bytecode("c").alias("code"))
    return out.withColumn("head", F.substring("code", 1, 40))


@query("""with o as (select event_id, (['PUSH', 'DUP', 'SWAP', 'LOG', 'ADD'])[user_id % 5 + 1] as base, event_id % 40 as n from events)
select case when (base = 'PUSH' and n <= 32) or (base in ('DUP', 'SWAP') and n between 1 and 16) or (base = 'LOG' and n <= 4) then base else concat(base, n) end as op, count(*) as n from o group by 1""")
def opcode_normalize(spark: SparkSession, d: str) -> DataFrame:
    base = F.element_at(F.array(*map(F.lit, ("PUSH", "DUP", "SWAP", "LOG", "ADD"))), (F.col("user_id") % 5 + 1).cast("int"))
    op = features.normalize_opcode(F.concat(base, (F.col("event_id") % 40).cast("string")))
    return t(spark, d, "events").groupBy(op.alias("op")).agg(F.count(F.lit(1)).alias("n"))
