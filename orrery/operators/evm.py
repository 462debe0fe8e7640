"""Contracts as rows: instructions, blocks with their graph facts, functions, fragments and findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import evm
from orrery.operators import risk
from orrery.operators.features import normalize_opcode


def normalize_bytecode(c: Column | str) -> Column:
    """Hex digits in lower case, without prefix and without what follows the first metadata mark that occurs."""
    t = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(t, "^0x", ""), "[^0-9a-f]", "")
    cutted = out
    for mark in reversed(evm.METADATA):
        at = F.instr(out, mark)
        cutted = F.when(at > 1, F.substring(out, F.lit(1), at - 1)).otherwise(cutted)
    return cutted


def instructions(df: DataFrame, id_: str, code: str) -> DataFrame:
    """(id, idx, pc, op, operand). Null and empty code give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, o.pc, o.name, o.operand) for i, c in zip(batch[id_], batch[code]) for k, o in enumerate(evm.disassemble(c))]
            yield pd.DataFrame(rows, columns=[id_, "idx", "pc", "op", "operand"])

    return df.select(id_, code).mapInPandas(run, f"{id_} {dict(df.dtypes)[id_]}, idx int, pc int, op string, operand string")


def blocks(df: DataFrame, id_: str, code: str) -> DataFrame:
    """A row for each block: its operations, edges, dominators, stack height, and lines of three-address code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, c in zip(batch[id_], batch[code]):
                ops = evm.disassemble(c)
                if not ops:
                    continue
                graph, entry = evm.blocks(ops), ops[0].pc
                live, heads, dom = evm.reachable(graph, entry), evm.loop_heads(graph, entry), evm.dominators(graph, entry)
                heights, lines = evm.stack_heights(graph, entry), evm.three_address(graph, entry, ops)
                for s, b in sorted(graph.items()):
                    name = lambda xs: [graph[x].id for x in sorted(xs)]
                    rows.append((i, b.id, s, b.ops[-1].pc, [o.name for o in b.ops], name(b.successors), name(b.predecessors), name(dom[s]), heights[s], s in live, s in heads, lines[s]))
            yield pd.DataFrame(rows, columns=[id_, "block", "start", "end", "ops", "successors", "predecessors", "dominators", "height", "reachable", "loop_head", "tac"])

    kinds = "block string, start int, end int, ops array<string>, successors array<string>, predecessors array<string>, dominators array<string>, height int, reachable boolean, loop_head boolean, tac array<string>"
    return df.select(id_, code).mapInPandas(run, f"{id_} {dict(df.dtypes)[id_]}, {kinds}")


def edges(blocks_: DataFrame, id_: str) -> DataFrame:
    return blocks_.select(id_, F.col("block").alias("src"), F.explode("successors").alias("dst"))


def functions(df: DataFrame, id_: str, code: str) -> DataFrame:
    """(id, name, selector, entry, blocks, tac): those of the dispatcher, else one fallback."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, c in zip(batch[id_], batch[code]):
                ops = evm.disassemble(c)
                graph = evm.blocks(ops)
                lines = evm.three_address(graph, ops[0].pc, ops) if ops else {}
                for name, selector, entry in evm.functions(ops, graph):
                    own = sorted(evm.reachable(graph, entry))
                    body = "\n".join([f"function {name}:", *[x for s in own for x in (f"  {graph[s].id}:", *[f"    {y}" for y in lines[s]])]])
                    rows.append((i, name, selector, f"block_{entry:04x}", [graph[s].id for s in own], body))
            yield pd.DataFrame(rows, columns=[id_, "name", "selector", "entry", "blocks", "tac"])

    return df.select(id_, code).mapInPandas(run, f"{id_} {dict(df.dtypes)[id_]}, name string, selector string, entry string, blocks array<string>, tac string")


def fragments(blocks_: DataFrame, id_: str) -> DataFrame:
    """(id, block, kind): patterns of single blocks, with what their neighbours hold by one join over the edges."""
    has = lambda *n: F.arrays_overlap("ops", F.array(*map(F.lit, n)))
    links = edges(blocks_, id_)
    facts = blocks_.select(id_, "block", has("SSTORE").alias("stores"), (has("CALLER") & has("EQ")).alias("checks"))
    after = links.join(facts.withColumnRenamed("block", "dst"), [id_, "dst"]).groupBy(id_, F.col("src").alias("block")).agg(F.max("stores").alias("after_stores"))
    before = links.join(facts.withColumnRenamed("block", "src"), [id_, "src"]).groupBy(id_, F.col("dst").alias("block")).agg(F.max("checks").alias("before_checks"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    all_ = blocks_.join(after, [id_, "block"], "left").join(before, [id_, "block"], "left")
    kinds = {
        "reentrancy": has("CALL", "CALLCODE") & (has("SSTORE") | no("after_stores")),
        "selfdestruct": has("SELFDESTRUCT"),
        "timestamp_dependency": has("TIMESTAMP"),
        "integer_overflow": has("ADD", "SUB", "MUL", "DIV") & ~(has("LT", "GT", "EQ", "ISZERO") & has("JUMPI")),
        "delegatecall": has("DELEGATECALL"),
        "access_control": has("SELFDESTRUCT", "DELEGATECALL", "SSTORE") & ~no("before_checks") & ~has("CALLER"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return all_.select(id_, "block", F.explode(found).alias("kind"))


def findings(fragments_: DataFrame, contracts: DataFrame, id_: str) -> DataFrame:
    """A row for each contract and kind: fragments, detected, confidence and severity; six rows in any case."""
    grid = contracts.select(id_, F.explode(F.array(*map(F.lit, risk.SEVERITY))).alias("kind"))
    counts = fragments_.groupBy(id_, "kind").agg(F.count(F.lit(1)).alias("fragments"))
    rows = grid.join(counts, [id_, "kind"], "left").withColumn("fragments", F.coalesce("fragments", F.lit(0).cast("long")))
    n = F.col("fragments")
    return rows.withColumn("detected", n > 0).withColumn("confidence", F.when(n > 0, risk.fragment_confidence(n)).otherwise(0.0)).withColumn("severity", risk.fragment_severity(F.col("kind"), n))


def opcode_groups(ops: Column) -> Column:
    """The groups that an array of operations touches, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(F.arrays_overlap(ops, F.array(*map(F.lit, names.split()))), F.lit(g)) for g, names in evm.GROUPS]), lambda x: x.isNotNull()))


def control_flow(ops: Column) -> Column:
    count = lambda n: F.size(F.filter(ops, lambda o: o == n))
    jumps = count("JUMPI")
    parts = F.array(
        F.when(jumps > 0, "branching"), F.when(jumps >= 3, "deep_branching"), F.when((jumps == 0) & (F.size(ops) > 0), "straight_line"),
        F.when(count("JUMPDEST") >= 3, "multi_block"), F.when(F.arrays_overlap(ops, F.array(F.lit("REVERT"), F.lit("INVALID"))), "revert_path"),
    )
    return F.array_sort(F.filter(parts, lambda x: x.isNotNull()))


def opcode_frequencies(instructions_: DataFrame, id_: str) -> DataFrame:
    return instructions_.groupBy(id_, normalize_opcode(F.col("op")).alias("op")).agg(F.count(F.lit(1)).alias("n"))


def proxy_kind(code: Column, ops: Column) -> Column:
    """Minimal proxies by their fixed code, storage proxies by their slot, others by DELEGATECALL."""
    # Code of the minimal proxy and the slot of the implementation.
    minimal = code.rlike("^(0x)?363d3d373d3d3d363d73[0-9a-f]{40}5af43d82803e903d91602b57fd5bf3")
    slot = code.contains("360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc")
    return F.when(minimal, "eip1167").when(slot, "eip1967").when(F.array_contains(ops, "DELEGATECALL"), "delegatecall")


def semantic_plan(blocks_: DataFrame, id_: str) -> DataFrame:
    """Totals of each contract: blocks, edges, operations, lines, loops, dead blocks."""
    return blocks_.groupBy(id_).agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.size("successors")).alias("edges"), F.sum(F.size("ops")).alias("operations"), F.sum(F.size("tac")).alias("lines"),
        F.sum(F.col("loop_head").cast("int")).alias("loops"), F.sum((~F.col("reachable")).cast("int")).alias("dead_blocks"),
    )
