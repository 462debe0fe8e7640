import json
import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import evm as E
from orrery.functions import hashing, quality, scores, solidity, text
from orrery.operators import compare, dedup, evm, features, leakage, lookup, risk, stats
from orrery.sources import files
from orrery.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, text.normalize_body("c"), c="A  /* x */ b // y\n C") == "a b c"
    assert one(spark, text.collapse_whitespace("c"), c="  a \n b ") == "a b"
    assert one(spark, text.line_count("c"), c="a\r\nb\n") == 2
    assert one(spark, text.line_count("c"), c="") == 0
    assert one(spark, text.token_estimate("c"), c=None) == 0
    assert one(spark, hashing.body_hash("c"), c="A") == "0cc175b9c0f1b6a831c399e269772661"
    assert one(spark, text.instruction_lines("c"), c="function a:\n block_1:\n // x\n y = 1\n") == 1


def test_row_hash_is_of_compact_json(spark):
    import hashlib

    want = hashlib.sha256(json.dumps({"input": 'a"b', "output": "é/"}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, hashing.row_hash("a", "b"), a='a"b', b="é/") == want


def test_quality(spark):
    assert one(spark, quality.is_trivial("c"), c="{ return x; }")
    assert not one(spark, quality.is_trivial("c"), c="{ a = b + c; require(a > 0); d[a] = b; emit E(a, b); }")
    assert one(spark, quality.tac_reasons("c"), c=" ") == ["tac_empty"]
    assert one(spark, quality.tac_reasons("c"), c="x = stack_underflow\n goto unknown") == ["tac_stack_underflow", "tac_unresolved_jump"]
    assert one(spark, quality.completion_reasons("c"), c="contract A {}") == ["output_missing_solidity_entrypoint"]
    assert one(spark, quality.bytecode_errors("c"), c="0x0g1") == ["non_hex", "odd_length"]
    assert one(spark, quality.length_report("a", "b", 2), a="x", b="y z").reasons == ["target_overlength", "context_overlength"]


def test_dedup_is_independent_of_order_and_partitions(spark):
    rows = [(1, "p1", "b"), (2, "p1", "b"), (3, "p2", "b"), (4, "p3", "b"), (5, None, None)]
    want = None
    for order, parts in ((rows, 1), (rows[::-1], 4)):
        df = spark.createDataFrame(order, "id long, p string, b string").repartition(parts)
        got = sorted(r["id"] for r in dedup.pair_dedup(df, F.col("p"), F.col("b"), "id", cap=2).collect())
        want = want or got
        assert got == want == [1, 3, 5]


def test_rejected_rows_seed_no_duplicates(spark):
    df = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True)], "pos long, k string, ok boolean")
    got = dedup.first_accepted_duplicates(df, F.col("k"), F.col("ok"), "pos").orderBy("pos").collect()
    assert [r["is_duplicate"] for r in got] == [False, False, True]


def test_ingest_content_counts_before_address(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (3, "y", "b")], "pos long, c string, a string")
    assert [r["pos"] for r in dedup.ingest_first_wins(df, F.col("c"), F.col("a"), "pos").collect()] == [1]


def test_cascade_counts_add_up(spark):
    df = spark.createDataFrame([(i, "s" * (i % 4), "t") for i in range(20)], "id long, a string, b string")
    tagged = dedup.cascade(df, [("empty", F.col("a") == "")], ("dup", [F.col("a")]), [("sss", F.col("a") == "sss")], "id")
    drops = {r["rule"]: r["rows_dropped"] for r in dedup.drop_counts(tagged).collect()}
    assert drops == {"empty": 5, "dup": 12, "sss": 1} and tagged.where("rule is null").count() == 2


def test_summary_and_components(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    r = stats.metric_summary(df, ["v"]).first()
    assert (r["mean"], r["std"], r["count"]) == (2.0, 1.0, 2) and math.isclose(r["ci_high"] - 2, 1.959963984540054)
    keys = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (2, "k", "b"), (3, "k", "b"), (4, "k", "c")], "id long, category string, key string")
    assert sorted(map(tuple, leakage.components(keys, "id", spark).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert leakage.simple_split_counts(10, 0.85, 0.1) == (8, 1, 1)


def test_stratified_split_keeps_components_and_fills_all(spark):
    parts = spark.createDataFrame([(i, i // 2) for i in range(60)], "id long, component long")
    strata = parts.select("id", F.lit("f").alias("field"), (F.col("id") % 3).cast("string").alias("value"))
    got = parts.join(leakage.stratified_split(parts, strata, "id", 0.6, 0.2), "component")
    assert got.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert got.select("split").distinct().count() == 3


def test_stratified_split_keeps_the_shares(spark):
    ids = [(i, i if i >= 400 else i // 8) for i in range(3000)]
    parts = spark.createDataFrame(ids, "id long, component long")
    strata = parts.select("id", F.lit("f").alias("field"), (F.col("component") % 3).cast("string").alias("value"))
    got = {r["component"]: r["split"] for r in leakage.stratified_split(parts, strata, "id", 0.6, 0.25).collect()}
    assert set(got) == {c for _, c in ids}
    for value in range(3):
        rows = [got[c] for _, c in ids if c % 3 == value]
        for split, share in (("train", 0.6), ("val", 0.25), ("test", 0.15)):
            assert abs(rows.count(split) / len(rows) - share) < 0.02


def test_stratified_split_fills_empty_splits(spark):
    parts = spark.createDataFrame([(i, 0 if i < 90 else i) for i in range(93)], "id long, component long")
    strata = parts.select("id", F.lit("f").alias("field"), F.lit("v").alias("value"))
    got = {r["component"]: r["split"] for r in leakage.stratified_split(parts, strata, "id", 0.02, 0.01).collect()}
    assert len(got) == 4 and set(got.values()) == {"train", "val", "test"}
    few = parts.where("component in (0, 90)")
    assert {r["split"] for r in leakage.stratified_split(few, strata, "id", 0.02, 0.01).collect()} == {"train"}


def test_features(spark):
    rows = [(d, t, n) for d, c in enumerate(({"PUSH": 10, "ADD": 5}, {"PUSH": 20, "SUB": 3}, {"PUSH": 15, "MUL": 2})) for t, n in c.items()]
    idf = {r["op"]: r["idf"] for r in features.idf(spark.createDataFrame(rows, "d long, op string, n long"), "d", "op").collect()}
    assert math.isclose(idf["PUSH"], 1.0) and math.isclose(idf["ADD"], 1.6931471805599454)
    bad = {"PUSH": 30, "SELFDESTRUCT": 1, "DELEGATECALL": 3, "CALL": 15, "CALLCODE": 2, "CREATE": 5, "SSTORE": 1, "STOP": 1}
    good = {"PUSH": 50, "DUP": 20, "SWAP": 15, "ADD": 5, "SLOAD": 3, "SSTORE": 2, "JUMP": 10, "JUMPI": 8, "STOP": 1, "REVERT": 4, "RETURN": 2}
    df = spark.createDataFrame([(k, t, n) for k, c in (("bad", bad), ("good", good)) for t, n in c.items()], "d string, op string, n long")
    got = {r["d"]: (r["flagged"], round(r["confidence"], 6)) for r in features.heuristic_score(df, "d", "op", "n").collect()}
    assert got == {"bad": (True, 0.95), "good": (False, 1.0)}


def test_risk_of_a_sure_critical_finding(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.7), ("b", 0.4, 0.5, 0.3)], "id string, w double, c double, f double")
    got = {r["id"]: r["risk"] for r in risk.noisy_or(df, "id", F.col("w"), F.col("c"), F.col("f")).collect()}
    assert got["a"] == 1.0 and math.isclose(got["b"], 0.3)


@pytest.mark.parametrize(("byte", "sign"), [("03", "-"), ("04", "/"), ("10", "<"), ("11", ">"), ("1b", "<<"), ("1c", ">>")])
def test_operand_order(byte, sign):
    ops = E.disassemble(f"0x60056002{byte}00")
    assert f"temp_3 = temp_1 {sign} temp_2" in E.three_address(E.blocks(ops), 0, ops)[0]


def test_bytecode(spark):
    assert [o.name for o in E.disassemble("0x600000")] == ["PUSH1", "STOP"]
    assert [o.name for o in E.disassemble("0x6080604052600080fd5b56")][-1] == "JUMP"
    assert E.selector("transfer(address,uint256)") == "0xa9059cbb"
    df = spark.createDataFrame([("s", "0x6000ff"), ("t", "0x4200"), ("a", "0x600160020100"), ("n", None)], "id string, code string")
    found = {(r["id"], r["kind"]) for r in evm.fragments(evm.blocks(df, "id", "code"), "id").collect()}
    assert found == {("s", "selfdestruct"), ("s", "access_control"), ("t", "timestamp_dependency"), ("a", "integer_overflow")}


def test_solidity():
    f = solidity.facts("function transfer(address to, uint amount) public returns (bool) { require(to != address(0)); balances[msg.sender] -= amount; balances[to] += amount; emit Transfer(msg.sender, to, amount); return true; }")
    assert "param_type:1:uint256" in f["abi"] and "require:param_0!=address(0)" in f["guard"] and "transfer" in f["event"]
    assert f["state_write"] == ["balances[msg.sender]", "balances[param_0]"]
    assert solidity.satisfies("0.8.4", "^0.8.0") and not solidity.satisfies("0.9.0", "^0.8.0") and solidity.satisfies("0.4.25", ">=0.4.22 <0.6.0 || 0.7.6")
    assert solidity.without_comments('a = "// no"; // yes').rstrip() == 'a = "// no";'
    assert solidity.scaffold("contract A { }") == [] and solidity.scaffold("contract A {") == ["unbalanced"]


def test_scores():
    assert scores.rouge_l("a b c", "a c") == pytest.approx(0.8)
    assert scores.bleu("a b c d e", "a b c d e") == pytest.approx(1.0)
    assert scores.truncated("a b\n// c\n", 2)[1] == "strip_comments"
    assert scores.masked([1, 2, 3], [4, 5], 4) == ([1, 2, 4, 5], [-100, -100, 4, 5])


def test_decisions_and_lookup(spark):
    d = spark.createDataFrame([("keep_candidate",), ("reject",)], "decision string")
    assert compare.suite_decision(d).first()["decision"] == "reject"
    left = spark.createDataFrame([(1, "a")], "k long, pos string")
    assert lookup.match_last(left, spark.createDataFrame([(1, 5), (1, 7)], "k long, v long"), "k", "pos", "v").first()["v"] == 7


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"input":"a","output":"b"}\n\n{bad\n')
    rows = files.read_json_lines(spark, str(tmp_path / "in.jsonl")).cache()
    assert rows.where("corrupt is null").count() == 1 and files.count_json_lines(spark, str(tmp_path / "in.jsonl")) == 2
    for kind in ("json", "csv", "parquet"):
        assert files.write_dataset(rows.drop("corrupt"), str(tmp_path / kind), F.col("input").isNotNull(), kind)["accepted"] == 1
    files.write_manifest(spark, str(tmp_path / "m"), rows=1)
    assert files.reusable(spark, str(tmp_path / "m"), rows=1) and not files.reusable(spark, str(tmp_path / "none"), rows=1)
    spark.createDataFrame([("2024-01-01 00:00:00", "x"), ("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "y")], "ts string, v string").selectExpr("cast(ts as timestamp) ts", "v").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, v string").parquet(str(tmp_path / "ev"))
    ingest.run_available(ingest.first_seen(stream, F.col("v"), "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_row_evaluation_of_odd_turns_agrees_with_sql(spark, tmp_path):
    import duckdb

    from orrery import plans

    texts = ["To my mind  it is so", "my To so it is", "\t\t \n\t\f\t", "a\u00a0b\u2003c d e", "one\x0btwo three", "abc", "", None, " ".join(f"w{i}é" for i in range(300)), "w0é then others"]
    turns = [(i * 100 + j, k, role, x) for i, a in enumerate(texts) for j, b in enumerate(texts) for k, role, x in ((1, "user", a), (2, "assistant", b))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["row_evaluation"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.execute(plans.SQL["row_evaluation"])
    assert got.columns == [x[0] for x in want.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("n", [1, 13, 14, 60, 3000])
def test_order_of_distinct_entries(n):
    import duckdb

    from orrery.functions import tables

    entries = [f"{'é' * (i % 3)}w{i * i % (n + 7)}" + "x" * (i % 23) for i in range(n)]
    assert tables.distinct(entries) == list(duckdb.execute("select list_distinct(?)", [entries]).fetchone()[0])
