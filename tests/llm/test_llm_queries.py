import corpus_pipeline
from orrery.llm import registry


def test_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_keeps_columns_and_packs(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d)
        assert docs.columns == before.columns and docs.schema == before.schema, name
        docs = docs.cache()
        assert 0 < docs.count() <= n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_drops_near_copies_from_a_similarity_of_80_percent(spark):
    import random

    pick = random.Random(11)
    base = [[f"t{pick.randrange(4000)}" for _ in range(120)] for _ in range(20)]
    rows = []
    for i in range(100):
        w = list(base[i % 20])
        at = pick.randrange(10)
        for k in range(pick.randrange(4)):  # 5 of 116 shingles each
            w[at + 30 * k] = f"x{pick.randrange(9999)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}

    def least(percent):
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in sets:
            for j in sets:
                if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return {i for i in sets if find(i) == i}

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == least(80) and len(got) < len(least(85))
