"""What the findings of round 3 asked for."""

from strandlake.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_broadcast_no_table_but_the_wanted_rows(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    texts = {1: base, 2: base[:-1] + ["x"], 3: base[1:] + ["y"], 4: base[:-1] + ["z"], 5: [f"v{k}" for k in range(60)], 6: base}
    docs = spark.createDataFrame([(k, " ".join(w), "en", "s", 0) for k, w in texts.items()], DOCS)
    plans, real = {}, minhash.stored

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name)

    monkeypatch.setattr(minhash, "stored", kept)
    out = minhash.near_duplicates(docs, size=4)
    plans["out"] = [out._jdf.queryExecution().sparkPlan().toString()]
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}
    joins = {name: sum(p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin") for p in found) for name, found in plans.items()}
    assert {name for name, n in joins.items() if n} <= {"sets"}
    assert sum(p.count("SortMergeJoin") for p in plans["labels"]) >= 4
