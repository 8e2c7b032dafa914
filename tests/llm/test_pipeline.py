"""The stages one after another, and the SQL twins of the operators that have one."""

import oracle
import pytest
from oracle import SF

import corpus_pipeline
from causelake.llm import registry
from causelake.llm.common import materialise


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        after = docs.count()
        assert after <= before and (name != "secrets" or after == before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and before > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    ok, got, want = oracle.compare(spark, name, SF, registry.QUERIES, registry.ORACLES)
    assert ok, (sorted(map(str, got[1]))[:3], sorted(map(str, want[1]))[:3])


def test_run_on_awkward_and_empty_tables(spark, docs, tmp_path):
    """Nulls, repeats, clashing columns, long and blank texts; planted toxic, copied, contaminated and secret ones."""
    import hashlib
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from causelake.llm.bpe import public_spec

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, base = text(30), [rng.choice(words) for _ in range(60)]
    near = base[:]
    near[30] = "changed"
    rows = [(k, text(60)) for k in range(100, 140)] + [(k, f"{text(30)}. you utter grumbleface! {text(20)}") for k in range(200, 240)]
    rows += [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, f"{text(20)} {item} {text(20)}"), (5, f"{text(30)} token=abcdefgh12345678"), (6, None), (7, ""), (None, text(50)), (8, "x" * 200_000)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 200)) for k in [*range(100, 140), *range(200, 240)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t or "" for i, t in rows if i is None or i < 200 and i not in (2, 3, 4)}
    kept[5] = kept[5].replace("token=abcdefgh12345678", "[SECRET]")
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, kept))
    tk = Tokenizer.from_str(public_spec("byte_bpe_50k.json"))
    for r in got:
        ids = tk.encode(kept[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    docs(rows).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
