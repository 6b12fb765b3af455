"""The pipeline's stages against the operators' rules, and what the driver's entry registers."""

from collections import Counter

import __spark_entry__
import corpus_pipeline as cp
from satchel.llm import quality
from tests.llm.data import docs, edge_rows, prose
from tests.llm.test_pairs_and_passages import brute_components, brute_hits
from tests.llm.test_texts import labelled, spans_by_rule


def test_registered():
    names = list(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [name for name, _ in cp.STAGES][1] == "n-gram Jaccard join" and len(cp.STAGES) == 5


def test_stages(spark, tmp_path):
    rows, labels = labelled(300)
    words = prose(1001, 80).split()
    rows += [(5000, " ".join([*words[:40], "other", *words[41:]])), (5001, prose(77, 100)), (5002, prose(78, 90) + ' token = "abcdef123456" end'), (1001, rows[1][1])] + edge_rows()
    items = [(1, " ".join(prose(77, 100).split()[20:40]))]
    d = str(tmp_path)
    frame = docs(spark, rows, clash=True).selectExpr("*", "'en' AS lang", "'s' AS source", "cast(char_length(text) as long) AS n_chars")
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = now.columns
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, now, d).write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        if k < 4:
            assert now.columns == columns
        kept.append(now.collect())
    pairs = lambda found: [(r.doc_id, r.text) for r in found]
    judged = quality.assess(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("kept").collect()
    assert Counter(r.doc_id for r in kept[0]) == Counter(r.doc_id for r in judged)
    groups = brute_components(pairs(kept[0]), 5, 80)
    assert sorted({r.doc_id for r in kept[1] if r.doc_id is not None}) == sorted({i for i, _, c in groups if i is not None and i == c})
    assert max(Counter((r.doc_id, r.text) for r in kept[1]).values()) == 1
    clean = {i for i, *_, hit in brute_hits(pairs(kept[1]), items) if not hit}
    assert Counter(r.doc_id for r in kept[2]) == Counter(r.doc_id for r in kept[1] if r.doc_id in clean) and 5001 not in clean
    assert len(kept[3]) == len(kept[2]) and not any(spans_by_rule(r.text) for r in kept[3])
    assert next(r.text for r in kept[3] if r.doc_id == 5002).endswith("[secret]\" end") or "[secret]" in next(r.text for r in kept[3] if r.doc_id == 5002)
    assert Counter(r.doc_id for r in kept[4]) == Counter(r.doc_id for r in kept[3]) and all(r.round_trip for r in kept[4])


def test_one_row_of_each_group(spark, tmp_path):
    """Ids that are null or stand on several texts: every group of near copies keeps one row."""
    near = lambda text: " ".join([*text.split()[:-1], "changed"])
    a, b, c, d = (prose(900 + k, 90) for k in range(4))
    rows = [(7, a), (9, near(a)), (7, b), (3, near(b)), (1, c), (None, c), (None, near(c)), (None, d), (None, near(d)), (8, ""), (None, ""), (7, a)]
    left = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs(spark, rows, clash=True), str(tmp_path)).collect()]
    own = [x for x in left if x[1] in (d, near(d))]
    assert len(own) == 1 and own[0][0] is None
    assert Counter(x for x in left if x not in own) == Counter([(7, a), (3, near(b)), (1, c), (8, ""), (None, "")])


def test_run_on_empty(spark, tmp_path):
    d = str(tmp_path)
    docs(spark, []).selectExpr("*", "'en' AS lang", "'s' AS source", "cast(0 as long) AS n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0
