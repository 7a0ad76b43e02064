"""The stages on a small corpus, each against brute force on its own input."""

import random

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_hits, brute_spans, prose, rows
from tracemend.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(21)
    texts = [prose(draw, draw.randrange(30, 90)) for _ in range(40)]
    passage, leak = prose(draw, 40), prose(draw, 30)
    texts += [texts[0], texts[1] + " one more", f"{prose(draw, 30)} {passage} {prose(draw, 30)}", f"{prose(draw, 25)} {passage} {prose(draw, 25)}", f"{prose(draw, 40)} {leak} {prose(draw, 20)}"]
    bad = ["!! ".join(prose(draw, 40).upper().split()) for _ in range(20)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(bad)]
    docs += [(200, None, "en", None, None), (201, "", None, "s", 0), docs[5]]
    labels = [(i, int(i < 100), 0) for i, *_ in docs if i % 3 and i < 200]
    return docs, labels, [(1, leak), (2, prose(draw, 20))]


def test_stages(spark, tmp_path):
    docs, labels, bench = corpus()
    for name, data, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, df = rows(df), spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, rows(df))
        if name != "packing":
            assert set(df.columns) == set(corpus_pipeline.COLUMNS)

    before, after = seen["quality"]
    assert {r["doc_id"] for r in after} >= set(range(45)) and not {r["doc_id"] for r in after} & set(range(100, 120))
    model = quality.train(spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, label int, toxic int"))
    assert model.weights.any()

    before, after = seen["near_duplicates"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted({r["doc_id"] for r in after}) == sorted(i for i, (_, c) in groups.items() if c == i)
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()

    before, after = seen["repeated_passages"]
    raw, covered = brute_spans([(r["doc_id"], r["text"]) for r in before], 100)
    for r in after:
        kept = bytes(b for b, c in zip(raw[r["doc_id"]], covered[r["doc_id"]], strict=True) if not c)
        assert (r["text"] or "").encode() == kept and r["n_chars"] == len(kept.decode())
    assert any(map(any, covered.values())) and len({r["doc_id"] for r in after}) == len({r["doc_id"] for r in before})

    before, after = seen["benchmark_leaks"]
    leaked = {r["doc_id"] for r in before if brute_hits(r["text"], bench, 10)[1]}
    assert leaked == {44} and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaked

    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert len({r["sequence_id"] for r in after}) <= -(-sum(r["length"] for r in after) // 4096) + 1


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
