"""Queries with SQL against it, and the pipeline stage by stage."""

import corpus_pipeline
import oracle
import pytest

from marketloom.llm import registry, shingle_join
from marketloom.llm.tables import settled

from test_documents import components


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    error, rows = oracle.compare(registry.QUERIES[name](spark, sf), oracle.connect(sf), registry.ORACLES[name])
    assert error is None and rows


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = settled(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs.collect())
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for i, q in labels.items() if q == 1 and any(r["doc_id"] == i for r in before))
    assert not any(i in kept for i, q in labels.items() if q == 0)
    before, after = seen["exact_dedup"]
    largest = {}
    for r in before:
        largest[r["text"] or ""] = max(r["doc_id"], largest.get(r["text"] or "", -1))
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())
    before, after = seen["near_copies"]
    found = components([(r["doc_id"], r["text"]) for r in before], shingle_join.NEAR_COPIES)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in found if i == c)
    before, after = seen["source_mix"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
    mixed, packed = seen["packing"][0], seen["packing"][1]
    order = [r["doc_id"] for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    in_files = [r["doc_id"] for r in spark.createDataFrame(mixed).collect()]
    assert sorted(order) == sorted(in_files)


def test_run_is_its_stages_on_odd_rows(spark, tmp_path):
    """The whole run: repeated ids, ids of other texts, nulls and clashing columns go through all stages, and no unique text is lost."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base), (5, base), (5, "one text that nobody else has at all here"), (6, base + " end"), (None, "without an id but with words of its own"), (7, None), (8, ""), (9, base + " end"),
            *[(100 + i, f"document {i} of many, each with its very own words a{i} b{i} c{i} d{i}") for i in range(40)]]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.selectExpr("*", "'x' AS part", "'x' AS row", "'x' AS block").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    starts = sorted((str(r["doc_id"]) for r in got if r["start"] == 0))
    # of the equal empty texts the largest id stays; base is kept under 5 by the exact stage and then stands for its near copy, 9 being the larger of two equal ones
    assert starts == sorted(["5", "5", "None", "8", *[str(100 + i) for i in range(40)]])
    ordered = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in ordered:
        assert r["sequence_id"] * 1024 + r["offset"] == place
        place += r["length"]


def test_packing_follows_the_order_of_the_mix(spark, sf):
    from marketloom.llm import mixing, packing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = [r["row"]["doc_id"] for r in mixing.mixed(docs, carry=["doc_id"]).orderBy("position").collect()]
    laid = settled(mixing.mixed_rows(docs), "test-mix")
    pieces = packing.pieces(laid).where("start = 0").orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces] == order
