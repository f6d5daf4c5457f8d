"""Every operator and stage on nulls, empty and long texts, repeated rows,
clashing columns and empty tables."""

import pytest

from palimpsest.llm import licenses, mixing, packing, pivot_search, quality_model, quality_rules, simhash, spans, token_files, toxicity


def test_substring_dedup(odd_docs, odd_rows):
    out = spans.dedup(odd_docs, ("ns", "nr", "rm")).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["text"] is None for r in by[1]) and by[2][0]["text"] == "" and by[4][0]["nr"] == 0
    # the row without an id comes first and keeps its text; copies lose theirs
    assert sorted(r["nr"] > 0 for r in by[None]) == [False, False] and by[0][0]["text"] == "" and by[5][0]["nr"] == by[5][1]["nr"] > 0
    kept = spans.remove_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 3, 4, 7, 8}


def test_packing(odd_docs, odd_rows):
    out = packing.pack_documents(odd_docs).collect()
    assert sum(r["piece"] == 0 for r in out) == len(odd_rows)
    assert {r["length"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= packing.CAPACITY


def test_quality_rules(odd_docs, labels, no_labels):
    for known in (labels, no_labels):
        out = {r["doc_id"]: r for r in quality_rules.apply_rules(odd_docs, known, "_s", "_r").collect()}
        assert all(out[k]["_r"] == 0 for k in (1, 2, 3, 7, 8)) and out[4]["_s"]["n_words"] == 30_000
    assert quality_rules.keep_good(odd_docs, no_labels).columns == odd_docs.columns


def test_simhash(odd_docs, odd_rows):
    out = simhash.groups(odd_docs).collect()
    assert len(out) == len(odd_rows)
    comp = {}
    for r in out:
        comp.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert comp[1] == comp[2] == comp[3] == {1} and comp[5] == {0} and comp[None] == {0, 1}
    kept = simhash.keep_first(odd_docs)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids.count(5) == 0 and ids.count(0) == 1 and 2 not in ids


def test_simhash_without_any_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert simhash.keep_first(df).count() == 2


def test_token_files(spark, odd_docs, odd_rows, tmp_path):
    token_files.write_tokens(odd_docs, str(tmp_path / "t"))
    out = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    assert len(out) == len(odd_rows)
    assert sorted(r["n_tokens"] for r in out if r["doc_id"] in (1, 2)) == [1, 1]
    order = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in order[:2]] == [True, True]
    assert [r["doc_id"] for r in order[2:]] == sorted(r["doc_id"] for r in order[2:])


def test_mixing(odd_docs, odd_rows):
    out = mixing.mix_sizes(odd_docs).collect()
    assert len(out) == len(odd_rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(odd_docs).columns == odd_docs.columns


def test_classifiers(odd_docs, odd_rows, labels, no_labels):
    for known in (labels, no_labels):
        for f in (quality_model.score_quality, toxicity.score_toxicity):
            out = f(odd_docs, known).collect()
            assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)


def test_licenses(odd_docs, odd_rows):
    out = licenses.scan(odd_docs).collect()
    assert len(out) == len(odd_rows) and {r["family"] for r in out} == {"unknown"}


def test_pivot_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_search.top_k(df).collect()}
    assert {k: v for k, v in out.items() if k[0] == 0} == {(0, 1): (1, 4096), (0, 2): (2, 2048), (0, 3): (7, 0), (0, 4): (20, 0)}


@pytest.mark.parametrize("name", ["spans", "stage1", "pack", "rules", "simhash", "stage6", "mixing", "stage9", "quality", "toxic", "license"])
def test_empty_table(no_docs, labels, name):
    run = {
        "spans": lambda: spans.dedup(no_docs), "stage1": lambda: spans.remove_repeats(no_docs), "pack": lambda: packing.pack_documents(no_docs),
        "rules": lambda: quality_rules.keep_good(no_docs, labels), "simhash": lambda: simhash.groups(no_docs), "stage6": lambda: simhash.keep_first(no_docs),
        "mixing": lambda: mixing.mix_sizes(no_docs), "stage9": lambda: mixing.mix(no_docs), "quality": lambda: quality_model.score_quality(no_docs, labels),
        "toxic": lambda: toxicity.score_toxicity(no_docs, labels), "license": lambda: licenses.scan(no_docs),
    }
    assert run[name]().collect() == []


def test_empty_vectors_and_files(spark, no_docs, tmp_path):
    assert pivot_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    token_files.write_tokens(no_docs, str(tmp_path / "t"))
    assert token_files.read_tokens(spark, str(tmp_path / "t")).collect() == []


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_runs_on_odd_and_empty_tables(spark, odd_rows, labels, no_labels, no_docs, tmp_path, kind):
    import corpus_pipeline as C

    docs = spark.createDataFrame([*odd_rows, (5, "another text under one id", "en", "a", 25)], no_docs.schema) if kind == "odd" else no_docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    (labels if kind == "odd" else no_labels).write.parquet(str(tmp_path / "labels.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    assert bool(out) == (kind == "odd")
