"""The pipeline, stage by stage, against plain Python over the same decisions."""

import re

import corpus_pipeline
from folioflow.llm import packing
from folioflow.llm.common import table
from test_near_copies import survivors


def test_stages_keep_their_contract(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    start, columns, sizes = docs.count(), docs.columns, {}
    toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        sizes[name] = docs.count()
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            labelled = {r.doc_id for r in table(spark, sf, "labels").collect()}
            assert len(gone & toxic) > 0 and len((gone & labelled) - toxic) <= 2
        if name == "near_duplicates":
            kept = sorted(r.doc_id for r in docs.collect())
            assert kept == survivors([(r.doc_id, r.text) for r in before.collect()])
        if name == "decontamination":
            windows = set()
            norm = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            for r in table(spark, sf, "benchmark").collect():
                w = norm(r.text)
                windows |= {" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
            dirty = lambda t: any(f" {x} " in f" {' '.join(norm(t))} " for x in windows)
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect() if not dirty(r.text)}
        if name == "secret_scans":
            assert sizes[name] == before.count()
            assert all(r.n_chars == len(r.text) and not re.search("[0-9a-f]{24,}", r.text) for r in docs.collect())
    assert sizes["toxicity"] < start
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert docs.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, predicted int, score double, held_out boolean, _text string, _key string, copy long, fp long, id string, row int"


def odd_tables(spark, at, rows):
    texts = [*rows, *[None, "", " ", "plain words here", "plain words here", "x" * 40_000, "key AKIA" + "A1B2C3D4" * 3]]
    held = [(k if k % 5 else None, t, "en", "s", len(t) if t is not None else None, 9, 0.5, True, "t", "k", 1, 2, "i", 3) for k, t in enumerate(texts, 1)]
    docs = spark.createDataFrame([*held, held[2], held[2]] if held[2:] else held, ODD)
    docs.write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).write.parquet(f"{at}/{name}.parquet")
    return docs


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark").first().text
    docs = odd_tables(spark, tmp_path, ["some words of their own, enough to be a text", f"before {benchmark} after", "more words of their own that nothing else has"])
    stage = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near_duplicates", "decontamination", "secret_scans"):
        docs = stage[name](spark, docs, str(tmp_path)).cache()
        assert docs.dtypes == spark.createDataFrame([], ODD).dtypes, name
        assert all(r._text == "t" and r._key == "k" and r.predicted == 9 and r.copy == 1 and r.row == 3 for r in docs.collect())
    texts = [r.text for r in docs.collect()]
    assert sorted(t for t in texts if t and len(t) < 1000) == ["key [SECRET]", "more words of their own that nothing else has", "plain words here", "some words of their own, enough to be a text"]
    assert len(texts) == 6 and sum(not (t or "").strip() for t in texts) == 1
    assert stage["packing"](spark, docs, str(tmp_path)).select("doc_id").distinct().count() >= 5


def test_run_gives_pieces_of_what_stays(spark, tmp_path):
    odd_tables(spark, tmp_path, ["some words of their own, enough to be a text"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("piece = 0").count() == 5 and out.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").isEmpty()
    empty = tmp_path / "empty"
    spark.createDataFrame([], ODD).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
