import corpus_pipeline
from chainframe.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    from chainframe.llm.decontaminate import contamination
    from chainframe.llm.substring_dedup import substring_dedup

    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.count()
            continue
        assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "near_dedup":
            assert near_duplicates(docs).filter("NOT kept").count() == 0
        if name == "substring_dedup":
            removed = substring_dedup(before).agg({"n_removed": "sum", "n_words": "sum"}).first()
            assert docs.count() == before.count()
            left = substring_dedup(docs).agg({"n_words": "sum"}).first()["sum(n_words)"]
            assert left == removed["sum(n_words)"] - removed["sum(n_removed)"]
        if name == "decontamination":
            assert contamination(docs, benchmark).filter("contaminated").count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_repeated_rows_and_rows_without_id_keep_their_content(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other, third = text.replace("w", "v"), text.replace("w", "u")
    near = third.replace("u0 ", "x ")
    rows = [(1, text), (1, text), (2, text), (3, other), (3, other.upper()), (3, "short text of its own here"), (None, third), (None, third), (None, near), (None, text), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    found = [(r["doc_id"], (r["text"] or "").lower()) for r in left.collect()]
    assert left.columns == docs.columns and len(found) == 5
    assert (1, text) in found and (3, other) in found and (4, "alone") in found and (3, "short text of its own here") in found
    assert sum(i is None for i, _ in found) == 1 and {x for i, x in found if i is None} <= {third, near}
    kept = corpus_pipeline.cut_repeats(spark, left, SF)
    assert sorted(x.lower() for x in (r["text"] for r in kept.collect())) == sorted(x for _, x in found)


def test_awkward_tables_pass_all_stages(spark, docs, rows, empty, tmp_path):
    """Nulls, blanks, repeated rows, rows without id, clashing column names, and no rows at all."""
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(40)], "doc_id long, quality int")
    base = next(r[1] for r in rows if r[0] == 6)
    words = base.split()
    benchmark = spark.createDataFrame([(1, " ".join(words[5:30])), (2, None), (None, "never seen words")], "item_id long, text string")
    for name, table in (("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for k, table in enumerate((docs, empty)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}/{name}")
            before, now = now, spark.read.parquet(f"{tmp_path}/{k}/{name}")
            if name != "packing":
                assert now.columns == table.columns and now.count() <= before.count()
                if name == "near_dedup" and k == 0:
                    left = [(r["doc_id"], r["text"]) for r in now.collect()]
                    assert len(left) == len(set(left)) and sum(not (t or "").strip() for _, t in left) == sum(not (r["text"] or "").strip() for r in before.collect())
        assert (now.count() > 0) == (k == 0)
    found = corpus_pipeline.cut_benchmark(spark, docs, str(tmp_path)).filter("doc_id = 6").collect()
    assert [r["text"] for r in found] == [" ".join(words[:5]) + "  " + " ".join(words[30:])] * 2 and found[0]["n_chars"] == len(found[0]["text"])
