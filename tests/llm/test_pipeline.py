import zlib

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from memspark.llm import common, pieces, queries


def test_stages_one_by_one(spark, tmp_path):
    from tests.llm.test_models_and_media import toxic_corpus

    rows = toxic_corpus(300)
    near = " ".join(f"w{i}" for i in range(300))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows] + [(2000 + i, near + (" x" if i else ""), "en", "s0", 0) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = common.table(spark, str(tmp_path), "documents")
    toxic = {i for i, _, y in rows if y}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.cut(stage(spark, now, str(tmp_path)), name.replace(" ", "-"))
        kept[name] = now.collect()
    first = {r.doc_id for r in kept["toxicity"]}
    assert len(first & toxic) <= 0.1 * len(toxic) and len(first - toxic) >= 0.97 * (len(docs) - len(toxic))
    second = [r.doc_id for r in kept["near duplicates"]]
    assert len(second) == len(set(second)) and [i for i in second if i >= 2000] == [2000]
    assert first - set(second) == {2001, 2002, 2003}
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(kept["mix sources"]) - 1.5 * words(kept["near duplicates"])) <= 3
    for r in kept["pieces"]:
        assert r.n_ids == len(r.ids) and r.decoded_crc32 == zlib.crc32(r.text.encode())
    assert [r.text for r in kept["pieces"]] and pieces.load(queries.VOCABULARY)


def odd_documents(spark):
    near = " ".join(f"w{i}" for i in range(300))
    rows = [(1, near, "en", "a", 1), (2, near + " more", None, None, None), (2, near + " more", None, None, None), (None, "alone here with some words", "en", "a", 2), (5, None, "en", "b", 0), (6, "", None, "b", 0), (7, " \t", "x", None, 3), (8, "long " * 60_000, "en", "a", 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns({"KEPT": F.lit("k"), "__first": F.lit(1), "Size": F.lit(2), "score": F.lit("s")})


def test_stages_of_odd_rows_and_of_nothing(spark, tmp_path):
    """Nulls in any column, repeated rows, an empty and a long text, clashing names, no labels, and no rows."""
    spark.createDataFrame([(1, 1, None), (None, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        now, ids = docs, {}
        for name, stage in corpus_pipeline.STAGES:
            now = common.cut(stage(spark, now, str(tmp_path)), name.replace(" ", "-"))
            assert now.columns[: len(docs.columns)] == docs.columns
            ids[name] = sorted((r.doc_id for r in now.select("doc_id").collect()), key=str)
        if docs.isEmpty():
            assert not any(ids.values())
        else:
            assert ids["toxicity"] == sorted([1, 2, 2, None, 5, 6, 7, 8], key=str) and ids["near duplicates"] == sorted([1, None, 5, 8], key=str)
            assert 5 not in ids["mix sources"] and {1, 8} & set(ids["mix sources"])


def test_entry_has_every_query():
    names = __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
