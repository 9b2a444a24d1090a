"""The pipeline: stages keep columns and take effect; the queries are registered."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries, tokens


def sources(tmp_path, spark):
    rng = np.random.default_rng(8)
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = []
    for k in range(90):
        lang = ("aa", "bb")[k % 2]
        words = [f"{'ka' if lang == 'aa' else 'ü'}{rng.integers(300)}{'' if lang == 'aa' else 'sch'}" for _ in range(rng.integers(20, 60))]
        rows.append((k, " ".join(words), lang, f"s{min(k % 7, 2)}"))
    rows += [(200, rows[3][1], "bb", "s1"), (201, rows[4][1] + " kamore", "aa", None), (202, f"ka1 ka2 {item} ka3", "aa", "s0"), (203, None, "aa", "s0"), (204, "12 34", None, "s1"), (205, "", "bb", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang_pred", F.lit("own")).withColumn("_copies", F.lit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), rows


def test_stages(spark, tmp_path):
    docs, rows = sources(tmp_path, spark)
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{tmp_path}/stage{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = set(range(90))
    assert set(kept["language ID"]) == clean | {200, 201, 202}
    assert set(kept["n-gram Jaccard join"]) == clean | {202}
    assert set(kept["benchmark decontamination"]) == clean
    mixed = kept["mixing sources to target weights"]
    assert set(mixed) <= clean and max(map(mixed.count, set(mixed))) <= 2
    sizes = {r[0]: len((r[1] or "").split()) for r in rows}
    assert abs(sum(sizes[i] for i in mixed) - 1.5 * sum(sizes[i] for i in clean)) < 3 * 60
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == sorted(mixed)
    encoder = tokens.PieceEncoder(tokens.default_tokenizer())
    import pyarrow as pa

    assert sum(r.n_tokens for r in last) == len(encoder(pa.array([rows[i][1] for i in mixed]))[0])


def test_null_and_repeated_ids_through_the_stages(spark, tmp_path):
    docs, rows = sources(tmp_path, spark)
    item = "one two three four five six seven eight nine ten eleven twelve"
    odd = [(None, rows[5][1] + " kaone", "aa", "s0"), (None, f"ka1 {item}", "aa", "s0"), (7, rows[8][1], "aa", "s1"), (7, rows[7][1], "bb", "s1"), (11, f"ka9 {item} ka9", "aa", "s1")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang_pred", F.lit("own")).withColumn("_copies", F.lit(3))
    both = docs.unionByName(more).withColumn("_key", F.lit("k")).withColumn("r", F.lit("own"))
    once = corpus_pipeline.one_of_each(spark, both, str(tmp_path))
    assert once.columns == both.columns
    got = once.select("doc_id", "text").collect()
    ids = [r.doc_id for r in got]
    assert ids.count(7) == ids.count(11) == 1 and ids.count(None) == 2
    kept = corpus_pipeline.decontaminated(spark, both, str(tmp_path)).select("doc_id", "text", "_key").collect()
    texts = Counter((r.doc_id, r.text) for r in kept)
    assert texts == Counter((i, t) for i, t, _, _ in [*rows, *odd] if item not in (t or ""))
    assert {r._key for r in kept} == {"k"}


def test_empty_documents_through_the_stages(spark, tmp_path):
    docs, _ = sources(tmp_path, spark)
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_language_stage_drops_what_is_no_better_than_chance(spark, tmp_path, monkeypatch):
    docs, rows = sources(tmp_path, spark)
    clear = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    monkeypatch.setattr(corpus_pipeline, "LEAST_MARGIN", 1.1)
    assert clear and corpus_pipeline.language_id(spark, docs, str(tmp_path)).count() == 0


def test_queries_are_registered_once_each():
    import __spark_entry__

    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(queries.QUERIES) <= set(found)
