import hashlib

from pyspark.sql import functions as F

from censora.llm import exact


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, out))


def marks(docs, **options):
    return exact.marks(docs, **options).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("sha256"))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_awkward_rows(documents, clashing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert told(marks(documents)) == brute(rows)
    taken = clashing.selectExpr("*", *[f"'x' AS `{c}`" for c in ("_id", "_digest", "_salt", "_keep", "_at", "keep_id", "digest")])
    assert told(marks(taken)) == brute(rows)
    left = exact.deduplicated(taken)
    assert left.columns == taken.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in rows})


def test_texts_with_equal_digests_stay_apart(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    weak = lambda text: F.lit(b"all alike")
    by_weak, by_strong = exact.marks(documents, digest=weak), exact.marks(documents)
    assert told(by_weak.drop("digest")) == told(by_strong.drop("digest"))
    assert exact.deduplicated(documents, digest=weak).count() == len({t or "" for _, t in rows})


def test_a_hot_group_in_many_tasks(spark, many_tasks):
    rows = spark.range(0, 6000, numPartitions=12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copied").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    assert told(marks(rows)) == brute([tuple(r) for r in rows.collect()])
    assert exact.deduplicated(rows).where("text = 'copied'").select("doc_id").collect()[0][0] == 5997


def test_empty_table_and_ids_of_text(spark, documents):
    assert exact.marks(documents.limit(0)).count() == 0 and exact.deduplicated(documents.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), (None, "y")], "name string, body string")
    assert told(exact.marks(named, "name", "body").drop("digest")) == ["('a', 'b', 3, False)", "('b', 'b', 3, True)", "(None, 'b', 3, False)", "(None, None, 1, True)"]


def test_no_python_in_the_plan(documents):
    plan = exact.marks(documents)._jdf.queryExecution().toString()
    assert not any(n in plan for n in ("Python", "Arrow", "Pandas"))
