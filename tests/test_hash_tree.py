import fixtures as fx
from pyspark.sql import functions as F

from shelfline.operators import hash_tree
from shelfline.operators.compare import id_set_diff

FIELDS = ["price", "note"]


def stored(df, path, files=8):
    df.repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kinds(found):
    return sorted((r.id, r.kind) for r in found.collect())


def wide(spark, rows):
    note = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("n"))
    return spark.range(-rows // 2, rows // 2).select("id", (F.col("id") % 9).alias("price"), note.alias("note"))


def test_only_unequal_leaves_are_read(spark, tmp_path):
    source = wide(spark, 400_000)
    # One changed, one gone, one new; a null moves to the neighbouring field of another row.
    note = F.when(F.col("id") == 70_000, "other").otherwise(F.col("note"))
    read = source.where("id <> -150000").withColumn("note", note)
    read = read.unionByName(wide(spark, 10).where("id = 1").withColumn("id", F.lit(900_000).cast("long")))
    a, b = stored(source, str(tmp_path / "a")), stored(read, str(tmp_path / "b"))
    trees = []
    for name, rows in (("ta", a), ("tb", b)):
        hash_tree.write_tree(hash_tree.tree(rows, "id", FIELDS), str(tmp_path / name))
        trees.append(hash_tree.read_tree(spark, str(tmp_path / name)))
    want = [(-150_000, "missing"), (70_000, "different"), (900_000, "extra")]
    assert kinds(hash_tree.tree_diff(a, b, FIELDS)) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = hash_tree.tree_diff(a, b, FIELDS, trees=tuple(trees))
        assert kinds(found) == want
        scans = found._jdf.queryExecution().executedPlan().collectLeaves()
        read_rows = 0
        for i in range(scans.size()):
            scan = scans.apply(i)
            if "price" in scan.toString():
                read_rows += scan.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < read_rows < 300_000  # of 800 000: three files of a side at most


def test_equal_tables_wider_ranges_and_edges(spark, monkeypatch):
    rows = wide(spark, 2_000)
    assert kinds(hash_tree.tree_diff(rows, rows.orderBy(F.desc("id")), FIELDS)) == []
    none = rows.limit(0)
    assert len(kinds(hash_tree.tree_diff(rows, none, FIELDS))) == 2_000
    assert {k for _, k in kinds(hash_tree.tree_diff(none, rows, FIELDS))} == {"extra"}
    assert kinds(hash_tree.tree_diff(none, none, FIELDS)) == []
    monkeypatch.setattr(hash_tree, "RANGES", 3)
    changed = rows.withColumn("price", F.when(F.col("id") % 200 == 0, -50).otherwise(F.col("price")))
    changed = changed.where("id < 900")
    for bits in (2, 12):
        found = kinds(hash_tree.tree_diff(rows, changed, FIELDS, bits=bits))
        assert [i for i, k in found if k == "missing"] == list(range(900, 1_000))
        assert [i for i, k in found if k == "different"] == list(range(-1_000, 900, 200))
    missing, extra = id_set_diff(rows, changed)
    assert (missing.count(), extra.count()) == (100, 0)


def test_nulls_and_number_types_are_told_apart(spark):
    shape = "id long, price int, rating int"
    a = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, 1, 1)], shape)
    b = spark.createDataFrame([(1, 5, None), (2, 7, None), (3, 1, 1)], shape)
    assert kinds(hash_tree.tree_diff(a, b, ["price", "rating"])) == [(1, "different")]
    longs = a.withColumn("price", F.col("price").cast("long"))
    assert kinds(hash_tree.tree_diff(a, longs, ["price", "rating"])) == []
    docs = fx.products(spark, [(1, "ACTIVE", 1, 1, fx.T0)])
    assert kinds(hash_tree.tree_diff(docs, docs.withColumn("status", F.lit("DELETED")), ["status"])) == [(1, "different")]
