from pyspark.sql import functions as F

from retentia.config import DEFAULT_CONFIG
from retentia.operators.quantiles import collect_quantiles, exact_quantiles
from retentia.operators.split import class_allocation, cv_folds, stratified_split


def _data(spark, n=2003, pos_share=0.66):
    return spark.range(n).select(F.col("id").alias("account_id"),
                                 F.when(F.rand(5) < pos_share, 1).otherwise(0).alias("renewed"))


def test_split_sizes_follow_allocation(spark):
    df = _data(spark)
    out = stratified_split(df, DEFAULT_CONFIG)
    counts = {(r["renewed"], r["split"]): r["count"] for r in out.groupBy("renewed", "split").count().collect()}
    alloc = {r["renewed"]: (r["n_class"], r["n_test"]) for r in class_allocation(df, "renewed", 0.2).collect()}
    n = sum(c for c, _ in alloc.values())
    assert sum(t for _, t in alloc.values()) == -(-n // 5)  # ceil(0.2 n)
    for label, (n_class, n_test) in alloc.items():
        assert counts[(label, "test")] == n_test
        assert counts[(label, "train")] == n_class - n_test


def test_published_shape_allocation(spark):
    rows = [(i, 0) for i in range(1445)] + [(1445 + i, 1) for i in range(2805)]
    df = spark.createDataFrame(rows, "account_id long, renewed int")
    alloc = {r["renewed"]: r["n_test"] for r in class_allocation(df, "renewed", 0.2).collect()}
    assert alloc == {0: 289, 1: 561}  # 850 test rows, as published


def test_split_is_deterministic(spark):
    df = _data(spark)
    a = stratified_split(df).where("split = 'test'").select("account_id")
    b = stratified_split(df).where("split = 'test'").select("account_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_are_balanced_per_class(spark):
    out = cv_folds(_data(spark, 1000), DEFAULT_CONFIG)
    sizes = {}
    for r in out.groupBy("renewed", "fold").count().collect():
        sizes.setdefault(r["renewed"], []).append(r["count"])
    for per_class in sizes.values():
        assert len(per_class) == 3 and max(per_class) - min(per_class) <= 1


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=1001), 3)
    b = rng.integers(0, 5, 1001).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["column"], r["probability"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probs).collect()}
    collected = collect_quantiles(df, ["a", "b"], probs)
    for col, arr in (("a", a), ("b", b)):
        for p in probs:
            want = np.quantile(arr, p)
            assert abs(got[(col, p)] - want) < 1e-12
            assert abs(collected[(col, p)] - want) < 1e-12


def test_quantile_bracket_beyond_exact_sketch(spark, monkeypatch):
    # a coarse sketch (accuracy 100) compresses 20,000 values: the bracket
    # must still hold the exact answer, hot value included
    import numpy as np

    import retentia.operators.prefix as P
    import retentia.operators.quantiles as Q

    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 100)
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.sin(F.col("id")) * 100).alias("x"))
    arr = np.array([r[0] for r in df.collect()])
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    for r in Q.exact_quantiles(df, ["x"], [0.25, 0.5, 0.8]).collect():
        assert abs(r["value"] - np.quantile(arr, r["probability"])) < 1e-9


def test_quantiles_of_infinities_and_empty_columns(spark):
    rows = [(float("inf"), None)] * 3 + [(1.0, None)]
    got = {r["column"]: r["value"] for r in exact_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert got == {"a": float("inf")}


def test_few_and_many_buckets_give_the_same_folds(spark, monkeypatch):
    import retentia.operators.split as S

    df = _data(spark, 1500)
    few = cv_folds(df).select("account_id", "fold")
    monkeypatch.setattr(S, "BUCKET_ROWS", 2)
    many = cv_folds(df).select("account_id", "fold")
    assert few.exceptAll(many).count() == 0
    monkeypatch.setattr(S, "DIGITS", 1)  # many rounds of the boundary search
    one = stratified_split(df).select("account_id", "split")
    monkeypatch.setattr(S, "DIGITS", 4)
    assert one.exceptAll(stratified_split(df).select("account_id", "split")).count() == 0


def test_rows_equal_in_every_column_are_split_and_folded(spark, monkeypatch):
    import retentia.operators.split as S

    monkeypatch.setattr(S, "BUCKET_ROWS", 5)  # the repeated row's bucket is cut by row
    df = _data(spark, 600).unionByName(
        spark.range(400).select(F.lit(42).cast("long").alias("account_id"), F.lit(1).alias("renewed"))
    )
    alloc = {r["renewed"]: r["n_test"] for r in class_allocation(df, "renewed", 0.2).collect()}
    out = stratified_split(df)
    got = {r["renewed"]: r["count"] for r in out.where("split = 'test'").groupBy("renewed").count().collect()}
    assert got == alloc and out.count() == 1000
    sizes = {}
    for r in cv_folds(df).groupBy("renewed", "fold").count().collect():
        sizes.setdefault(r["renewed"], []).append(r["count"])
    assert all(len(x) == 3 and max(x) - min(x) <= 1 for x in sizes.values())


def test_duplicated_ids_split_deterministically(spark):
    # one id holds a third of the rows: its copies share one hash bucket
    base = _data(spark, 1200).withColumn("extra", F.col("account_id") % 7)
    hot = spark.range(600).select(F.lit(42).cast("long").alias("account_id"), F.lit(1).alias("renewed"),
                                  (F.col("id") % 5).alias("extra"))
    df = base.unionByName(hot)
    a = stratified_split(df)
    b = stratified_split(df)
    # rows of one id are told apart by their place in the table, other ids by their hash
    assert a.where("account_id <> 42").exceptAll(b.where("account_id <> 42")).count() == 0
    alloc = {r["renewed"]: r["n_test"] for r in class_allocation(df, "renewed", 0.2).collect()}
    got = {r["renewed"]: r["count"] for r in a.where("split = 'test'").groupBy("renewed").count().collect()}
    assert got == alloc
    assert a.count() == df.count()


def test_null_class_is_split_not_dropped(spark):
    df = _data(spark, 500).withColumn("renewed", F.when(F.col("account_id") % 10 == 0, None).otherwise(F.col("renewed")))
    out = stratified_split(df)
    assert out.count() == 500
    alloc = {r["renewed"]: r["n_test"] for r in class_allocation(df, "renewed", 0.2).collect()}
    got = {r["renewed"]: r["count"] for r in out.where("split = 'test'").groupBy("renewed").count().collect()}
    assert got == alloc
    folds = cv_folds(df)
    assert folds.count() == 500 and folds.where("fold IS NULL").count() == 0
