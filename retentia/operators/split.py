"""Stratified train/test split and stratified cross-validation folds.

Both are exact and reproducible. A row's place in its class is the order of a
string: the seeded md5 of its id, then the md5 of its row number in the
stored input table. The first part orders rows with different ids, the second
one tells rows of the same id apart, however many there are and even if they
agree in every column.

* The split needs one string per class, the one of its last test row. It is
  found digit by digit: one aggregation counts the class's rows by the next
  four hex digits, the bucket where the test share ends gives those digits,
  and the search goes on inside it until it ends on a bucket's last row (one
  to three rounds when ids differ). Then a row is a test row if its string is
  not greater: a narrow projection with one literal per class, written once,
  partitioned by side, so that readers of one side prune the other's folder.
* Folds need every row's rank: rows are ranked inside buckets of leading
  digits, as many as keep BUCKET_ROWS rows in each, plus the rows in earlier
  buckets. A bucket that holds far more rows (one id with many rows) is cut
  by the digits of the row part instead.

Test sizes follow the usual shuffle-split rule: ``n_test = ceil(share * n)``,
``n_train = n - n_test``; the train rows are shared out over the classes by
largest remainder of ``n_train * n_c / n`` (ties: lower class first), and each
class's test size is the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, RenewalConfig
from ..session import stored

SPLIT = "split"
FOLD = "fold"


def hash_key(id_column: str, seed: int, salt: str = "") -> Column:
    """Seeded per-row order key; md5 so that any engine can reproduce it."""
    parts = [F.col(id_column).cast(T.StringType()), F.lit(str(seed))]
    if salt:
        parts.append(F.lit(salt))
    return F.md5(F.concat_ws(":", *parts))


def class_allocation(df: DataFrame, target: str, share: float) -> DataFrame:
    """``(target, n_class, n_test)``: one row per class (a handful of rows)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()
    n = F.sum("n_class").over(everything)
    n_test_total = F.ceil(F.lit(float(share)) * n)
    sized = counts.select(
        target,
        "n_class",
        (n - n_test_total).alias("_n_train"),
        n.alias("_n"),
    ).withColumn("_prod", F.col("_n_train") * F.col("n_class"))
    sized = sized.withColumns(
        {"_floor": F.floor(F.col("_prod") / F.col("_n")).cast(T.LongType()), "_rem": F.col("_prod") % F.col("_n")}
    )
    sized = sized.withColumn("_need", F.col("_n_train") - F.sum("_floor").over(everything))
    sized = sized.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(target))))
    train = F.col("_floor") + F.when(F.col("_order") <= F.col("_need"), 1).otherwise(0)
    return sized.select(target, "n_class", (F.col("n_class") - train).cast(T.LongType()).alias("n_test"))


DIGITS = 4  # of a round: at most 65,536 counts per class
BUCKET_ROWS = 20_000  # rows that a window task ranks
KEY_LENGTH = 32  # hex digits of an md5
ROW, PLACE = "_row", "_place"


def _placed(df: DataFrame, ident: str, seed: int, salt: str = "") -> DataFrame:
    """The stored input with ``PLACE``, the string that orders its rows."""
    rows = stored(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    return rows.withColumn(PLACE, F.concat(hash_key(ident, seed, salt), F.md5(F.col(ROW).cast(T.StringType()))))


def _same_class(target: str, value) -> Column:
    return F.col(target).eqNullSafe(F.lit(value))


def split_boundaries(placed: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> list[tuple]:
    """Per class with test rows: ``(class, prefix)``; the class's test rows
    are those whose place starts with a string not greater than the prefix.

    Each round is one job whose collect has one row per class.
    """
    target = config.target
    need = {r[target]: r["n_test"] for r in class_allocation(placed, target, config.test_share).collect()}
    open_ = {c: ("", n) for c, n in need.items() if n > 0}
    found = []
    while open_:
        inside, start, wanted = F.lit(False), F.lit(1), F.lit(0).cast(T.LongType())
        for c, (prefix, n) in open_.items():
            same = _same_class(target, c)
            inside = inside | (same & F.col(PLACE).startswith(prefix))
            start = F.when(same, F.lit(len(prefix) + 1)).otherwise(start)
            wanted = F.when(same, F.lit(n).cast(T.LongType())).otherwise(wanted)
        counts = (
            placed.where(inside)
            .groupBy(target, F.substr(PLACE, start, F.lit(DIGITS)).alias("_digits"))
            .agg(F.count(F.lit(1)).alias("_cnt"))
        )
        earlier = Window.partitionBy(target).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
        last = (
            counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)))
            .where((F.col("_before") < wanted) & (wanted <= F.col("_before") + F.col("_cnt")))
            .collect()
        )
        for r in last:
            prefix, n = open_.pop(r[target])
            prefix, n = prefix + r["_digits"], n - r["_before"]
            if n == r["_cnt"]:
                found.append((r[target], prefix))
            else:
                open_[r[target]] = (prefix, n)
    return found


def stratified_split(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """All input columns + ``split`` in {'train', 'test'}: a stored table,
    partitioned by ``split``. A null class is a class of its own."""
    placed = _placed(df, config.id_column, config.random_state)
    is_test = F.lit(False)
    for c, prefix in split_boundaries(placed, config):
        is_test = is_test | (_same_class(config.target, c) & (F.substring(PLACE, 1, len(prefix)) <= F.lit(prefix)))
    sides = placed.withColumn(SPLIT, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
    return stored(sides.drop(ROW, PLACE), "split", partition_by=SPLIT)


def cv_folds(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, folds: int | None = None) -> DataFrame:
    """All input columns + ``fold`` in 0..k-1, balanced inside each class
    (a null class is a class of its own): rank in the class modulo k."""
    k = folds or config.cv_folds
    placed = _placed(df, config.id_column, config.random_state, "fold")
    total, digits = placed.count(), 1
    while 16**digits * BUCKET_ROWS < total:
        digits += 1
    # a class key that is not null, for grouping and joining
    keyed = placed.withColumn("_class", F.coalesce(F.col(config.target).cast(T.StringType()), F.lit("")))
    leading = F.substring(PLACE, 1, digits)
    # at most total / (16 * BUCKET_ROWS) of them
    full = keyed.groupBy("_class", leading.alias("_b")).count().where(F.col("count") > 16 * BUCKET_ROWS).collect()
    hot = sorted({r["_b"] for r in full})
    finer = F.substring(PLACE, 1, KEY_LENGTH + max(digits, DIGITS))
    bucketed = keyed.withColumn("_bucket", F.when(leading.isin(hot), finer).otherwise(leading) if hot else leading)
    counts = bucketed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    earlier = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_bucket", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_bucket").orderBy(PLACE)
    ranked = bucketed.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["_class", "_bucket"])
    fold = ((F.col("_before") + F.col("_rank") - 1) % k).cast(T.IntegerType())
    return ranked.select(*df.columns, fold.alias(FOLD))
