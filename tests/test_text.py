from pyspark.sql import functions as F

from ticketloom.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", list: "array<string>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_normalize_and_tokenize(spark):
    assert one(spark, T.normalize_text(F.col("s")), s="  The NULL-pointer, at\tFoo_1! ") == "the null-pointer at foo_1"
    assert one(spark, T.tokenize(F.col("s")), s="The null-pointer at the Foo_1") == ["null", "pointer", "foo_1"]
    assert one(spark, T.tokenize(F.col("s"), True), s="The cat") == ["the", "cat"]
    assert one(spark, T.tokenize(F.col("s")), s=None) == []
    assert one(spark, T.normalize_label(F.col("s")), s="In  Progress!") == "in_progress"
    assert one(spark, T.normalize_label(F.col("s")), s=" ! ") is None


def test_ngrams(spark):
    assert sorted(one(spark, T.char_ngrams(F.col("s")), s="abcd")) == ["abc", "bcd"]
    assert one(spark, T.char_ngrams(F.col("s")), s="ab") == ["ab"]
    assert one(spark, T.char_ngrams(F.col("s")), s=None) == []


def test_set_measures(spark):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3
    assert one(spark, T.overlap_ratio(F.col("a"), F.col("b")), a=["x", "y"], b=["y"]) == 1
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=["y"]) == 0


def test_scores(spark):
    assert one(spark, T.squash(F.col("s")), s=8.0) == 0.5
    assert one(spark, T.normalize_seed(F.col("s")), s=-0.5) == 0.25
    assert one(spark, T.normalize_seed(F.col("s")), s=12.0) == 0.5
    assert one(spark, T.sigmoid(F.col("s")), s=0.0) == 0.5
    assert one(spark, T.binary_match(F.col("a"), F.col("b")), a="", b="") == 0
    assert one(spark, T.length_ratio(F.col("a"), F.col("b")), a=2, b=4) == 0.5


def test_references(spark):
    assert one(spark, T.issue_reference(F.col("s")), s=" PAY-15 ") == 15
    assert one(spark, T.issue_reference(F.col("s")), s="gamma") >= 0
    assert one(spark, T.issue_reference(F.col("s")), s="  ") is None
