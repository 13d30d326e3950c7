"""Small document tables with the awkward cases every operator must stand."""
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ("sha", "copy", "mix", "mix_key", "nth", "length", "span", "Kept", "hash", "bucket")
PROSE = ("The keeper walked along the shore before dawn and counted eleven boats, though only nine had gone out the evening before. "
         "Nobody in the village could say where the other two came from, nor why their sails were dry after such a night of rain.")


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]); extra: columns whose names operators use inside."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOC)
    for name in CLASHING if extra else ():
        df = df.selectExpr("*", f"concat('x', doc_id) AS `{name}`")
    return df


def awkward(spark, extra=True):
    long = " ".join(f"word{i} {PROSE[:i % 90]}" for i in range(3000))
    return documents(spark, [
        (1, None), (2, ""), (3, "   \n\t "), (4, PROSE, "en", "a"), (4, PROSE, "en", "a"), (5, PROSE, "en", "a"), (6, PROSE.lower(), "en", "b"),
        (None, PROSE, None, None), (None, None, None, None), (7, long, "en", "b"), (8, "één 😀 ŝtrange spaces", "xx", "\U0001F600"), (9, "x" * 70_000, None, "b"),
    ], extra)
