"""File, case-set, structured-output and manifest readers. Bad input stays a row with an error code."""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 10 << 20
# Extensions decoded here and extensions whose blocks are extracted elsewhere.
TEXT_EXTENSIONS = ("md", "markdown", "txt")
BINARY_EXTENSIONS = ("pdf", "docx")


def classify_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Route (path, length, content) rows; only name, size and the first bytes decide."""
    name = F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    head = F.substring(F.col("content"), 1, 4)
    signature = F.when(ext == "pdf", head == F.lit(b"%PDF")).when(
        ext == "docx", F.substring(F.col("content"), 1, 2) == F.lit(b"PK")
    )
    error = (
        F.when(~ext.isin(*TEXT_EXTENSIONS, *BINARY_EXTENSIONS), "UNSUPPORTED_DOCUMENT_TYPE")
        .when(F.col("length") == 0, "EMPTY_FILE")
        .when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
    )
    return files.select(
        "path", name.alias("filename"), ext.alias("ext"), F.col("length").alias("size"), signature.alias("signature_ok"),
        error.alias("error_code"),
        F.when(error.isNull(), F.sha2(F.col("content"), 256)).alias("sha256"),
        F.when(error.isNull(), F.col("content")).alias("bytes"),
    )


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """SRC-1: whole files of a folder tree, read in parallel by executors.

    Names and sizes are judged before any content is loaded: only files of known extensions with 1 to ``max_bytes`` bytes are
    opened (a glob and a filter that the reader takes itself); the others come from the listing alone, without signature and bytes. Spark's reader passes over files of no bytes; a table of
    uploads with such rows gets their error from ``classify_files``.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    either_case = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    named = "*.{" + ",".join(map(either_case, (*TEXT_EXTENSIONS, *BINARY_EXTENSIONS))) + "}"
    fits = F.col("length").between(1, max_bytes)
    opened = source.option("pathGlobFilter", named).load(path).where(fits).select("path", "length", "content")
    known = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*TEXT_EXTENSIONS, *BINARY_EXTENSIONS)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where(~(known & fits))
    return classify_files(opened.unionByName(listed.withColumn("content", F.lit(None).cast("binary"))), max_bytes)


@F.pandas_udf(T.StringType())
def _gb18030(raw: pd.Series) -> pd.Series:
    def one(value):
        try:
            return None if value is None else bytes(value).decode("gb18030")
        except UnicodeDecodeError:
            return None
    return raw.map(one)


def decode_text(df: DataFrame, column: str = "bytes") -> DataFrame:
    """SRC-2: utf-8 (byte-order mark dropped), else gb18030, else an error code; rows without bytes stay, without text.

    One pass; only bytes that are no UTF-8 cross to Python.
    """
    base = df.withColumnRenamed(column, "bytes") if column != "bytes" else df
    utf8 = F.is_valid_utf8(F.col("bytes").cast("string"))
    decoded = F.decode(F.when(utf8, F.col("bytes")), "UTF-8")
    bom = F.startswith(decoded, F.lit("\ufeff"))
    rows = base.withColumn("_gb", _gb18030(F.when(~utf8, F.col("bytes"))))
    text = F.when(utf8, F.when(bom, F.substring(decoded, 2, 1 << 30)).otherwise(decoded)).otherwise(F.col("_gb"))
    return rows.select(
        *base.columns, text.alias("text"),
        F.when(utf8, F.when(bom, "utf-8-sig").otherwise("utf-8")).when(F.col("_gb").isNotNull(), "gb18030").alias("encoding"),
        F.when(F.col("bytes").isNotNull() & ~utf8 & F.col("_gb").isNull(), "DOCUMENT_ENCODING_UNSUPPORTED").alias("decode_error"))


def read_cases(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """SRC-3: JSON lines with a declared schema; a bad line, an empty set or a repeated id fails the read."""
    cases = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return require_unique(cases, "case_id")


def require_unique(cases: DataFrame, key: str) -> DataFrame:
    check = cases.groupBy(key).count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("m")).first()
    if check["n"] == 0:
        raise ValueError("case set is empty")
    if check["m"] > 1:
        raise ValueError(f"case set repeats a {key}")
    return cases


def _has_unknown_keys(raw: Column, kind: T.DataType) -> Column:
    """Whether JSON text has keys that its type doesn't declare, at any level."""
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.ArrayType, T.StructType)):
            return F.lit(False)
        return F.coalesce(F.exists(F.from_json(raw, "array<string>"), lambda e: _has_unknown_keys(e, kind.elementType)), F.lit(False))
    if not isinstance(kind, T.StructType):
        return F.lit(False)
    own = F.size(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(f.name) for f in kind.fields]).cast("array<string>"))) > 0
    inner = [_has_unknown_keys(F.get_json_object(raw, f"$['{f.name}']"), f.dataType) for f in kind.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    return reduce(lambda a, b: a | b, inner, F.coalesce(own, F.lit(False)))


def parse_structured(df: DataFrame, column: str, schema: T.StructType, required: list[str] | None = None,
                     valid: Column | None = None) -> DataFrame:
    """SRC-4: JSON text to a typed struct, or exactly one of two error codes.

    Unknown keys at any level, missing required keys, a wrong type, or a false cross-field rule break the schema.
    """
    raw = F.col(column)
    keys = F.json_object_keys(raw)
    # The JSON readers stop after the first value; wrapping the text both ways exposes trailing garbage.
    syntax = (
        (F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1)
        & (F.size(F.json_object_keys(F.concat(F.lit('{"v":'), raw, F.lit("}")))) == 1)
    )
    needed = F.array(*[F.lit(n) for n in (required or [])]).cast("array<string>")
    corrupt = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    parsed = F.from_json(raw, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed).withColumn("_keys", keys)
    shape = (
        F.col("_keys").isNotNull() & F.col("_p._bad").isNull()
        & ~_has_unknown_keys(raw, schema) & (F.size(F.array_except(needed, F.col("_keys"))) == 0)
    )
    out = out.withColumn("value", F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]))
    ok = F.coalesce(shape & (valid if valid is not None else F.lit(True)), F.lit(False))
    code = F.when(~F.coalesce(syntax, F.lit(False)), "invalid_json").when(~ok, "schema_validation_failed")
    return (
        out.withColumn("error_code", code).withColumn("value", F.when(F.col("error_code").isNull(), F.col("value")))
        .drop("_p", "_keys")
    )


ENTRY_SCHEMA = "array<struct<term:string,aliases:array<string>,business_domain:string,term_type:string,frequency:int>>"


def explode_manifest(df: DataFrame, column: str = "manifest") -> DataFrame:
    """SRC-5: manifest JSON list to entry rows; anything else raises when the row is read."""
    text = F.btrim(F.col(column), F.lit(" \t\r\n"))
    entries = F.from_json(text, ENTRY_SCHEMA, {"mode": "FAILFAST"})
    checked = F.when(F.startswith(text, F.lit("[")), entries).otherwise(
        F.raise_error(F.lit("dictionary manifest must be a JSON list")).cast(ENTRY_SCHEMA)
    )
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(checked).alias("position", "_e")).select(*rest, "position", "_e.*")
