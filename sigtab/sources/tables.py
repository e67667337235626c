"""Reading and writing tables, header and type clean-up, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = [",", "\t", ";", "|"]
REJECTED = "_rejected_line"
# bytes that code page 874 leaves undefined, as latin-1 characters
NOT_CP874 = "[\u0081-\u0084\u0086-\u0090\u0098-\u009fÛ-Þü-ÿ]"


def text_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 when every line is valid, else code page 874 when every byte is defined there, else latin-1."""
    lines = spark.read.text(path)
    checks = lines.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("not_utf8"),
        F.count_if(F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(NOT_CP874)).alias("not_thai"),
    ).first()
    if not checks["not_utf8"]:
        return "UTF-8"
    return "ISO-8859-1" if checks["not_thai"] else "cp874"


def _thai(texts: list[str] | None = None, column: Column | None = None):
    """Characters read as latin-1 turned into those of code page 874."""
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp874", "ignore")) for b in range(0x80, 0x100)]
    pairs = [(a, b) for a, b in pairs if b]
    if column is not None:
        return F.translate(column, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return [t.translate({ord(a): b for a, b in pairs}) for t in texts]


def split_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                schema=None) -> tuple[DataFrame, DataFrame]:
    """The rows of delimited text with a header, and the rejected lines (``line``): those with fewer or more fields than the header or,
    under ``schema``, with a value of another type. The separator follows the extension or the header line; no row limit applies.
    Give ``schema`` to spare the type pass. Every line is in one of the two tables, whatever columns are selected."""
    if sep is None:
        head = spark.read.text(path).first()
        line = head["value"] if head else ""
        sep = "\t" if path.lower().endswith(".tsv") else max(DELIMITERS, key=line.count)
    encoding = encoding or text_encoding(spark, path)
    thai = encoding.lower() in ("cp874", "x-windows-874")
    reader = (
        spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnPruning", False)
        .option("columnNameOfCorruptRecord", REJECTED).option("encoding", "ISO-8859-1" if thai else encoding)
    )
    kinds = reader.csv(path).schema if schema is None else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not kinds.fields:
        return reader.schema(kinds).csv(path), spark.createDataFrame([], "line string")
    whole = reader.schema(T.StructType([*kinds.fields, T.StructField(REJECTED, T.StringType())])).csv(path)
    # Spark refuses to read the rejected lines alone, so both tables look at a second column
    read = F.length(F.coalesce(F.col(f"`{kinds.fields[0].name}`").cast("string"), F.lit(""))) >= 0
    raw = whole.where(F.col(REJECTED).isNull() & read).drop(REJECTED)
    line = F.col(REJECTED)
    bad = whole.where(line.isNotNull() & read).select((_thai(column=line) if thai else line).alias("line"))
    if thai:
        raw = raw.toDF(*_thai(raw.columns))
        raw = raw.withColumns({f.name: _thai(column=F.col(f"`{f.name}`")) for f in raw.schema.fields if isinstance(f.dataType, T.StringType)})
    if schema is not None:
        return raw, bad
    return infer_types(raw.toDF(*clean_header([c.lstrip("\ufeff") for c in raw.columns]))), bad


def read_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
               schema=None) -> DataFrame:
    """The rows of ``split_table``, without the rejected lines."""
    return split_table(spark, path, sep, encoding, schema)[0]


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as top-level columns with dotted names."""
    def leaves(kind, path):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + [f.name])
            else:
                yield path + [f.name]

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, [])
    ])


def columns_to_rows(df: DataFrame) -> DataFrame:
    """A record whose fields are equally long arrays becomes one row per position."""
    names = df.columns
    zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in names])
    return df.select(F.inline(zipped)).toDF(*names)


def read_json(spark: SparkSession, path: str, multi_line: bool = True, schema=None) -> DataFrame:
    """Records, or one object of equally long lists; nested objects become dotted names.

    ``multi_line=False`` reads one record per line, which splits large files over tasks.
    """
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema else reader).json(path)
    fields = df.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields):
        sizes = [F.size(F.col(f"`{f.name}`")) for f in fields]
        uneven = F.greatest(*sizes) != F.least(*sizes) if len(sizes) > 1 else F.lit(False)
        if df.filter(uneven).isEmpty():
            return columns_to_rows(df)
    return flatten(df)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema=None) -> DataFrame:
    """Flat row-oriented XML."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write CSV, Parquet or JSON; one folder per value of ``partition_by``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("parquet", "json"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown output kind: {kind}")


def clean_header(names: list) -> list[str]:
    """Blank names become ``column_k``; repeats get ``_2``, ``_3`` and so on."""
    out: list[str] = []
    count: dict[str, int] = {}
    for position, raw in enumerate(names, start=1):
        base = str(raw).strip() if raw is not None else ""
        base = base or f"column_{position}"
        name = base
        while name in out:
            count[base] = count.get(base, 1) + 1
            name = f"{base}_{count[base]}"
        out.append(name)
    return out


def _plain(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text != "", text)


def _as_number(text: Column) -> Column:
    return F.replace(text, F.lit(",")).try_cast("double")


def infer_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Text columns of which at least ``share`` parse become double, else timestamp by the same rule.

    One aggregate over the table decides all columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, name in enumerate(names):
        text = _plain(F.col(f"`{name}`"))
        aggs += [F.count(text).alias(f"t{i}"), F.count(_as_number(text)).alias(f"n{i}"),
                 F.count(text.try_cast("timestamp")).alias(f"d{i}")]
    seen = df.agg(*aggs).first()
    kinds = {}
    for i, name in enumerate(names):
        need = max(1, int(share * seen[f"t{i}"]))
        if seen[f"t{i}"]:
            kinds[name] = "double" if seen[f"n{i}"] >= need else "timestamp" if seen[f"d{i}"] >= need else "string"
    out = []
    for name in df.columns:
        text = _plain(F.col(f"`{name}`").cast("string")) if name in kinds else F.col(f"`{name}`")
        if kinds.get(name) == "double":
            text = _as_number(text)
        elif kinds.get(name) == "timestamp":
            text = text.try_cast("timestamp")
        out.append(text.alias(name))
    return df.select(*out)


def set_column_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Declared types ``String Integer Float Datetime Auto``; a value that does not parse is null."""
    cast = {"String": "string", "Integer": "bigint", "Float": "double", "Datetime": "timestamp"}
    wanted = {c: cast[k] for c, k in kinds.items() if c in df.columns and k in cast}
    return df.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in wanted.items()})


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: schema hash, row count and an order-insensitive hash of the values.

    Hashes are folded by xor and by a wrapping sum, so equal rows do not cancel out.
    """
    columns = sorted(df.columns)
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000null")) for c in columns])
    names = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    ).withColumn("schema_hash", F.sha2(F.lit(names), 256)).withColumn("columns", F.lit(len(columns)))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, columns and fingerprint of two versions side by side, and whether anything changed."""
    parts = []
    for which, df in (("old", old), ("new", new)):
        parts.append(fingerprint(df).select(
            F.lit(0).alias("_k"), *[F.col(c).alias(f"{which}_{c}") for c in
                                    ("rows", "columns", "hash_xor", "hash_sum", "schema_hash")]))
    both = parts[0].join(parts[1], "_k").drop("_k")
    same = F.lit(True)
    for c in ("rows", "columns", "hash_xor", "hash_sum", "schema_hash"):
        same = same & (F.col(f"old_{c}") == F.col(f"new_{c}"))
    return both.withColumn("changed", ~same)


def unit_metadata(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Store units of measurement in the column metadata."""
    return df.select(*[
        F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, "unit": units[c]}) if c in units else F.col(f"`{c}`")
        for c in df.columns
    ])
