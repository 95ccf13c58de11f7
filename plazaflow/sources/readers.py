"""Readers of the formats that city data come in, all with explicit schemas, and the writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("x_cm", "y_cm", "z_cm")]
    + [T.StructField("cls", T.ByteType()), T.StructField("inten", T.ShortType()), T.StructField("name", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("chunk", T.StringType())]
)


def jobs_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, gzip included; only columns whose name starts with C or S and keys are read as numbers."""
    df = spark.read.csv(path, header=True)
    counts = [c for c in df.columns if c[:1] in "CS"]
    return df.select(*columns, *(F.col(c).try_cast("int").alias(c) for c in counts))


def estimates_table(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """A pipe-delimited table: blanks and ``null`` are null, only estimate columns (``_E``) and the key stay."""
    df = spark.read.csv(path, header=True, sep="|", nullValue="null", emptyValue=None)
    names = [c for c in df.columns if "_E" in c]
    out = df.select(df.columns[0], *(F.when(F.trim(c) != "", F.col(c)).try_cast("double").alias(c) for c in names))
    return out.where(keep) if keep is not None else out


def padded_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table whose headers and values are padded with blanks."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns))


def json_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """An object of objects as rows (key, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")))


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON features as (props, rings); geometry that is no polygon of three points at least is dropped."""
    shape = f"struct<features:array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    rings = F.filter(F.transform("f.geometry.coordinates", ring), lambda r: F.size(r) >= 3)
    return rows.where("f.geometry.type = 'Polygon'").select(F.col("f.properties").alias("props"), rings.alias("rings")).where(F.size("rings") > 0)


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def dictionary_points(df: DataFrame, strings: str, indices: str, name: str) -> DataFrame:
    """Rows of dictionary-encoded attributes, decoded: one row an index."""
    return df.select("*", F.posexplode(indices).alias("at", "_i")).withColumn(name, F.try_element_at(strings, F.col("_i") + 1)).drop("_i", strings, indices)


def decoded_points(points: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Metres from centimetres in the viewer's frame (x east, y up, z south), intensity cut at 255."""
    return points.select("*", (F.col("x_cm") * 0.01 - origin[0]).alias("x"), (F.col("z_cm") * 0.01).alias("y"), (origin[1] - F.col("y_cm") * 0.01).alias("z")).withColumn("inten", F.least("inten", F.lit(255)))


def points_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], side: float) -> DataFrame:
    """Points of a table partitioned by chunk ``i_j`` within a box: the box names the chunks, so others are never listed."""
    x0, y0, x1, y1 = box
    chunks = [f"{i}_{j}" for i in range(int(x0 // side), int(x1 // side) + 1) for j in range(int(y0 // side), int(y1 // side) + 1)]
    x, y = F.col("x_cm") * 0.01, F.col("y_cm") * 0.01
    return spark.read.parquet(path).where(F.col("chunk").isin(chunks) & (x >= x0) & (x < x1) & (y >= y0) & (y < y1))


def write_chunks(points: DataFrame, path: str, order: str) -> None:
    """Points by chunk, sorted so that a prefix is a limit; a rewrite replaces only the chunks it has."""
    sorted_ = points.repartition("chunk").sortWithinPartitions("chunk", order)
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def remapped_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Dense codes, from 0, of the values in use, in their order; the dictionary is aggregated before it is joined."""
    from pyspark.sql import Window

    used = df.groupBy(column).agg(F.count("*").alias("_n"))
    codes = used.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(code))
    return df.join(codes, column)


def write_if_changed(new: DataFrame, path: str, ignore: list[str]) -> bool:
    """Writes a table unless the stored one holds the same rows, volatile columns aside. Says whether it wrote."""
    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        old = spark.read.parquet(path).drop(*ignore)
        mine = new.drop(*ignore)
        if old.columns == mine.columns and old.exceptAll(mine).isEmpty() and mine.exceptAll(old).isEmpty():
            return False
    new.write.mode("overwrite").parquet(path)
    return True
