"""Reading raw files and named relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foresail.session import checkpointed

# The raw files of the retail data set and their column types.
RAW_SCHEMAS = {
    "train": "id long, date date, store_nbr long, item_nbr long, unit_sales double, onpromotion string",
    "test": "id long, date date, store_nbr long, item_nbr long, onpromotion string",
    "stores": "store_nbr long, city string, state string, type string, cluster long",
    "items": "item_nbr long, family string, class long, perishable long",
    "transactions": "date date, store_nbr long, transactions long",
    "oil": "date date, dcoilwtico double",
    "holidays_events": "date date, type string, locale string, locale_name string, "
    "description string, transferred boolean",
}

LOAD_MODES = {"replace": "overwrite", "append": "append", "empty": "errorifexists"}


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A named Parquet relation; column pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record: the text of every record below the header, line ends inside quotes kept.

    Files are read in ranges by as many tasks as Spark likes. A range begins inside
    quotes if the ranges before it hold an odd number of them, so the quotes of each
    range are counted first and the parities combined in order, one row a range. From
    there every line of a range knows whether it begins and ends a record. Records of one
    line, nearly all, stay where they are; only the lines of longer ones are brought
    together, by the number of the record that they belong to. A file whose quotes do not
    come out even is an error.
    """
    raw = spark.read.text(path, lineSep="\n")
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    odd = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    in_order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = checkpointed(odd.withColumn("open", F.coalesce(F.sum("odd").over(in_order), F.lit(0)) % 2))
    left_open = ranges.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").first()
    if left_open:
        raise ValueError(f"a quote is never closed in {left_open.file}")

    by_line = Window.partitionBy("file", "block").orderBy("pos")
    earlier = F.coalesce(F.sum("quotes").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(ranges.select("file", "block", "open"), ["file", "block"])
    lines = lines.withColumn("inside", (F.col("open") + earlier) % 2 == 1)
    lines = lines.withColumn("goes_on", (F.col("open") + earlier + F.col("quotes")) % 2 == 1)
    header = ~F.col("inside") & (F.col("block") == 0) & (F.row_number().over(by_line) == 1)
    lines = lines.withColumn("header", header)
    whole = lines.filter(~F.col("inside") & ~F.col("goes_on") & ~F.col("header")).select("line")

    # several lines: numbered by the starts before them, in the range and in earlier ones
    parts = lines.filter(F.col("inside") | F.col("goes_on"))
    starts = F.when(~F.col("inside"), 1).otherwise(0)
    ahead = parts.groupBy("file", "block").agg(F.sum(starts).alias("n"))
    ahead = ahead.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).drop("n")
    number = F.col("before") + F.sum(starts).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.join(ahead, ["file", "block"]).withColumn("number", number)
    joined = parts.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "pos", "line"))).alias("lines"), F.max("header").alias("header")
    )
    joined = joined.filter(~F.col("header")).select(F.array_join("lines.line", "\n").alias("line"))
    out = whole.unionByName(joined).select(F.regexp_replace("line", "\r$", "").alias("record"))
    return out.filter(F.col("record") != "")


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Raw CSV with header and quoted newlines; the schema is declared, by position.

    Not-a-number and infinite readings become NULL on the way in.
    """
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_csv("record", kinds.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"'})
    df = csv_records(spark, path).select(parsed.alias("row")).select("row.*")
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: finite(c) for c in doubles}) if doubles else df


def finite(column: str):
    value = F.col(column)
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def load_csv_tables(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    schemas: Mapping[str, str] = RAW_SCHEMAS,
    only: Sequence[str] | None = None,
    mode: str = "replace",
    prefix: str = "raw_",
) -> dict[str, str]:
    """Load every known CSV of a folder into one Parquet relation each.

    A CSV is a file, or a folder of files with one header each, whose name ends in
    ``.csv``. One whose stem has no declared schema is skipped. Returns the relation
    written per stem. The folder is listed through Spark's file system, so any store the
    cluster mounts will do.
    """
    if mode not in LOAD_MODES:
        raise ValueError(f"mode must be one of {sorted(LOAD_MODES)}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source_dir)
    listing = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    paths = [str(f.getPath().toString()) for f in listing]
    stems = {p.rsplit("/", 1)[-1][: -len(".csv")]: p for p in paths if p.endswith(".csv")}
    chosen = [s for s in sorted(stems) if s in schemas and (only is None or s in only)]
    unknown = sorted(set(only or []) - set(stems))
    if unknown:
        raise ValueError(f"requested tables have no file: {unknown}")
    written = {}
    for stem in chosen:
        target = f"{target_dir}/{prefix}{stem}"
        read_csv(spark, stems[stem], schemas[stem]).write.mode(LOAD_MODES[mode]).parquet(target)
        written[stem] = target
    return written
