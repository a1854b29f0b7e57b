"""Vector text files: the line grammar as a column expression, line numbers, and the readers on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decimal or hexadecimal integer literals, decimals with exponent, and the names of infinities and NaN.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
HEX = r"^[+-]?0[xX][0-9a-fA-F]{1,15}$"
SPACE = r"[ \t\r\n\u000b\f]+"


def to_number(token: Column) -> Column:
    """The number a whole token spells, else null. ``0x10`` is sixteen; ``1d`` and ``1f`` are no numbers; out of range is null."""
    named = F.lower(F.regexp_replace(token, r"^[+-]", ""))
    sign = F.when(F.startswith(token, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    plain = token.try_cast("double")
    special = F.when(named == "nan", F.lit(float("nan"))).when(named.isin("inf", "infinity"), sign * float("inf"))
    decimal = F.when(F.abs(plain) < float("inf"), plain)
    hexa = sign * F.conv(F.regexp_replace(token, r"^[+-]?0[xX]", ""), 16, 10).try_cast("double")
    return F.when(token.rlike(HEX), hexa).when(token.rlike(NUMBER), F.coalesce(special, decimal))


def parse_vector_line(line: Column) -> Column:
    """``struct<id: string, vec: array<double>>`` of a line ``[id] f1 … fd``, null for a line that is rejected.

    If every token is a number there is no id and all are components; otherwise the first token is the id and
    the rest must be numbers, at least one. Null, empty and blank lines are rejected.
    """
    tokens = F.filter(F.split(line, SPACE), lambda t: t != "")
    numbers = F.transform(tokens, to_number)
    rest = F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0)))
    whole = (F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull())
    with_id = (F.size(rest) > 0) & F.forall(rest, lambda x: x.isNotNull())
    of = lambda i, v: F.struct(i.cast("string").alias("id"), v.alias("vec"))
    return F.when(whole, of(F.lit(None), numbers)).when(with_id, of(F.get(tokens, F.lit(0)), rest))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_idx, value)``: the lines of text files with their number in the file, from 0.

    Files are read in splits. The counts of the splits before a line's split (one row a split on the driver)
    and its place within it make the number, so there is no sort and no single task.
    """
    block = F.col("_metadata.file_block_start")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = sorted((r["file"], r["block"], r["n"], r["low"]) for r in raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect())
    start, last, total = [], None, 0
    for file, at, n, low in counts:
        total = 0 if file != last else total
        start.append((file, at, total - low))
        total, last = total + n, file
    shift = spark.createDataFrame(start, "file string, block bigint, shift bigint")  # one row a split
    shift = F.broadcast(shift) if len(start) <= 100_000 else shift
    return raw.join(shift, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_idx"), "value")


def read_vectors(spark: SparkSession, path: str, dim: int | None = None, max_base: int | None = None) -> DataFrame:
    """``(file, line_idx, id, vec)`` of the lines that parse and have ``dim`` components; others are left out.

    Without ``dim`` it is the length of each file's first accepted line. ``max_base`` takes only the lines
    numbered below it. A path without files gives an empty table.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return spark.createDataFrame([], "file string, line_idx bigint, id string, vec array<double>")
    lines = read_lines(spark, path)
    if max_base is not None:
        lines = lines.where(F.col("line_idx") < max_base)
    parsed = lines.select("file", "line_idx", parse_vector_line(F.col("value")).alias("p")).where("p IS NOT NULL").select("file", "line_idx", "p.*")
    return of_dimension(parsed, dim)


def of_dimension(parsed: DataFrame, dim: int | None) -> DataFrame:
    """Rows of ``dim`` components, or of as many as the first row of their file has."""
    if dim is not None:
        return parsed.where(F.size("vec") == dim)
    first = parsed.groupBy("file").agg(F.min_by(F.size("vec"), "line_idx").alias("dim"))
    return parsed.join(first, "file").where(F.size("vec") == F.col("dim")).drop("dim")


def from_flat(flat: DataFrame, dim: int, column: str = "flat", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep…, vec_id, embedding)``: each flat array of n * dim values as n vectors numbered from 0; a remainder is dropped."""
    n = F.floor(F.size(column) / dim).cast("int")
    rows = flat.where(n > 0).select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(column, i * dim + 1, dim))).alias("vec_id", "embedding"))
    return rows.select(*keep, F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))


def write_cache(vectors: DataFrame, path: str) -> DataFrame:
    """The parsed vectors as Parquet, written if not there yet; later reads skip the text."""
    vectors.write.mode("ignore").parquet(path)
    return vectors.sparkSession.read.parquet(path)
