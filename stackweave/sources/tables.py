"""Text tables of particle picking and defocus estimation: read and written by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fields_of(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def line_windows(texts: DataFrame, key: str, text: str, header: Column) -> DataFrame:
    """key, line, value, head: the lines of each text with the number of the last header line up to them; ``header`` is a
    condition on value. Lines before the first header are left out, and so are null texts."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("head", F.last(F.when(header, F.col("line")), ignorenulls=True).over(so_far)).filter("head is not null")


def read_star(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line, fields map<string,string>: a file's header names its columns, so files of different columns mix.

    A file is one row until its lines are split: such files list the particles of one micrograph, a few megabytes at most."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    names = F.regexp_extract_all("value", F.lit(r"(?m)^_(\S+)"), 1)
    lines = whole.select("path", names.alias("names"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    data = lines.filter(~F.col("value").rlike(r"^\s*(_|#|data_|loop_|$)"))
    values = fields_of(F.col("value"))
    n = F.least(F.size("names"), F.size(values))
    return data.select("path", "line", F.map_from_arrays(F.slice("names", 1, n), F.slice(values, F.lit(1), n)).alias("fields"))


def star_lines(particles: DataFrame, columns: list[str]) -> DataFrame:
    """value: a data line for each particle, columns in the given order; ``star_header`` goes before them."""
    return particles.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))


def star_header(columns: list[str]) -> str:
    return "\n".join(["", "data_", "", "loop_", *(f"_{c} #{k}" for k, c in enumerate(columns, 1))])


def read_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, x, y, w, h, fom (null where a line has four numbers); other lines are left out."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), fields_of(F.col("value")).alias("f"))
    number = lambda k: F.expr(f"try_cast(get(f, {k}) as double)")
    cols = [number(k).alias(c) for k, c in enumerate(("x", "y", "w", "h", "fom"))]
    return line.select("path", *cols).dropna(subset=["x", "y", "w", "h"])


def inside(boxes: DataFrame, ny: int, nx: int) -> DataFrame:
    """Boxes that lie in the frame whole, with their centres."""
    kept = boxes.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= nx) & (F.col("y") + F.col("h") <= ny))
    return kept.withColumns({"centre_x": F.col("x") + F.col("w") / 2, "centre_y": F.col("y") + F.col("h") / 2})


def read_ctf_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, defocus_u, defocus_v, angle, fom of the line that ends in "Final Values"; files without it give no row."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("value").rlike(r"Final\s+Values\s*$"))
    f = fields_of(F.col("value"))
    return line.select("path", *(F.get(f, k).try_cast("double").alias(c) for k, c in enumerate(("defocus_u", "defocus_v", "angle", "fom"))))


def read_validated_ctf_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, defocus_u, defocus_v, angle, fom, final_resolution, bfactor and validation, an array of (band, values, score) of
    logs whose last cycle is followed by a validation block. Files without a last cycle give no row.

    Of the last cycle the fourth line begins with defocus and figure of merit, the sixth has the resolution as its seventh
    word and the seventh the B-factor as its fourth; of the validation block each line from the third on names a band."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("ls"))
    places = lambda mark: F.transform(F.filter(F.transform("ls", lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: s["x"].contains(mark)), lambda s: s["k"])
    at = whole.withColumn("cycle", F.array_max(places("LAST CYCLE"))).filter("cycle >= 0")
    at = at.withColumn("check", F.array_min(F.filter(places("VALIDATION"), lambda k: k > F.col("cycle"))))
    words = lambda k: fields_of(F.get("ls", F.col("cycle") + k))
    number = lambda c: c.try_cast("double")
    block = F.when(F.col("check").isNotNull(), F.slice("ls", F.col("check") + 3, F.size("ls"))).otherwise(F.array().cast("array<string>"))
    lines = F.filter(block, lambda x: F.size(fields_of(x)) >= 6)
    bands = F.transform(lines, lambda x: F.struct(F.get(fields_of(x), 0).alias("band"), F.transform(F.slice(fields_of(x), 2, 4), number).alias("values"), number(F.element_at(fields_of(x), -1)).alias("score")))
    head = [number(F.get(words(3), k)).alias(n) for k, n in enumerate(("defocus_u", "defocus_v", "angle", "fom"))]
    return at.select("path", *head, number(F.get(words(5), 6)).alias("final_resolution"), number(F.get(words(6), 3)).alias("bfactor"), bands.alias("validation"))


def read_shift_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line, values array<double>: the number lines of white-space separated tables; comments (#) and other lines go."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    values = F.transform(fields_of(F.col("value")), lambda v: v.try_cast("double"))
    return whole.filter(~F.col("value").rlike(r"^\s*(#|$)")).select("path", "line", values.alias("values")).filter(~F.exists("values", lambda v: v.isNull()))


def ctf_lines(records: DataFrame) -> DataFrame:
    """value: for each record the three lines of a defocus log that ``read_ctf_logs`` reads back, as one text."""
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    head = F.lit("CS[mm], HT[kV], AmpCnst, XMAG, DStep[um]")
    optics = F.concat_ws(" ", *(number(c) for c in ("spherical_aberration", "voltage", "amplitude_contrast", "magnification", "detector_pixel_size")))
    result = F.concat_ws(" ", *(number(c) for c in ("defocus_u", "defocus_v", "angle", "fom")), F.lit("Final Values"))
    return records.select(F.concat_ws("\n", head, optics, result).alias("value"))


def merged_particles(particles: DataFrame, ctf: DataFrame) -> DataFrame:
    """particles(micrograph_name, ...) with the columns of ctf(micrograph, ...), found by the micrograph's basename or, without
    its "_filt" ending, by that; particles of micrographs without a record are left out."""
    from ..operators.lookup import basename, lookup

    name = basename(F.col("micrograph_name"))
    return lookup(particles, ctf.withColumn("micrograph", basename(F.col("micrograph"))), "micrograph", name, F.regexp_replace(name, "_filt$", "")).drop("micrograph")


def read_drift_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, frame, ty, tx: the drifts of a file's last stretch of lines "... shift: x y", negated and centred. Where a line
    "Sum Frame #000 - #NNN" stands, the NNN + 1 lines after it are the drifts, and their last two numbers are x and y."""
    pattern = r"(?i)shift[^:=]*[:=]\s*(-?[0-9.]+)[\s,]+(-?[0-9.]+)"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    marked = F.split("value", r"Sum Frame #000[^\n]*\n")
    n = F.regexp_extract("value", r"Sum Frame #000\D+(\d{3})", 1)
    summed = F.when(F.size(marked) > 1, F.slice(F.split(F.get(marked, 1), r"\r?\n"), F.lit(1), F.coalesce(n.try_cast("int"), F.lit(0)) + 1))
    numbers = F.transform(summed, lambda line: F.regexp_extract_all(line, F.lit(r"([+-]?\d+\.\d+)"), F.lit(1)))
    from_sum = F.transform(F.filter(numbers, lambda v: F.size(v) >= 2), lambda v: F.struct(F.element_at(v, -2).alias("x"), F.element_at(v, -1).alias("y")))
    plain = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), 1).alias("x"), F.regexp_extract_all("value", F.lit(pattern), 2).alias("y"))
    both = F.coalesce(from_sum, plain)
    each = whole.select("path", F.posexplode(both).alias("frame", "s")).select("path", "frame", (-F.col("s.y").cast("double")).alias("ty"), (-F.col("s.x").cast("double")).alias("tx"))
    of_file = Window.partitionBy("path")  # a file has a line for each frame
    return each.withColumns({c: F.col(c) - F.avg(c).over(of_file) for c in ("ty", "tx")})
