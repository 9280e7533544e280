"""S5. Grids of ``.cube`` colour lookup tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import RowNumber, Timeline

# Fixed values
MINIMUM_SIZE, MAXIMUM_SIZE = 2, 256


def _triple(words: Column) -> Column:
    numbers = F.transform(words, lambda word: word.try_cast("double"))
    return F.when((F.size(words) == 3) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def _lines(luts: DataFrame, lut: str, text: str) -> DataFrame:
    """Non-empty lines with their keyword (null for a table row)."""
    lines = luts.select(lut, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "__raw"))
    lines = lines.withColumn("__line", F.regexp_replace("__raw", r"^\s+|\s+$", "")).where(
        (F.col("__line") != "") & ~F.col("__line").startswith("#"))
    words = F.split("__line", r"\s+")
    return lines.select(
        lut, "line_no", "__line", words.alias("__words"),
        F.when(F.col("__line").rlike(r"^\p{IsAlphabetic}"), F.regexp_extract("__line", r"^([^ ]*)", 1)).alias("__keyword"))


def lut_headers(luts: DataFrame, lut: str, text: str) -> DataFrame:
    """Size, input domain and status of each table: ok, or the code of its first problem."""
    lines = _lines(luts, lut, text)

    def keyword(name):
        return F.col("__keyword") == name

    argument = F.element_at("__words", 2)
    triple = _triple(F.slice("__words", 2, F.size("__words")))
    size = F.when(F.size("__words") == 2, argument.try_cast("int"))
    row = F.col("__keyword").isNull()
    problem = (
        F.when(keyword("LUT_3D_SIZE") & ~F.coalesce(size.between(MINIMUM_SIZE, MAXIMUM_SIZE), F.lit(False)), "size-invalid")
        .when(keyword("LUT_1D_SIZE"), "one-dimensional")
        .when((keyword("DOMAIN_MIN") | keyword("DOMAIN_MAX")) & triple.isNull(), "domain-invalid")
        .when(row & _triple(F.col("__words")).isNull(), "row-invalid"))
    at = F.col("line_no")
    found = lines.groupBy(lut).agg(
        F.min(F.when(problem.isNotNull(), F.struct(at, problem.alias("code"))))["code"].alias("__first"),
        F.max_by(size, F.when(keyword("LUT_3D_SIZE"), at)).alias("size"),
        F.max_by(triple, F.when(keyword("DOMAIN_MIN"), at)).alias("__low"),
        F.max_by(triple, F.when(keyword("DOMAIN_MAX"), at)).alias("__high"),
        F.count_if(row).alias("rows"))
    headers = luts.select(lut).join(found, lut, "left").select(
        lut, "size", F.coalesce("rows", F.lit(0)).alias("rows"), "__first",
        F.coalesce("__low", F.array(*[F.lit(0.0)] * 3)).alias("domain_min"),
        F.coalesce("__high", F.array(*[F.lit(1.0)] * 3)).alias("domain_max"))
    inverted = F.exists(F.arrays_zip("domain_min", "domain_max"), lambda z: z["domain_max"] <= z["domain_min"])
    status = (
        F.when(F.col("__first").isNotNull(), F.col("__first")).when(F.col("size").isNull(), "size-missing")
        .when(F.col("rows") != F.col("size") * F.col("size") * F.col("size"), "row-count")
        .when(inverted, "domain-invalid").otherwise("ok"))
    return headers.withColumn("lut_status", status).drop("__first")


def read_lut(luts: DataFrame, lut: str, text: str) -> DataFrame:
    """Grid points of the valid tables: (lut, r, g, b, out_r, out_g, out_b), red varying fastest."""
    headers = lut_headers(luts, lut, text).where("lut_status = 'ok'").select(lut, "size")
    rows = _lines(luts, lut, text).where(F.col("__keyword").isNull()).select(lut, "line_no", _triple(F.col("__words")).alias("__out"))
    numbered = Timeline(rows, lut, "line_no").scan(__n=RowNumber()).df.join(headers, lut)
    n, size = F.col("__n") - 1, F.col("size")
    return numbered.select(
        lut, (n % size).cast("int").alias("r"), (F.floor(n / size) % size).cast("int").alias("g"),
        F.floor(n / (size * size)).cast("int").alias("b"),
        *[F.col("__out")[i].alias(f"out_{c}") for i, c in enumerate("rgb")])
