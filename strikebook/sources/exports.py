"""Exchange exports: delimited files, annex, domain files, and which file is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_export(spark: SparkSession, path: str, columns: list[tuple[str, int, str]], least: int, header: str) -> DataFrame:
    """A ``;`` export with an optional stamp line and a header.

    ``columns`` lists (name, position, kind), kind being text, int or flag. Rows with fewer than
    ``least`` cells are dropped, cells trimmed, blanks null; a bad number reads 0 and S or SIM
    reads true. ``as_of`` is the stamp of the row's own file; of several stamp lines, the least.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    stamp = F.trim("value").rlike(r"^\d{8}$")
    stamps = lines.filter(stamp).groupBy("_file").agg(F.min(F.trim("value")).alias("as_of"))
    cells = F.split("value", ";")
    body = lines.filter(~stamp).withColumn("_cells", cells)
    body = body.filter((F.size("_cells") >= least) & (F.trim(F.get("_cells", F.lit(0))) != header))

    def cell(position: int, kind: str) -> Column:
        text = F.nullif(F.trim(F.get("_cells", F.lit(position))), F.lit(""))
        if kind == "int":
            return F.coalesce(text.try_cast("int"), F.lit(0))
        return F.coalesce(F.upper(text).isin("S", "SIM"), F.lit(False)) if kind == "flag" else text

    # One stamp per file: a join no larger than the list of files.
    return body.join(stamps, "_file", "left").select("as_of", *[cell(i, kind).alias(name) for name, i, kind in columns])


def read_annex(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted ``;`` text with doubled quotes; cells may hold line breaks."""
    return spark.read.schema(schema).csv(
        path, sep=";", quote='"', escape='"', header=True, multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


DOMAIN_FILE = (
    "figureCode string, extends array<string>, removeSections array<string>, "
    "sections array<struct<key:string, fields:array<struct<key:string, dataType:string, "
    "options:array<struct<code:string, b3Code:string>>>>>>, "
    "rules array<struct<id:string, targets:array<string>, severity:string>>, _corrupt string"
)


def read_domain_files(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Figure files as flat section, field, option and rule tables; bad files are set apart."""
    raw = spark.read.schema(DOMAIN_FILE).json(
        path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    )
    tagged = raw.withColumn("_file", F.input_file_name())
    good = tagged.filter(F.col("figureCode").isNotNull())
    sections = good.select(F.col("figureCode").alias("figure_code"), F.posexplode("sections").alias("section_pos", "_s"))
    fields = sections.select(
        "figure_code", "section_pos", F.col("_s.key").alias("section"), F.posexplode_outer("_s.fields").alias("field_pos", "_f")
    )
    flat = fields.select(
        "figure_code", "section", "section_pos", "field_pos", F.col("_f.key").alias("key"), F.col("_f.dataType").alias("data_type"), "_f.options"
    )
    return {
        "sections": sections.select("figure_code", "section_pos", F.col("_s.key").alias("section")),
        "fields": flat.drop("options"),
        "options": flat.select("figure_code", "section", "key", F.explode("options").alias("_o")).select("figure_code", "section", "key", "_o.*"),
        "rules": good.select(F.col("figureCode").alias("figure_code"), F.explode("rules").alias("_r")).select("figure_code", "_r.*"),
        "bad": tagged.filter(F.col("figureCode").isNull()).select("_file", "_corrupt"),
    }


def newest_export(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The newest dated file of each export.

    ``files`` holds (name) like 20260828_Name.csv; ``aliases`` (export, alias, alias_rank). Names
    are compared by their upper-case letters and digits. An earlier alias beats a later one,
    then the newest stamp wins. One aggregate with map-side combine, no window over an export.
    """
    parts = files.select(
        "name",
        F.regexp_extract("name", r"^(\d{8})[_-]", 1).alias("stamp"),
        F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"^\d{8}[_-]", ""), r"\.[^.]*$", ""), r"[^\p{L}\p{Nd}]", "")).alias("_key"),
    ).filter(F.col("stamp") != "")
    keyed = aliases.withColumn("_key", F.upper(F.regexp_replace("alias", r"[^\p{L}\p{Nd}]", "")))
    matched = parts.join(keyed, "_key")
    best = F.min_by(F.struct("stamp", "name"), F.struct("alias_rank", (-F.col("stamp").cast("int")).alias("_newest"), "name"))
    return matched.groupBy("export").agg(best.alias("_best")).select("export", "_best.stamp", "_best.name")


def sync_status(exports: DataFrame, newest: DataFrame, manifest: DataFrame, allow_older: bool = False) -> DataFrame:
    """What to do per export: downloaded, current, stale (never rolled back), or missing."""
    joined = exports.join(newest.select("export", "stamp"), "export", "left").join(
        manifest.select("export", F.col("stamp").alias("held")), "export", "left"
    )
    older = F.col("stamp") < F.col("held")
    status = (
        F.when(F.col("stamp").isNull(), "missing")
        .when(F.col("held").isNull() | (F.col("stamp") > F.col("held")), "downloaded")
        .when(older & F.lit(not allow_older), "stale")
        .when(older, "downloaded")
        .otherwise("current")
    )
    return joined.withColumn("status", status)
