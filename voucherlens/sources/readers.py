"""Inputs of an audit: transcriptions (delimited text, workbooks, JSON records), lists of images and ids, annotations, settings.

All come back as DataFrames of strings; only a file's first line or a settings file is read on the driver.
"""

from __future__ import annotations

import tomllib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# The fields of a transcription in their order, names they also go by, image types, older column names.
CORE = (
    "catalogNumber continent country stateProvince county locality verbatimCoordinates decimalLatitude decimalLongitude minimumElevationInMeters "
    "maximumElevationInMeters verbatimElevation scientificName genus specificEpithet scientificNameAuthorship family typeStatus identifiedBy "
    "dateIdentified recordedBy recordNumber verbatimEventDate eventDate habitat"
).split()
ALIASES = {
    "collectedBy": "recordedBy", "collector": "recordedBy", "collectorName": "recordedBy", "collector_name": "recordedBy",
    "collectorNumber": "recordNumber", "collector_number": "recordNumber", "collectionDate": "eventDate", "collection_date": "eventDate",
    "verbatimCollectionDate": "verbatimEventDate", "collection_date_verbatim": "verbatimEventDate", "identifiedDate": "dateIdentified", "determination_date": "dateIdentified",
    "determinedBy": "identifiedBy", "determination_by": "identifiedBy", "taxon_name": "scientificName", "taxon_author": "scientificNameAuthorship",
    "speciesNameAuthorship": "scientificNameAuthorship", "catalog_number": "catalogNumber", "location": "locality", "state_province": "stateProvince",
    "county_district": "county", "latitude": "decimalLatitude", "longitude": "decimalLongitude", "altitude": "minimumElevationInMeters",
    "altitude_m": "minimumElevationInMeters", "elevation": "minimumElevationInMeters",
}
IMAGE_TYPES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp"]
BORDER_NAMES = ["NAME", "NAME_LONG", "ADMIN", "FORMAL_EN", "NAME_SORT"]
RENAMED = {"collectedBy": "recordedBy", "collectionDate": "eventDate"}


def sniff_delimiter(line: str) -> str:
    """The likeliest of comma, tab, semicolon and pipe in a header line."""
    return max([",", "\t", ";", "|"], key=line.count)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all columns as text (007 stays 007)."""
    head = spark.read.text(path).first()
    df = spark.read.option("header", True).option("delimiter", sniff_delimiter(head[0] if head else "")).option("multiLine", True).option("escape", '"').csv(path)
    return rename_old(df)


def rename_old(df: DataFrame) -> DataFrame:
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


class WorkbookSource(DataSource):
    """format("workbook"): the first sheet of an .xlsx file, its first row as the header, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        head = next(sheet_rows(self.options["path"]), [])
        return StructType([StructField(c or f"column{i}", StringType()) for i, c in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"], len(schema))


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(self.path)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet, as texts; absent cells are None."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        with book.open(sheet) as lines:
            for _, row in ElementTree.iterparse(lines):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = 0
                    for letter in "".join(x for x in cell.get("r", "") if x.isalpha()):
                        at = at * 26 + ord(letter) - 64
                    out += [None] * (max(at, 1) - 1 - len(out))
                    value = cell.find(f"{_MAIN}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                    out.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
                yield out
                row.clear()


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return rename_old(spark.read.format("workbook").option("path", path).load())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, core map, meta JSON) of extraction records, one JSON document each: {darwin_core, meta...} or the older flat form. Records with an error are left out."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    whole = F.from_json("value", "map<string,string>")
    rows = raw.withColumn("doc", whole).where(F.col("doc").isNotNull() & F.try_element_at("doc", F.lit("error")).isNull())
    nested = F.try_element_at("doc", F.lit("darwin_core"))
    core = F.coalesce(F.from_json(nested, "map<string,string>"), F.map_filter("doc", lambda k, _: k.isin([*CORE, *ALIASES])))
    meta = F.map_filter("doc", lambda k, _: ~k.isin(["darwin_core", *CORE, *ALIASES]))
    return rows.select("file", core.alias("core"), F.to_json(meta).alias("meta"))


def core_columns(df: DataFrame, core: str = "core") -> DataFrame:
    """A map of fields as the 25 columns: aliases resolved, missing-value words emptied, a name made of genus and epithet where there is none."""
    from voucherlens.functions.text import EXTRACT_NULLS

    def value(name: str) -> Column:
        names = [name, *[a for a, c in ALIASES.items() if c == name]]
        # of several names of one field the record's last decides
        found = F.get(F.reverse(F.map_values(F.map_filter(core, lambda k, _: k.isin(names)))), 0) if len(names) > 1 else F.try_element_at(core, F.lit(name))
        return F.when(F.lower(F.trim(found)).isin(EXTRACT_NULLS), "").otherwise(F.coalesce(F.trim(found), F.lit("")))

    out = df.select("*", *[value(c).alias(c) for c in CORE])
    joined = F.trim(F.concat_ws(" ", "genus", "specificEpithet"))
    return out.withColumn("scientificName", F.when((F.col("scientificName") == "") & (F.col("genus") != ""), joined).otherwise(F.col("scientificName")))


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos) of a text list: comments, quotes and repeats dropped, drive letters mapped, the first mention's place kept."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    name = F.trim(F.regexp_replace(F.trim("line"), "^[\"']|[\"']$", ""))
    drive = F.regexp_extract(name, r"^([A-Za-z]):[\\/]", 1)
    mapped = F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.replace(F.substring(name, F.lit(4), F.length(name)), F.lit("\\"), F.lit("/")))).otherwise(name)
    rows = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#")).select(mapped.alias("path"), "pos")
    return rows.groupBy("path").agg(F.min("pos").alias("pos"))


def parse_ids(df: DataFrame, line: str) -> DataFrame:
    """(id, pos): occurrence ids of lines in the order of first mention: bare numbers, or links anywhere in a line. `df`: pos and the line."""
    # links have one path part and a version at most before the occurrence
    links = F.regexp_extract_all(F.lower(line), F.lit(r"gbif\.org/(?:[\w-]+/)?(?:v1/)?occurrence/(\d+)"), 1)
    ids = F.when(F.trim(line).rlike(r"^\d+$"), F.array(F.trim(line))).otherwise(links)
    rows = df.select("pos", F.posexplode(ids).alias("inner", "id"))
    return rows.groupBy("id").agg(F.min(F.struct("pos", "inner")).alias("first")).orderBy("first").select("id", "first.pos")


def image_stem(c: Column) -> Column:
    """A file's name without folders, image extension and the mark of a resized copy."""
    name = F.regexp_extract(c, r"([^/\\]+)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)\.({'|'.join(IMAGE_TYPES)})$", ""), "^_resized_", ""))


def clean_id(c: Column) -> Column:
    """An id without the .0 of a float; missing words emptied."""
    out = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(out.isin("nan", "None", "<NA>"), "").otherwise(F.coalesce(out, F.lit("")))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the images below a folder; the content is read only if a query asks for it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_TYPES)})$")).select("path", "length", "content")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(annotation_id, transcription, fields) of a JSON map; an entry is a text or {transcription, fields}; ids with a leading _ are notes."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("annotation_id", "entry"))
    entry = F.from_json("entry", "struct<transcription:string,fields:map<string,string>>")
    rows = raw.where(~F.col("annotation_id").startswith("_")).withColumn("e", F.when(F.col("entry").startswith("{"), entry))
    return rows.select("annotation_id", F.when(F.col("e").isNull(), F.col("entry")).otherwise(F.col("e.transcription")).alias("transcription"), F.col("e.fields").alias("fields"))


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """(feature_pos, iso_a2, names, rings) of a JSON array of features {g: Polygon or MultiPolygon, p: properties}, packed or not.

    All rings of a feature stand together, holes and the parts on either side of the antimeridian among them: a point is
    inside if it lies within an odd number. The code is ISO_A2_EH, else ISO_A2; names are in small letters.
    """
    props = "ISO_A2_EH string, ISO_A2 string, " + ", ".join(f"{n} string" for n in BORDER_NAMES)
    raw = spark.read.option("multiLine", True).schema(f"g string, p struct<{props.replace(' string', ':string')}>").json(path)
    ring = "array<array<double>>"
    kind, parts = F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(parts, f"array<{ring}>")).when(kind == "MultiPolygon", F.flatten(F.from_json(parts, f"array<array<{ring}>>")))
    points = F.transform(rings, lambda r: F.transform(r, lambda x: F.struct(F.get(x, 0).alias("lon"), F.get(x, 1).alias("lat"))))
    names = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.lower(F.trim(f"p.{n}")), F.lit("")) for n in BORDER_NAMES])))
    rows = raw.where(rings.isNotNull()).select(F.monotonically_increasing_id().alias("feature_pos"), F.coalesce(F.nullif("p.ISO_A2_EH", F.lit("")), "p.ISO_A2").alias("iso_a2"), names.alias("names"), points.alias("rings"))
    return rows


def settings(path: str | None, given: dict, defaults: dict) -> dict:
    """Settings: given ones, else those of a TOML file, else defaults; a flag can only be switched on by the giver."""
    found: dict = {}
    if path:
        with open(path, "rb") as f:
            for name, value in tomllib.load(f).items():
                found |= value if isinstance(value, dict) else {name: value}
    out = defaults | {k: v for k, v in found.items() if v is not None}
    for k, v in given.items():
        if v is not None and not (v is False and isinstance(out.get(k), bool)):
            out[k] = v
    return out


def is_id_list(spark: SparkSession, path: str) -> bool:
    """Whether a text list names occurrences: its first line that says something is a number or a link to one."""
    said = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).limit(1)
    return not said.where(F.trim("value").rlike(r"^\d+$") | F.lower("value").rlike(r"gbif\.org/(?:[\w-]+/)?(?:v1/)?occurrence/\d+")).isEmpty()


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """Transcriptions, images, a list of images or one of occurrence ids, by a path's ending and a list's first line."""
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm")):
        return read_workbook(spark, path)
    if low.endswith((".csv", ".tsv")):
        return read_delimited(spark, path)
    if low.endswith(".txt") and is_id_list(spark, path):
        lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
        return parse_ids(lines, "line")
    if low.endswith(".txt"):
        return read_image_list(spark, path)
    if low.endswith(".json"):
        return core_columns(read_records(spark, path))
    return read_images(spark, path)
