"""Readers of filings and facts. Bytes are parsed where they are read; everything after is columns."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "path string, tag string, full_tag string, context string, unit string, decimals string, value double, value_text string, pos bigint, period_start string, period_end string, error string"


def path_parts(path: Column) -> Column:
    """Struct year, doc_type, code, document of an archive's path ``.../{year}/{doc_type}/{code}_..._{document}....zip``."""
    steps = F.split(path, "/")
    name, blank = F.element_at(steps, -1), F.lit("")
    return F.struct(
        F.get(steps, F.size(steps) - 3).try_cast("int").alias("year"), F.get(steps, F.size(steps) - 2).alias("doc_type"),
        F.nullif(F.regexp_extract(name, r"^([0-9A-Z]{4,5})_", 1), blank).alias("code"), F.nullif(F.regexp_extract(name, r"(S10[0-9][0-9A-Z]{4})", 1), blank).alias("document"),
    )


def archives(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """path, content and the parts of the name of every archive under ``root``: year, doc_type, code, document."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(root).select("path", "content", path_parts(F.col("path")).alias("p")).select("path", "content", "p.*")


#: Folders of a company's archives, in the order in which they are tried.
FOLDERS, INTERIM = ["annual", "quarterly"], "interim"


def preferred(files: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the archives of the first folder that has any (annual before quarterly), and the interim ones always."""
    rank = F.array_position(F.array(*[F.lit(x) for x in FOLDERS]), F.col("doc_type"))
    ranked = files.withColumn("_r", rank)
    best = ranked.where("_r > 0").groupBy(*keys).agg(F.min("_r").alias("_best"))
    return ranked.join(best, keys, "left").where((F.col("_r") == F.col("_best")) | (F.col("doc_type") == INTERIM)).select(*files.columns)


def _periods(root: ElementTree.Element) -> dict[str, tuple]:
    """Context id -> (start, end) as written; an instant is its own end without a start."""
    out = {}
    for c in root.iter():
        if c.tag.rpartition("}")[2] == "context" and c.get("id"):
            found = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in c.iter()}
            out[c.get("id")] = (found.get("startDate"), found.get("endDate") or found.get("instant"))
    return out


def parse_instance(content: bytes) -> tuple[list[dict], str | None]:
    """Facts of one archive, and why it could not be read: the first instance under a public folder, else any; elements
    with a context reference, each with its context's period."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if n.endswith(".xbrl"))
            names = [n for n in names if "PublicDoc" in n] or names
            if not names:
                return [], "no instance"
            root = ElementTree.fromstring(z.read(names[0]))
    except zipfile.BadZipFile:
        return [], "no archive"
    except ElementTree.ParseError:
        return [], "no XML"
    out, periods = [], _periods(root)
    for pos, e in enumerate(root.iter()):
        context = e.get("contextRef")
        if context is None:
            continue
        text = (e.text or "").strip()
        try:
            value = float(text.replace(",", ""))
        except ValueError:
            value = None
        space, _, local = e.tag.rpartition("}")
        start, end = periods.get(context, (None, None))
        out.append({"tag": local, "full_tag": f"{space.lstrip('{')}:{local}", "context": context, "unit": e.get("unitRef"), "decimals": e.get("decimals"), "value": value, "value_text": text or None, "pos": pos, "period_start": start, "period_end": end})
    return out, None


def facts(files: DataFrame) -> DataFrame:
    """One row a fact of the archives (path, content); an unreadable archive gives one row with its ``error`` and no fact."""

    def parse(batches):
        text = ("path", "tag", "full_tag", "context", "unit", "decimals")
        schema = pa.schema([*[(n, pa.string()) for n in text], ("value", pa.float64()), ("value_text", pa.string()), ("pos", pa.int64()), ("period_start", pa.string()), ("period_end", pa.string()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, error = parse_instance(content)
                rows = [{"path": path, "error": None, **f} for f in found] or ([{"path": path, "error": error}] if error else [])
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)

    return files.select("path", "content").mapInArrow(parse, FACTS)


def inline_facts(docs: DataFrame) -> DataFrame:
    """doc_id, name, context, scale, value of inline figures (ix:nonFraction) in pages, scaled and signed."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<ix:nonFraction\b[^>]*>.*?</ix:nonFraction>)"), 1)).alias("e"))
    attribute = lambda a: F.nullif(F.regexp_extract("e", rf'(?i)\b{a}="([^"]*)"', 1), F.lit(""))
    number = F.regexp_replace(F.regexp_replace("e", r"<[^>]*>", ""), r"[,\s]", "").try_cast("double")
    sign = F.when(attribute("sign") == "-", -1.0).otherwise(1.0)
    return found.select("doc_id", attribute("name").alias("name"), attribute("contextRef").alias("context"), (number * sign * F.pow(F.lit(10.0), F.coalesce(attribute("scale").try_cast("double"), F.lit(0.0)))).alias("value"))


_ENTRIES = "array<struct<fy:int,fp:string,start:date,end:date,filed:date,val:double>>"
COMPANY_FACTS = f"cik bigint, facts map<string,map<string,struct<units:map<string,{_ENTRIES}>>>>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """cik, namespace, tag, unit, fy, fp, start, end, filed, val from company facts in JSON, one company a file."""
    return fact_entries(spark.read.schema(COMPANY_FACTS).option("multiLine", "true").json(path))


def fact_entries(df: DataFrame) -> DataFrame:
    """The entries of parsed company facts (cik, facts), one row each."""
    df = df.select("cik", F.explode("facts").alias("namespace", "tags")).select("cik", "namespace", F.explode("tags").alias("tag", "t"))
    return df.select("cik", "namespace", "tag", F.explode("t.units").alias("unit", "entries")).select("cik", "namespace", "tag", "unit", F.inline("entries"))


def listings(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A code list in CSV with a header, all columns as text. Spark reads Unicode and Latin files itself; other encodings
    are decoded where the files are read."""
    if re.match(r"(utf|iso-8859-1$|us-ascii$)", encoding.lower()):
        return spark.read.option("header", "true").option("encoding", encoding).csv(path)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(csv.reader(io.StringIO(content.decode(encoding, "replace"))))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["pos", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "pos bigint, cells array<string>")
    head = rows.where("pos = 0").first()
    return rows.where("pos > 0").select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(head["cells"] if head else [])])


def filing_index(df: DataFrame) -> DataFrame:
    """Parallel arrays form, reportDate, accession as rows."""
    return df.select(*[c for c in df.columns if c not in ("form", "reportDate", "accession")], F.inline(F.arrays_zip("form", "reportDate", "accession")))


def geo_points(spark: SparkSession, path: str, price: str, use: str) -> DataFrame:
    """lat, lon, price, use of a GeoJSON file's point features."""
    return features(spark.read.schema(FEATURES).option("multiLine", "true").json(path), price, use)


FEATURES = "features array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"


def features(df: DataFrame, price: str, use: str) -> DataFrame:
    """lat, lon, price, use of parsed feature collections."""
    f = df.select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.properties")[price].try_cast("double").alias("price"), F.col("f.properties")[use].alias("use"))


def write_store(df: DataFrame, path: str, year: str = "fy") -> None:
    """A store partitioned by year, whose partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)


def markdown(df: DataFrame, title: str, most: int = 30) -> str:
    """A small report table as Markdown: the first ``most`` rows."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def statement_rows(df: DataFrame, column: str, fields: dict[str, list[str]]) -> DataFrame:
    """code, name, year and the fields (in full units) of an API's rows in JSON: strings in thousands, Minguo years; a field
    comes from the first of its names that is filled."""
    from ledgerline.functions.scalars import parse_number
    from ledgerline.operators.markets import gregorian

    m = F.from_json(column, "map<string,string>")
    value = lambda names: F.coalesce(*[parse_number(m[n]) for n in names]) * 1000
    return df.select(m["公司代號"].cast("bigint").alias("code"), m["公司名稱"].alias("name"), gregorian(m["年度"].cast("int")).alias("year"), *[value(n).alias(f) for f, n in fields.items()])


def flash_list(pages: DataFrame, keyword: str) -> DataFrame:
    """page_id, ticker, title, file of a list page's rows whose title has the keyword and that link an archive; each once."""
    from ledgerline.functions.scalars import ticker

    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    file = F.nullif(F.regexp_extract("tr", r'href="([^"]+\.zip)"', 1), F.lit(""))
    out = rows.select("page_id", ticker(F.get(cells, F.lit(0))).alias("ticker"), F.get(cells, F.lit(1)).alias("title"), file.alias("file"))
    return out.where(F.contains("title", F.lit(keyword)) & F.col("file").isNotNull()).distinct()


def deals(spark: SparkSession, path: str) -> DataFrame:
    """kind, unit_price, prefecture, city, use of land deals in JSON, one object a line or an array."""
    schema = "Type string, UnitPrice string, Prefecture string, Municipality string, CityPlanning string"
    return spark.read.schema(schema).option("multiLine", "true").json(path).toDF("kind", "unit_price", "prefecture", "city", "use")


def sheet_rows(sheet: DataFrame, code: str, year: int) -> DataFrame:
    """The first row of a sheet with this code and year, by the sheet's order (pos)."""
    return sheet.where((F.col("code") == code) & (F.col("fy") == year)).orderBy("pos").limit(1)


def read_polygons(content: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings of each record of a shapefile's main part (shape type 5; others give no ring)."""
    import struct

    out, at = [], 100
    while at + 12 <= len(content):
        _, words = struct.unpack_from(">ii", content, at)
        kind = struct.unpack_from("<i", content, at + 8)[0]
        rings: list = []
        if kind == 5:
            parts, points = struct.unpack_from("<ii", content, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", content, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        out.append(rings)
        at += 8 + 2 * words
    return out


def read_attributes(content: bytes, encoding: str = "cp932") -> list[dict[str, str]]:
    """The rows of a shapefile's table of attributes, as text."""
    import struct

    rows, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    out = []
    for r in range(rows):
        p, row = head + r * size + 1, {}
        for name, width in fields:
            row[name] = content[p : p + width].decode(encoding, "replace").strip()
            p += width
        out.append(row)
    return out


def polygons(spark: SparkSession, root: str, use: str) -> DataFrame:
    """path, nth, use, ring (array of struct x, y) of the shapefiles under a folder: each ``.shp`` beside its ``.dbf``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"\.[^.]+$", "").alias("path"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), "content")
    both = files.where("kind = 'shp'").withColumnRenamed("content", "shp").join(files.where("kind = 'dbf'").select("path", F.col("content").alias("dbf")), "path", "left")
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def parse(batches):
        for batch in batches:
            for path, shp, dbf in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = read_attributes(dbf) if dbf else []
                found = [(path, k, rows[k].get(use) if k < len(rows) else None, [{"x": x, "y": y} for x, y in ring]) for k, rings in enumerate(read_polygons(shp)) for ring in rings]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.list_(point)))], names=["path", "nth", "use", "ring"])

    return both.select("path", "shp", "dbf").mapInArrow(parse, "path string, nth int, use string, ring array<struct<x:double,y:double>>")
