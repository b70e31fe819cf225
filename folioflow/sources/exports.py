"""Exports and imports: CSV, JSON, newline-delimited JSON, XML, SQL dumps, spreadsheets and archives.

Line formats are Columns of text lines, so that any size is written by all executors; archives are folders of such
lines. A spreadsheet is a bounded report: a single file of at most REPORT_ROWS rows a sheet, made on the driver; more
rows raise RowCeiling.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import safe_filename
from ..operators.diff import import_plan
from ..operators.errors import RowCeiling
from ..operators.predicates import kind_of_type
from .stores import slice_of

REPORT_ROWS = 100_000


def _public(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def text_of(df: DataFrame, name: str) -> Column:
    """A value as text: nested ones as JSON, whole doubles without a fraction, null as null."""
    t = df.schema[name].dataType
    if kind_of_type(t) in ("array", "struct", "map"):
        return F.to_json(F.col(name))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        c = F.col(name)
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return F.col(name).cast("string")


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Column line: CSV lines without the header; null is empty, fields with quotes, commas or line ends are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return df.select(F.concat_ws(",", *[F.coalesce(quoted(text_of(df, c)), F.lit("")) for c in columns or _public(df)]).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search('[",\r\n]', c) else c for c in columns)


def _finite(df: DataFrame, name: str) -> Column:
    """A column, with null for numbers that are not finite."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c.alias(name)


def json_lines(df: DataFrame, tag: str | None = None) -> DataFrame:
    """Column line: one JSON object a row without the columns that start with _; tag goes first as _schema.

    Nulls are left out, and numbers that are not finite count as null.
    """
    head = [F.lit(tag).alias("_schema")] if tag is not None else []
    return df.select(F.to_json(F.struct(*head, *[_finite(df, c) for c in _public(df)])).alias("line"))


def _pascal(name: str) -> str:
    one = name[:-3] + "y" if name.endswith("ies") else name[:-1] if name.endswith("s") and not name.endswith("ss") else name
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", one) if p) or "Record"


def _xml_name(name: str) -> str:
    """A name that XML takes: other characters become _, and one that begins no name gets a _ before it."""
    name = re.sub(r"[^\w.\-]", "_", name)
    return name if re.match(r"[^\W\d]", name) else f"_{name}"


def xml_lines(df: DataFrame, collection: str) -> DataFrame:
    """Column line: one element a row, named after the collection in the singular; control characters are dropped."""

    def clean(c):
        c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        return reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), c)

    tag = _pascal(collection)
    names = {c: _xml_name(c) for c in _public(df)}
    fields = [F.concat(F.lit(f"<{n}>"), F.coalesce(clean(text_of(df, c)), F.lit("")), F.lit(f"</{n}>")) for c, n in names.items()]
    return df.select(F.concat(F.lit(f"<{tag}>"), *fields, F.lit(f"</{tag}>")).alias("line"))


def write_xml(df: DataFrame, collection: str, path: str) -> None:
    """XML documents, one for each partition of df: the elements of its rows inside one root element."""
    root = f"{_pascal(collection)}List"

    def run(source):
        yield pa.RecordBatch.from_arrays([pa.array([f"<{root}>"])], names=["line"])
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column("line")], names=["line"])
        yield pa.RecordBatch.from_arrays([pa.array([f"</{root}>"])], names=["line"])

    write_lines(xml_lines(df, collection).mapInArrow(run, "line string"), path)


SQL_TYPES = {
    "postgres": {"number": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "TIMESTAMP", "string": "TEXT"},
    "mysql": {"number": "DOUBLE", "boolean": "BOOLEAN", "date": "DATETIME", "string": "TEXT"},
    "sqlite": {"number": "REAL", "boolean": "INTEGER", "date": "TEXT", "string": "TEXT"},
}


def sql_schema(df: DataFrame, collection: str, dialect: str = "postgres") -> str:
    mark = "`" if dialect == "mysql" else '"'
    kinds = {c: SQL_TYPES[dialect].get(kind_of_type(df.schema[c].dataType), SQL_TYPES[dialect]["string"]) for c in _public(df)}
    return f"CREATE TABLE {mark}{collection}{mark} (" + ", ".join(f"{mark}{c}{mark} {k}" for c, k in kinds.items()) + ");"


def sql_lines(df: DataFrame, collection: str, dialect: str = "postgres") -> DataFrame:
    """Column line: one INSERT a row."""
    mark = "`" if dialect == "mysql" else '"'

    def literal(name):
        kind, c = kind_of_type(df.schema[name].dataType), text_of(df, name)
        if kind == "boolean" and dialect == "sqlite":
            c = F.when(F.col(name), "1").otherwise("0")
        plain = c if kind in ("number", "boolean") else F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.when(_finite(df, name).isNull(), "NULL").otherwise(plain)

    columns = _public(df)
    head = f"INSERT INTO {mark}{collection}{mark} (" + ", ".join(f"{mark}{c}{mark}" for c in columns) + ") VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *[literal(c) for c in columns]), F.lit(");")).alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    lines.select("line").write.mode(mode).option("compression", compression).text(path)


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = False) -> DataFrame:
    """Files of csv_lines (or with a header line each): quoted fields may hold line ends; without a schema all is text.

    An empty field is null, as csv_lines writes it; a file is read by one task, since a line end may be inside a field.
    """
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("lineSep", "\n")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_xml(spark: SparkSession, path: str, collection: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", _pascal(collection))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def export_chunks(collections: dict[str, DataFrame], dictionaries: dict[str, DataFrame] | None = None, ledger_head: dict | None = None):
    """(collection, schema as JSON, rows, more) in order of the names; names with _ are left out."""
    for name in sorted(n for n in collections if not n.startswith("_")):
        df = collections[name]
        yield name, df.select(*_public(df)).schema.json(), df, {"dictionaries": sorted(dictionaries or {}), "ledgerHead": ledger_head}


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise RowCeiling(f"a report takes {most} rows")
    return rows


def write_archive(collections: dict[str, DataFrame], path: str) -> None:
    """A folder an archive: compressed JSON lines of each collection, written by all executors, and a manifest of schemas."""
    names = sorted(n for n in collections if not n.startswith("_"))
    for name in names:
        write_lines(json_lines(collections[name]), f"{path}/{name}", compression="gzip")
    spark = next(iter(collections.values())).sparkSession
    rows = [(n, collections[n].select(*_public(collections[n])).schema.json()) for n in names]
    spark.createDataFrame(rows, "collection string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collections by name, with the schemas they were written with."""
    manifest = spark.read.schema("collection string, schema string").json(f"{path}/_manifest").collect()  # a row a collection
    return {r["collection"]: read_json_lines(spark, f"{path}/{r['collection']}", T.StructType.fromJson(json.loads(r["schema"]))) for r in manifest}


def _digest(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest that does not depend on their order (sums of the halves of each row's hash)."""
    whole = F.sha2(F.to_json(F.struct(*[_finite(df, c) for c in _public(df)])), 256)
    half = lambda k: F.sum(F.conv(F.substring(whole, k, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.coalesce(half(1), F.lit(0)), F.coalesce(half(13), F.lit(0))).alias("digest"))


def dump(collections: dict[str, DataFrame], path: str, slices: dict | None = None) -> None:
    """An archive with a seal: rows and digest of each collection. slices: keywords of slice_of, for a part of the vault."""
    held = {n: (slice_of(df, **slices) if slices else df) for n, df in collections.items() if not n.startswith("_")}
    write_archive(held, path)
    seal = reduce(DataFrame.unionByName, [_digest(df).withColumn("collection", F.lit(n)) for n, df in held.items()])
    seal.coalesce(1).write.mode("overwrite").json(f"{path}/_seal")


def verify_dump(spark: SparkSession, path: str) -> DataFrame:
    """collection, rows, ok: whether what can be read is what was sealed; a collection that is missing or new is not ok."""
    found = reduce(DataFrame.unionByName, [_digest(df).select(F.lit(n).alias("_name"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest")) for n, df in read_archive(spark, path).items()])
    seal = spark.read.schema("collection string, rows long, digest string").json(f"{path}/_seal")
    joined = seal.join(found, F.col("collection") == F.col("_name"), "full_outer")
    ok = F.coalesce((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), F.lit(False))
    return joined.select(F.coalesce("collection", "_name").alias("collection"), F.coalesce("_rows", F.lit(0)).alias("rows"), ok.alias("ok"))


def load(live: dict[str, tuple[DataFrame, str]], path: str, policy: str = "merge") -> dict[str, DataFrame]:
    """The collections (DataFrame, id) after the import of a dump; one that is not live yet is taken as it is."""
    spark = next(iter(live.values()))[0].sparkSession
    held = read_archive(spark, path)
    out = {n: df for n, (df, _) in live.items()}
    return out | {n: import_plan(live[n][0], df, policy, live[n][1]) if n in live else df for n, df in held.items()}


def blob_files(slots: DataFrame, blobs: DataFrame, name: str, hash_col: str = "hash", content: str = "content", profile: str = "zip") -> DataFrame:
    """path, content: attachments with names that an archive takes; names that meet get the start of their hash in front."""
    named = slots.withColumn("_path", safe_filename(F.col(name), profile))
    twice = named.groupBy(F.col("_path").alias("_p")).agg((F.count(F.lit(1)) > 1).alias("_meets"))
    path = F.when(F.col("_meets"), F.concat(F.substring(hash_col, 1, 12), F.lit("-"), F.col("_path"))).otherwise(F.col("_path"))
    joined = named.join(twice, F.col("_path") == F.col("_p")).select(path.alias("path"), F.col(hash_col).alias("_hash"))
    return joined.join(blobs.select(F.col(hash_col).alias("_blob"), F.col(content).alias("content")), F.col("_hash") == F.col("_blob")).select("path", "content")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, content of all files inside zip files: a task opens the zips of its partition, the driver none."""

    def run(source):
        for batch in source:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([z.read(member)], pa.binary())], names=["path", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, content binary")


def read_json_documents(spark: SparkSession, path: str, collection: str, schema) -> DataFrame:
    """The records of one collection in files that hold a whole document {collection: [records]} each."""
    kind = T.StructType([T.StructField(collection, T.ArrayType(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)))])
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    return whole.select(F.explode(F.col("d").getField(collection)).alias("r")).select("r.*")


def write_json_documents(df: DataFrame, collection: str, path: str) -> None:
    """Documents {collection: [records]}, one for each partition of df, each assembled by its own task."""

    def run(source):
        lines = [line for batch in source for line in batch.column("line").to_pylist()]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([f"{{{json.dumps(collection)}:[{','.join(lines)}]}}"])], names=["line"])

    write_lines(json_lines(df).mapInArrow(run, "line string"), path)


def _cell(column: int, row: int, value) -> str:
    name, k = "", column
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{name}{row}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{name}{row}"><v>{value}</v></c>'
    return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def to_workbook(collections: dict[str, DataFrame], most: int = REPORT_ROWS) -> bytes:
    """A spreadsheet file with a sheet a collection, header first, of bounded rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = [n for n, *_ in export_chunks(collections)]
    part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>{sheets}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            df = collections[n].select(*_public(collections[n]))
            rows = [df.columns, *_bounded(df, most)]
            body = "".join(f'<row r="{k}">' + "".join(_cell(j, k, v) for j, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
