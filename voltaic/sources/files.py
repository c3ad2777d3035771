"""File sources: Bronze JSON, capacity CSV, Parquet trees, CSV validation, change detection
(S01-S04, S11, S12)."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from voltaic.constants import WHITE_SPACE
from voltaic.functions.columns import normalize_name, strip_ws
from voltaic.session import scratch_path


def _one_value(text: Column) -> Column:
    """The text as Variant if it is one JSON value and nothing else, or NULL.

    The parser stops behind the first value, so the text is parsed as the first element of an array whose second
    one is the text's own hash: a text that closes the array early or holds more values does not lead there."""
    mark = F.xxhash64(text)
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))

    def first(both: Column) -> Column:
        whole = (F.try_variant_get(both, "$[1]", "bigint") == mark) & F.try_variant_get(both, "$[2]", "variant").isNull()
        return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))
    return F.get(F.transform(F.array(parsed), first), F.lit(0))


def _task_roots(spark: SparkSession, path: str, glob: str) -> tuple[list[tuple[str, str]], str] | None:
    """([(URI, place for pyarrow) of what ``path`` names], ``glob`` as a regular expression), or None where only Spark's
    own source reads what it always read: a path that is missing or that pyarrow cannot open, names that may stand for
    compressed files, a stream's sink with its log of committed files, a session that passes over missing or corrupt files."""
    from pyarrow import fs
    try:
        hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
    except Exception:  # noqa: BLE001 - a session without a JVM handle
        return None
    if any(spark.conf.get(f"spark.sql.files.ignore{which}Files") == "true" for which in ("Missing", "Corrupt")):
        return None
    tail = re.split(r"[*?\]}]", glob)[-1]
    if "." not in tail or hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hadoop.fs.Path(f"/x{tail}")) is not None:
        return None
    p = hadoop.fs.Path(path)
    system = p.getFileSystem(conf)
    found = [st.getPath() for st in system.globStatus(p) or ()]
    if not found or (len(found) == 1 and system.exists(hadoop.fs.Path(found[0], "_spark_metadata"))):
        return None
    roots = []
    for uri in (f.toUri() for f in found):
        at = uri.getPath() if uri.getScheme() == "file" else uri.toASCIIString()
        try:
            _ = at.startswith("/") or fs.FileSystem.from_uri(at)
        except (OSError, ValueError):
            return None
        roots.append((re.sub("^file:/+", "file:/", uri.toString()), at))
    return roots, hadoop.fs.GlobPattern(glob).compiled().pattern()


def _walk(pattern: str):
    """root, at -> file, at, path: the files under the roots that a file scan reads, named as its metadata names them; one
    directory is held at a time."""
    def run(batches):
        import re
        import unicodedata
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs
        wanted = re.compile(pattern, re.DOTALL).fullmatch
        hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
        closed = lambda name: hidden(name) and not name.startswith(("_metadata", "_common_metadata"))

        def escaped(c):  # as java.net.URI does: characters beyond ASCII stay unless they are blanks or controls
            c = c.group()
            return c if c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc") else quote(c, safe="")
        for batch in batches:
            for root, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, top = (fs.LocalFileSystem(), at) if at.startswith("/") else fs.FileSystem.from_uri(at)
                todo = [system.get_file_info(top)]
                while todo:
                    info = todo.pop()
                    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(info.path))
                    todo += [f for f in found if f.type == fs.FileType.Directory and not closed(f.base_name)]
                    files = [f.path for f in found if f.is_file and f.size != 0 and not hidden(f.base_name) and wanted(f.base_name)]
                    for i in range(0, len(files), 10_000):
                        part = files[i:i + 10_000]
                        names = [root + re.sub(r"[^A-Za-z0-9_.!~*'():@&=+$,;/-]", escaped, f[len(top):]) for f in part]
                        yield pa.record_batch([pa.array(names, pa.string()), pa.array([at] * len(part), pa.string()),
                                               pa.array(part, pa.string())], names=["file", "at", "path"])
    return run


def _texts(batch_bytes: int):
    """file, at, path -> value, _file: each file's bytes as text, about ``batch_bytes`` to a batch."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        def out(values, names):  # bytes as they are: Spark's text source checks no encoding either
            return pa.record_batch([pa.array(values, pa.binary()).view(pa.string()), pa.array(names, pa.string())], names=["value", "_file"])
        systems, values, names, size = {}, [], [], 0
        for batch in batches:
            for file, at, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at not in systems:
                    systems[at] = fs.LocalFileSystem() if at.startswith("/") else fs.FileSystem.from_uri(at)[0]
                with systems[at].open_input_stream(path, compression=None) as f:
                    data = f.read()
                if values and size + len(data) > batch_bytes:
                    yield out(values, names)
                    values, names, size = [], [], 0
                values.append(data)
                names.append(file)
                size += len(data)
        if values:
            yield out(values, names)
    return run


def _payload_texts(spark: SparkSession, path: str, glob: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """value, _file: the whole text of every file under ``path`` (recursive) whose name matches ``glob``, one row per file.

    Tasks list the files, into a staged table, and read them; the driver sees only what ``path`` itself names. Spark's file
    index holds every file on the driver and counts each as 4 MB, so a task gets a few small payloads only: both its
    listing and its tasks outgrow a driver at some 100 000 payloads. Spark's source reads what ``_task_roots`` leaves to it
    and serves sessions without a shared checkpoint folder."""
    found = _task_roots(spark, path, glob)
    try:
        kept = scratch_path(spark, "payload-files")
    except RuntimeError:  # a cluster session without a shared folder
        found = None
    if found is None:
        return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
                .select("value", F.col("_metadata.file_path").alias("_file")))
    roots, pattern = found
    listed = spark.createDataFrame(roots, "root string, at string").mapInArrow(_walk(pattern), "file string, at string, path string")
    listed.write.parquet(kept)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (spark.read.schema(listed.schema).parquet(kept).repartition(tasks)
            .mapInArrow(_texts(batch_bytes), "value string, _file string"))


def _bronze_records(spark: SparkSession, path: str, schema: StructType, glob: str) -> DataFrame:
    """_file, _pos, _rec (struct or NULL), _raw (text of what is damaged), _why: every record of every JSON file."""
    raw = _payload_texts(spark, path, glob).select("value", "_file", _one_value(F.col("value")).alias("_whole"))
    # JSON Lines (Spark's own landing format) by their shape: no single value, and the first line is an object of its own, or
    # all lines open one and some are whole, or half of them are whole; each line counts for itself
    unit = lambda text, v: F.struct(text.alias("text"), v.alias("v"))
    opens = lambda x: F.startswith(F.trim(x), F.lit("{"))
    lines = F.filter(F.split(F.col("value"), "\r?\n"), lambda x: F.trim(x) != "")
    per_line = F.transform(lines, lambda x: unit(x, F.when(opens(x) & F.endswith(F.trim(x), F.lit("}")), _one_value(x))))
    whole = F.array(unit(F.col("value"), F.col("_whole")))

    def units(parsed: Column) -> Column:
        good = lambda u: u["v"].isNotNull()
        is_lines = (F.size(parsed) > 1) & (good(F.get(parsed, F.lit(0)))
                                           | (F.forall(parsed, lambda u: opens(u["text"])) & F.exists(parsed, good))
                                           | (2 * F.size(F.filter(parsed, good)) >= F.size(parsed)))
        return F.when(F.size(parsed) == 0, parsed).when(is_lines, parsed).otherwise(whole)
    found = F.when(F.col("_whole").isNotNull(), whole).otherwise(F.get(F.transform(F.array(per_line), units), F.lit(0)))
    split = raw.select("_file", F.posexplode(found).alias("_line", "_u"))

    # a unit is an array of records, an envelope of one, or a record
    v = F.col("_u.v")
    array, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    envelope = F.lit(False) if "records" in schema.names else F.map_contains_key(fields, "records")
    records = F.try_variant_get(v, "$.records", "array<variant>")
    item = lambda v, why=None, alone=True: F.struct(v.alias("v"), F.lit(why).cast("string").alias("why"), F.lit(alone).alias("alone"))
    nothing = F.lit(None).cast("variant")
    items = (F.when(v.isNull(), F.array(item(nothing, "no JSON")))
              .when(array.isNotNull(), F.transform(array, lambda x: item(x, alone=False)))
              .when(envelope & records.isNotNull(), F.transform(records, lambda x: item(x, alone=False)))
              .when(envelope, F.array(item(nothing, "records is no array")))
              .otherwise(F.array(item(v))))
    each = split.select("_file", "_line", F.col("_u.text").alias("_text"), F.posexplode(items).alias("_item", "_i"))
    each = each.select("_file", (F.shiftleft(F.col("_line").cast("long"), 32) + F.col("_item")).alias("_pos"), "_i.*",
                       F.when(F.col("_i.alone"), F.col("_text")).alias("_text"),
                       F.try_variant_get("_i.v", "$", "map<string,variant>").alias("_m"))

    # a record is an object whose cells can be read as their columns' types (NULL and absent ones are NULL)
    cell = lambda name: F.element_at("_m", F.lit(name))
    typed = {f.name: F.try_variant_get(cell(f.name), "$", f.dataType.simpleString()) for f in schema.fields}
    wrong = [F.when(cell(n).isNotNull() & ~F.is_variant_null(cell(n)) & c.isNull(), F.lit(n)) for n, c in typed.items()]
    bad = F.array_join(F.array_compact(F.array(*wrong)), ", ") if wrong else F.lit("")
    why = F.coalesce("why", F.when(F.col("_m").isNull(), "no object").when(bad != "", F.concat(F.lit("unreadable: "), bad)))
    record = F.struct(*[c.cast(schema[n].dataType).alias(n) for n, c in typed.items()])
    return each.select("_file", "_pos", F.when(why.isNull(), record).alias("_rec"),
                       F.when(why.isNotNull(), F.coalesce("_text", F.to_json("v"), F.lit("null"))).alias("_raw"), why.alias("_why"))


def read_bronze_json(spark: SparkSession, path: str, schema: StructType,
                     with_ordinal: bool = True, on_damage: str = "fail", quarantine: str | None = None,
                     glob: str = "*.json") -> DataFrame:
    """Every JSON file under ``path`` (recursive), in path order.

    A file may hold an array of records, an envelope ``{"records": [...]}``,
    a single object or JSON Lines. ``(_file, _pos)`` is a total load order for
    keep-last (line number * 2^32 + place in the line's array or envelope). A missing path raises; an empty directory gives an empty frame.

    Every text is parsed once, into a Variant, and every element of an array or
    envelope is judged alone. Nothing is lost silently: a file or line of JSON
    Lines that is no JSON or holds anything after its value, an envelope whose
    ``records`` is no array, an element that is no object and a record with a
    cell that its column's type cannot hold are damaged. With ``on_damage="fail"``
    they end the read with an error naming the file, the reason and the text;
    with ``"quarantine"`` their texts are appended to ``quarantine`` (file,
    position, text, reason) and the good records are returned. Numbers in text
    columns are spelled without trailing zeros.

    A payload file is one value, as the feed lands it (at most Spark's limit for a
    Variant, beyond it the file counts as damaged); large JSON Lines files belong
    to ``spark.read.json``, which splits them. Tasks list the files and read them,
    so the driver's memory does not grow with their number; the list is a table in
    the shared checkpoint folder, made when this function is called (a session
    without such a folder reads through Spark's own file index).
    """
    if on_damage not in ("fail", "quarantine") or (on_damage == "quarantine") != (quarantine is not None):
        raise ValueError("on_damage is 'fail', or 'quarantine' with a quarantine path")
    recs = _bronze_records(spark, path, schema, glob)
    damaged = F.col("_why").isNotNull()
    if on_damage == "quarantine":
        # parsed once: good and damaged records come from one staged table
        staged = scratch_path(spark, "bronze-records")
        recs.write.parquet(staged)
        recs = spark.read.schema(recs.schema).parquet(staged)
        (recs.where(damaged).select("_file", "_pos", F.col("_raw").alias("text"), F.col("_why").alias("reason"))
         .write.mode("append").parquet(quarantine))
        recs = recs.where(~damaged)
    else:
        stop = F.raise_error(F.concat(F.lit("damaged JSON in "), F.col("_file"), F.lit(", "), F.col("_why"), F.lit(": "), F.col("_raw")))
        recs = recs.withColumn("_rec", F.when(damaged, stop.cast(schema)).otherwise(F.col("_rec")))
    out = recs.select("_file", "_pos", "_rec.*")
    return out if with_ordinal else out.drop("_file", "_pos")


@dataclass(frozen=True)
class CsvLayout:
    """Files that share a delimiter and a header (its cells, byte-order mark removed)."""
    sep: str
    header: tuple[str, ...]
    late: bool  # records of blank cells stand before the header
    files: tuple[str, ...]


def _count(text: Column, what) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, what if isinstance(what, Column) else F.lit(what), F.lit("")))


def csv_layouts(spark: SparkSession, path: str, sep: str | None = None) -> list[CsvLayout]:
    """The header layouts of the CSV files at ``path`` (file names and header cells only, no data); blank files have none.

    The header is a file's first line that holds more than blanks, quotes and delimiters; if it breaks off inside
    quotes, the record is completed from the whole text of that file. Without ``sep`` it decides the delimiter itself:
    ';' if it has more semicolons than commas, else ','.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(_plain_path(F.col("_metadata.file_path")).alias("file"), "value", at.alias("at"))
    marks = "".join({";", ",", '"', "\ufeff", sep or ";"})
    blank = strip_ws(F.translate("value", marks, "")) == ""
    first = lines.groupBy("file").agg(F.min_by("value", F.when(~blank, F.col("at"))).alias("h"), F.min(F.when(~blank, F.col("at"))).alias("at"),
                                      F.min(F.when(F.length("value") > 0, F.col("at"))).alias("begin")).where("h IS NOT NULL")
    heads = first.select("file", "h", (F.col("at") != F.col("begin")).alias("late")).collect()  # one header line per file
    open_ = [r["file"] for r in heads if r["h"].count('"') % 2]
    whole = {}
    if open_:
        record = r'(?s)^(?:[\s;,"\ufeff]*\R)?((?:"(?:[^"]|"")*+"|[^"\r\n])++)'
        texts = spark.read.text([_literal_path(f) for f in open_], wholetext=True)
        whole = {r["file"]: r["h"] for r in texts.select(_plain_path(F.col("_metadata.file_path")).alias("file"),
                                                         F.regexp_extract("value", record, 1).alias("h")).collect()}
    found: dict[tuple, list[str]] = {}
    for r in heads:
        head = (whole.get(r["file"]) or r["h"]).removeprefix("\ufeff")
        own = sep or (";" if head.count(";") > head.count(",") else ",")
        cells = next(csv.reader([*head.splitlines(keepends=True)], delimiter=own), [])
        found.setdefault((own, tuple(cells), r["late"]), []).append(r["file"])
    return [CsvLayout(own, cells, late, tuple(sorted(own_files))) for (own, cells, late), own_files in sorted(found.items())]


def _literal_path(path: str) -> str:
    """A path whose name means itself where globs are read."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def column_names(header: Sequence[str], norm) -> tuple[list[str], list[str]]:
    """(a column name per header cell, the names that came more than once): repeats get ``_2``, ``_3``, ...; blank
    cells ``column_<place>``."""
    names, seen, repeated = [], {}, []
    for i, cell in enumerate(header, 1):
        name = norm(cell) or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            repeated.append(name)
            name = f"{name}_{seen[name]}"
            seen[name] = seen.get(name, 0) + 1
        names.append(name)
    return names, sorted(set(repeated))


def _csv_rows(spark: SparkSession, layout: CsvLayout, names: Sequence[str]) -> DataFrame:
    """_file, _row, the columns ``names`` as text, _beyond (the whole record where it has more cells than the header):
    the data records of one layout's files, each parsed once. Blank records are left out; ``_row`` ascends in a file."""
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(len(names))] + [StructField("_bad", StringType())])
    rows = (spark.read.schema(schema).option("multiLine", True).option("sep", layout.sep).option("escape", '"')
            .option("header", not layout.late).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad")
            .option("ignoreLeadingWhiteSpace", False).option("encoding", "UTF-8").csv([_literal_path(f) for f in layout.files]))
    cells = [F.col(f"_c{i}") for i in range(len(names))]
    unquoted = F.regexp_replace("_bad", r'"(?:[^"]|"")*+"', "")  # records with too few cells are bad to the parser, too
    beyond = F.when(_count(unquoted, layout.sep) >= len(names), F.col("_bad"))
    some = F.exists(F.array(*cells), lambda c: strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", "")) != "")
    rows = rows.where(some).select(_plain_path(F.col("_metadata.file_path")).alias("_file"), F.monotonically_increasing_id().alias("_row"),
                                   *[c.alias(n) for c, n in zip(cells, names, strict=True)], beyond.alias("_beyond"))
    if layout.late:  # the first record that is not blank is the header
        head = rows.groupBy("_file").agg(F.min("_row").alias("_head"))
        rows = rows.join(head, "_file").where(F.col("_row") > F.col("_head")).drop("_head")
    return rows


def _plain_path(uri) -> Column:
    """The metadata path is a URI (percent-encoded); listings give plain paths."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def sniff_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """file, sep: a file's first line decides: ';' if it has more semicolons than commas, else ','."""
    lines = spark.read.text(path).select(
        _plain_path(F.col("_metadata.file_path")).alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    first = lines.groupBy("file").agg(F.min_by("value", "_at").alias("h"))
    count = lambda c: F.char_length("h") - F.char_length(F.replace("h", F.lit(c), F.lit("")))
    return first.select("file", F.when(count(";") > count(","), ";").otherwise(",").alias("sep"))


def read_capacity_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Capacity CSV (file or directory), every column as text; load order columns ``_file``, ``_row`` added.

    Files may order or choose their columns differently and have delimiters of
    their own (unless ``sep`` names one): files with the same header are parsed
    together, once, with as many columns as that header has. Of the files only
    names and headers reach the driver; ``_row`` ascends within a file. A header
    name that comes again gets a number (``a``, ``a_2``); a record with more cells
    than its header ends the read with an error naming the file.
    """
    out = None
    for layout in csv_layouts(spark, path, sep):
        names, _ = column_names(layout.header, lambda c: normalize_name(c, fold_accents=True))
        rows = _csv_rows(spark, layout, names)
        stop = F.raise_error(F.concat(F.lit("more cells than the header in "), F.col("_file"), F.lit(": "), F.col("_beyond")))
        rows = rows.withColumn("_row", F.when(F.col("_beyond").isNotNull(), stop.cast("long")).otherwise(F.col("_row"))).drop("_beyond")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "_file string, _row long") if out is None else out


def resolve_aliases(df: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """For each canonical name, the first candidate column present wins (driver-side name pick)."""
    cols = {c.lower(): c for c in df.columns}
    out = df
    for canon, cands in candidates.items():
        hit = next((cols[c.lower()] for c in cands if c.lower() in cols), None)
        if hit is None:
            out = out.withColumn(canon, F.lit(None).cast("string"))
        elif hit != canon:
            out = out.withColumn(canon, F.col(hit))
    return out


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file or a partitioned tree, schemas merged."""
    return spark.read.option("mergeSchema", True).parquet(path)


def validate_and_route_csv(spark: SparkSession, path: str,
                           required: Sequence[str] = ("code_insee_region", "puissance_installee_mw"),
                           landing: str | None = None, quarantine: str | None = None,
                           ts: str | None = None, sep: str = ",") -> DataFrame:
    """Per-file validation; returns one status row per file.

    FAIL when the file is empty (nothing but whitespace), misses a required
    column (header names trimmed, case-insensitive, BOM ignored) or has no
    data row; a file that repeats column names passes with a remark in ``error``.
    Good files are appended to ``landing`` (as text columns; repeated names get
    numbers, records with more cells than their header are kept whole in
    ``_beyond`` where there are any), bad files' lines and reason to ``quarantine``.

    Records are Spark's CSV records, so quoted headers and multi-line cells
    count as what they are. Files with the same header are parsed together and
    once: rows are counted on the staged records that are landed. Of the files
    only names (as in any file scan) and headers reach the driver.
    """
    layouts = csv_layouts(spark, path, sep)
    checked, counts, staged = [], [], {}
    for layout in layouts:
        names, repeated = column_names(layout.header, lambda c: c.strip(WHITE_SPACE).lower())
        missing = [r.lower() for r in required if r.lower() not in names]
        remark = "repeated columns: " + ", ".join(repeated) if repeated else None
        checked += [(f, "missing columns: " + ", ".join(missing) if missing else None, remark) for f in layout.files]
        rows = _csv_rows(spark, layout, names)
        if landing is not None and not missing:
            stage = scratch_path(spark, "csv-records")
            rows.write.parquet(stage)
            rows = staged[layout] = spark.read.schema(rows.schema).parquet(stage)
        counts.append(rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows")))
    # files without a record (zero-length or whitespace only) come from the listing
    status = _listed(spark, path).join(
        spark.createDataFrame(checked, "file string, missing string, remark string").withColumn("known", F.lit(True)), "file", "left")
    counted = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "file string, rows long")
    status = status.join(counted, "file", "left")
    error = (F.when(F.col("known").isNull(), "empty file").when(F.col("missing").isNotNull(), F.col("missing"))
             .when(F.col("rows").isNull(), "header only"))
    status = status.select("file", F.when(error.isNull(), "PASS").otherwise("FAIL").alias("status"),
                           F.coalesce(error, "remark").alias("error"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    if quarantine is None and landing is None:
        return status
    kept = scratch_path(spark, "csv-status")  # one row per file, used more than once
    status.write.parquet(kept)
    status = spark.read.schema(status.schema).parquet(kept)
    if quarantine is not None:
        # the bad file's own lines are kept beside the reason
        text = (spark.read.text(path).select(_plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("line"),
                                             F.col("_metadata.file_block_start").alias("block"),
                                             F.monotonically_increasing_id().alias("position")))
        (status.where(F.col("status") == "FAIL").join(text, "file", "left")
            .withColumn("quarantined_at", F.lit(ts).cast("timestamp") if ts else F.current_timestamp())
            .write.mode("append").parquet(quarantine))
    if staged:
        good = status.where(F.col("status") == "PASS").select(F.col("file").alias("_file"))
        landed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), staged.values()).join(good, "_file", "left_semi")
        wide = any(not r.where("_beyond IS NOT NULL").isEmpty() for r in staged.values())
        landed.drop("_row", *[] if wide else ["_beyond"]).write.mode("append").parquet(landing)
    return status


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """file: the data files directly under ``path``, zero-length ones included, as the driver's file index lists them."""
    return spark.createDataFrame([(f,) for f in list_files(spark, path)], "file string")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Qualified paths of the files directly under ``path`` (file names only, no data).

    Hadoop's listing includes zero-length files, which no file source returns
    as rows. A session without a JVM handle (Spark Connect) falls back to the
    ``binaryFile`` listing, which misses only zero-length files.
    """
    try:
        jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop FileSystem listing
    except Exception:  # noqa: BLE001
        return sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return sorted(st.getPath().toString() for st in fs.listStatus(p)
                  if st.isFile() and not st.getPath().getName().startswith((".", "_")))


def _digests(block_bytes: int):
    """path, name, length, modified -> name, checksum, records, length, modified, each file read block by block."""
    def run(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            checksums, records = [], []
            for path in batch.column(0).to_pylist():
                local = re.sub("^file:/*", "/", path)
                system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
                digest, lines, tail, begun = hashlib.sha256(), 0, b"", False
                with system.open_input_stream(name) as f:
                    while data := f.read(block_bytes):
                        digest.update(data)
                        *whole, tail = (tail + data).split(b"\n")
                        for line in whole:
                            lines += begun or bool(line.removesuffix(b"\r").strip(b" "))
                            begun = False
                        # of a line that goes on, whether it holds anything and its last byte (it may belong to the line end)
                        begun = begun or bool(tail[:-1].strip(b" "))
                        tail = tail[-1:]
                lines += begun or bool(tail.strip(b" "))
                checksums.append(digest.hexdigest()[:16])
                records.append(lines - 1)
            yield pa.record_batch([batch.column(1), pa.array(checksums, pa.string()), pa.array(records, pa.int64()), batch.column(2),
                                   batch.column(3)], names=["name", "checksum", "records", "length", "modified"])
    return run


def skip_unchanged(spark: SparkSession, path: str, state: DataFrame | None, trust_listing: bool = True,
                   block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Files whose content checksum (first 16 hex of SHA-256) changed since the last run.

    Returns (files to ingest with their data-line count, new state). State
    columns: (name, checksum, length, modified); a state without the last two
    serves, too. Files that the listing shows with the size and modification time
    of the state are not opened (unless ``trust_listing`` is off); the others are
    read once, block by block, whatever their size.
    """
    listing = spark.read.format("binaryFile").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
        F.unix_micros("modificationTime").alias("modified"))
    known = state is not None and {"length", "modified"} <= set(state.columns)
    look = listing.join(state, ["name", "length", "modified"], "left_anti") if known and trust_listing else listing
    digested = look.select("path", "name", "length", "modified").mapInArrow(
        _digests(block_bytes), "name string, checksum string, records long, length long, modified long")
    kept = scratch_path(spark, "file-digests")  # one row per file, used more than once
    digested.write.parquet(kept)
    digested = spark.read.schema(digested.schema).parquet(kept)
    todo = digested if state is None else digested.join(state.select("name", "checksum"), ["name", "checksum"], "left_anti")
    new_state = digested.select("name", "checksum", "length", "modified")
    if state is not None:
        old = state.join(digested.select("name"), "name", "left_anti")
        new_state = old.select("name", "checksum", *["length", "modified"] * known).unionByName(new_state, allowMissingColumns=True)
    return todo.select("name", "checksum", "records"), new_state


def incremental_filter(df: DataFrame, since: str | None = None, region: str | None = None,
                       ts_col: str = "date_heure", region_col: str = "code_insee_region",
                       partition_cols: bool = False) -> DataFrame:
    """Rows at or after ``since`` for an optional region.

    With ``partition_cols`` the year/month/day partition predicate derived
    from ``since`` is added next to the time predicate so directories are
    pruned before any file is opened.
    """
    out = df
    if since is not None:
        lo = F.lit(since).cast("timestamp_ntz")
        out = out.where(F.col(ts_col) >= lo)
        if partition_cols:
            at = F.struct(F.year(lo), F.month(lo), F.dayofmonth(lo))
            y, m = at["col1"], at["col2"]
            days = F.lit(True) if "day" not in df.columns else (F.col("day") >= at["col3"])
            out = out.where((F.col("year") > y) | ((F.col("year") == y) & (
                (F.col("month") > m) | ((F.col("month") == m) & days))))
    if region is not None:
        out = out.where(F.col(region_col) == region)
    return out
