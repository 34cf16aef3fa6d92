"""Market files of any shape: JSON, JSONL and CSV with resolved aliases, and Parquet or tables.

Rows keep their order (file, pos). JSON lines and CSV files are read split by split (``line_files``), however large a file is; a JSON document that is read from a path comes whole.
``json_rows`` and ``csv_rows`` take texts (file, text), or files in pieces (file, part, text) that are cut behind line feeds; tables of a row per piece tell how the pieces hang together,
and no task holds more than a piece and what a quoted field or an item that goes on ties to it.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import slices
from ..functions.parse import first_field, is_candle, lenient_double
from ..functions.timefn import iso, kst
from ..shared import materialize
from .line_files import read_lines

# Keys of a JSON object that may hold the rows, and aliases of fields in order of preference.
LISTS = ("data", "candles", "ticks", "prices", "records")
TIME = ("timestamp", "time", "date", "datetime", "ts", "일자", "시간")
PRICE = ("price", "close", "현재가", "종가", "current_price", "cur_prc")
OPEN, HIGH, LOW, CLOSE = ("open", "시가", "opening"), ("high", "고가", "highPrice"), ("low", "저가", "lowPrice"), ("close", "종가", "current_price", "cur_prc")
VOLUME = ("volume", "거래량")
INSTRUMENT = ("instrumentId", "instrument_id", "code", "종목코드", "symbol")
SYMBOL = ("symbol", "종목명", "name", "shortName")
ASSET = ("assetType", "asset_type", "securityType")
FORMATS = ("json", "jsonl", "csv")
_MAP = "map<string,string>"
#: Lines of a file in a piece, and rows of a piece that a worker hands out at a time.
PIECE_LINES, _ROWS = 1000, 4096
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def _glob(suffix: str) -> str:
    return "*.[" + "][".join(c.lower() + c.upper() for c in suffix) + "]"


def _whole(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffix)).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _items(text: Column) -> Column:
    """The items of a JSON text: a list's, or those of an object's first listed list, or else the text itself."""
    top = F.from_json(text, _MAP)
    inner = None
    for k in LISTS:
        v = F.element_at(top, F.lit(k))
        hit = F.coalesce(F.ltrim(v).startswith("["), F.lit(False))
        inner = F.when(hit, v) if inner is None else inner.when(hit, v)
    listed = F.from_json(inner, "array<string>")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(F.size(listed) > 0, listed).otherwise(F.array(text))


def json_rows(files: DataFrame) -> DataFrame:
    """Rows of JSON texts: a list, or an object's first listed list, or else the object itself; what is no object is skipped."""
    if "part" in files.columns:
        return _json_pieces(files)
    d = files.withColumn("text", F.trim(F.regexp_replace("text", "^\\uFEFF", "")))
    return d.select("file", F.posexplode(_items(F.col("text"))).alias("pos", "item")).select("file", F.col("pos").cast("long").alias("pos"), F.from_json("item", _MAP).alias("raw")).filter("raw is not null")


def _brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, part, change, low, first, last) of pieces: how the depth of brackets changes and how low it comes, and the first and last characters that are no blanks."""
    for b in slices(batches):
        rows = []
        for text in b.column(2).to_pylist():
            plain = (text or "").removeprefix("\ufeff").strip()
            depth = low = 0
            for c in re.findall(r"[\[\]{}]", _STRING.sub("", plain)):
                depth += 1 if c in "[{" else -1
                low = min(low, depth)
            rows.append((depth, low, plain[:1] or None, plain[-1:] or None))
        change, low, first, last = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(change, pa.int64()), pa.array(low, pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string())], names=["file", "part", "change", "low", "first", "last"])


def _json_pieces(files: DataFrame) -> DataFrame:
    """``json_rows`` of files in pieces. Pieces that hold whole items of a list are parsed by themselves; in the document, which is then parsed, a string stands for each of them."""
    pieces = materialize(files.select("file", F.col("part").cast("long").alias("part"), "text"))
    whole = Window.partitionBy("file").orderBy("part")
    ahead = whole.rowsBetween(Window.unboundedPreceding, -1)
    marks = pieces.mapInArrow(_brackets, "file string, part long, change long, low long, first string, last string")
    marks = marks.withColumns({"depth": F.coalesce(F.sum("change").over(ahead), F.lit(0)), "before": F.last("last", ignorenulls=True).over(ahead), "top": F.first("first", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    level = F.when(F.col("top") == "[", 1).when(F.col("top") == "{", 2)
    # an object after a bracket or a comma is an item of a list: in an object a colon stands before it
    within = (F.col("depth") == level) & (F.col("change") == 0) & (F.col("low") == 0) & (F.col("first") == "{") & F.col("before").isin("[", ",")
    marks = marks.filter(within).select(F.col("file").alias("_file"), F.col("part").alias("_part"), F.lit(True).alias("within"))
    body = F.regexp_replace("text", r"\s*(,?)\s*\z", "")
    met = pieces.join(marks, F.col("file").eqNullSafe(F.col("_file")) & (F.col("part") == F.col("_part")), "left")
    parsed = materialize(met.select("file", "part", "text", F.when(F.col("within"), F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")).alias("items")))
    mark = f"{uuid.uuid4().hex}:"
    shown = F.when(F.col("items").isNotNull(), F.concat(F.lit(f'"{mark}'), F.col("part"), F.lit('"'), F.when(F.col("text").rlike(r",\s*\z"), ",").otherwise(""))).otherwise(F.col("text"))
    document = parsed.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", shown.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    text = F.trim(F.regexp_replace("text", "^\\uFEFF", ""))
    listed = document.withColumn("text", text).select("file", F.posexplode(_items(F.col("text"))).alias("at", "item"))
    listed = materialize(listed.withColumn("_part", F.when(F.col("item").rlike(f"^{mark}-?\\d+$"), F.substring_index("item", ":", -1).cast("long"))))
    # an object without a listed list is a row by itself, with all that it holds
    itself = F.col("_part").isNull() & F.contains("item", F.lit(mark))
    alone = listed.filter(itself).select(F.col("file").alias("_file"))
    listed = listed.filter(~itself)
    here = parsed.filter("items is not null").select(F.col("file").alias("_file"), F.col("part").alias("_part"), "items")
    same = F.col("file").eqNullSafe(F.col("_file"))
    counted = listed.join(here.select("_file", "_part", F.size("items").alias("n")), [same, listed["_part"] == here["_part"]], "left").select("file", "at", "item", listed["_part"], F.coalesce("n", F.lit(1)).alias("n"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = counted.join(here, [same, counted["_part"] == here["_part"]], "left").select("file", "before", F.posexplode(F.coalesce("items", F.array("item"))).alias("i", "item"))
    rows = rows.select("file", (F.col("before") + F.col("i")).alias("pos"), F.from_json("item", _MAP).alias("raw")).filter("raw is not null")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return rows.unionByName(json_rows(pieces.join(alone, same, "left_semi").groupBy("file").agg(F.array_join(texts, "").alias("text"))))


def jsonl_rows(files: DataFrame) -> DataFrame:
    """Rows of JSON lines in texts (file, text); blank and damaged lines and what is no object are skipped."""
    return line_rows(files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")))


def line_rows(lines: DataFrame) -> DataFrame:
    """The same of numbered lines (file, pos, line)."""
    return lines.select("file", F.col("pos").cast("long").alias("pos"), F.from_json(F.trim("line"), _MAP).alias("raw")).filter("raw is not null")


def _records(text: str | None) -> Iterator[list[str]]:
    csv.field_size_limit((1 << 31) - 1)
    return csv.reader(io.StringIO(text or "", newline=""))


def _quoting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, part, plain, quoted): whether a quoted field is open behind a piece, if none was and if one was open before it."""

    def left_open(text: str) -> bool:
        last = None
        for last in _records(text + "x"):
            pass
        return last != ["x"]  # an open field holds at least the line feed before it

    for b in slices(batches):
        texts = b.column(2).to_pylist()
        ends = [(left_open(x), left_open('"' + x)) if x and '"' in x else (False, True) for x in texts]
        plain, quoted = zip(*ends, strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain, pa.bool_()), pa.array(quoted, pa.bool_())], names=["file", "part", "plain", "quoted"])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, part, records, header): how many records that are not empty a piece has, and its first record."""
    for b in slices(batches):
        counts, heads = [], []
        for text in b.column(2).to_pylist():
            n, head = 0, None
            for r in _records(text):
                head = r if head is None else head
                n += bool(r)
            counts.append(n)
            heads.append(head)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(heads, pa.list_(pa.string()))], names=["file", "part", "records", "header"])


def _parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, pos, raw) of pieces (file, text, before, header), some thousand rows at a time; without a header a piece begins with its own."""

    def batch(file: list[str], pos: list[int], raw: list[dict]) -> pa.RecordBatch:
        maps = pa.array([list(r.items()) for r in raw], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(pos, pa.int64()), maps], names=["file", "pos", "raw"])

    for b in slices(batches):
        for file, text, pos, header in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, raw = [], []
            records = _records(text)
            names = next(records, []) if header is None else header
            for r in records:
                if not r:
                    continue
                at.append(pos)
                raw.append(dict(zip(names, r + [None] * (len(names) - len(r)), strict=False)))
                pos += 1
                if len(at) == _ROWS:
                    yield batch([file] * len(at), at, raw)
                    at, raw = [], []
            if at:
                yield batch([file] * len(at), at, raw)


def csv_rows(files: DataFrame) -> DataFrame:
    """Rows of CSV texts, each with a header of its own; a byte-order mark is dropped."""
    out = f"file string, pos long, raw {_MAP}"
    bare = F.regexp_replace("text", "^\\uFEFF", "")
    if "part" not in files.columns:
        return files.select("file", bare.alias("text"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("array<string>").alias("header")).mapInArrow(_parsing, out)
    pieces = materialize(files.select("file", F.col("part").cast("long").alias("part"), "text"))
    begins = pieces.groupBy(F.col("file").alias("_file")).agg(F.min("part").alias("_first"))
    pieces = pieces.join(begins, F.col("file").eqNullSafe(F.col("_file"))).select("file", "part", F.when(F.col("part") == F.col("_first"), bare).otherwise(F.col("text")).alias("text"))
    by = Window.partitionBy("file").orderBy("part")
    upto, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.mapInArrow(_quoting, "file string, part long, plain boolean, quoted boolean")
    # pieces after which a field is open or not, whatever was before, and how often the others turn that round
    ends = ends.withColumn("turns", F.sum((F.col("plain") & ~F.col("quoted")).cast("long")).over(upto))
    known = F.last(F.when(F.col("plain") == F.col("quoted"), F.struct(F.col("plain").cast("long").alias("open"), "turns")), ignorenulls=True).over(ahead)
    turned = F.coalesce(F.max("turns").over(ahead), F.lit(0))
    ends = ends.withColumn("known", known).withColumn("open", (F.coalesce("known.open", F.lit(0)) + turned - F.coalesce("known.turns", F.lit(0))) % 2)
    # pieces with an open field before them join the last one without
    ends = ends.withColumn("begin", F.last(F.when(F.col("open") == 0, F.col("part")), ignorenulls=True).over(upto))
    ends = ends.select(F.col("file").alias("_file"), F.col("part").alias("_part"), "begin")
    same = F.col("file").eqNullSafe(F.col("_file")) & (F.col("part") == F.col("_part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    tied = materialize(pieces.join(ends, same).groupBy("file", "begin").agg(F.array_join(parts, "").alias("text")).withColumnRenamed("begin", "part").select("file", "part", "text"))
    counts = tied.mapInArrow(_counting, "file string, part long, records long, header array<string>")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.withColumns({"before": F.coalesce(F.sum("records").over(ahead), F.lit(0)), "own": F.min(F.when(F.col("header").isNotNull(), F.col("part"))).over(every), "header": F.first("header", ignorenulls=True).over(every)})
    own = F.coalesce(F.col("part") == F.col("own"), F.lit(True))
    counts = counts.select(F.col("file").alias("_file"), F.col("part").alias("_part"), F.when(own, F.lit(0)).otherwise(F.col("before") - (F.size("header") > 0).cast("long")).alias("before"), F.when(~own, F.col("header")).alias("header"))
    return tied.join(counts, same).select("file", "text", "before", "header").mapInArrow(_parsing, out)


def line_pieces(lines: DataFrame) -> DataFrame:
    """Files in pieces (file, part, text) of numbered lines (file, pos, line). What follows a file's last line feed ends it, so that none is made up."""
    parts = lines.groupBy("file", F.floor(F.col("pos") / PIECE_LINES).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    last = lines.groupBy(F.col("file").alias("_file")).agg(F.floor(F.max("pos") / PIECE_LINES).alias("_last"))
    feed = F.when(F.col("part") < F.col("_last"), "\n").otherwise("")
    return parts.join(last, F.col("file") == F.col("_file")).select("file", "part", F.concat("text", feed).alias("text"))


_READERS = {"json": json_rows, "jsonl": jsonl_rows, "csv": csv_rows}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, raw) of one file by its suffix; an unknown suffix gives no rows, a missing file is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return line_rows(read_lines(spark, path))
    if suffix == "csv":
        return csv_rows(line_pieces(read_lines(spark, path, returns=True)))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if suffix == "parquet":
        raise ValueError("Parquet is a table: read it with spark.read.parquet and use resolve()")
    return _READERS[suffix](files) if suffix in _READERS else files.select("file", F.lit(0).cast("long").alias("pos"), F.from_json("text", _MAP).alias("raw")).limit(0)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(file, pos, raw) of all files below a folder; a missing folder is an error. (file, pos) is the input order."""
    out = None
    for suffix, reader in _READERS.items():
        if suffix == "json":
            rows = reader(_whole(spark, root, suffix))
        else:
            lines = read_lines(spark, root, _glob(suffix), returns=suffix == "csv")
            rows = line_rows(lines) if suffix == "jsonl" else reader(line_pieces(lines))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve(rows: DataFrame) -> DataFrame:
    """Prints and bars of raw rows (file, pos, raw): aliases resolved, numbers and times parsed, unusable rows gone."""
    f = lambda names: first_field(F.col("raw"), *names)
    d = rows.select(
        F.when(is_candle(F.col("raw")), "candle").otherwise("tick").alias("kind"), kst(f(TIME)).alias("ts"),
        F.coalesce(f(INSTRUMENT), F.lit("")).alias("instrument_id"), F.coalesce(f(SYMBOL), F.lit("")).alias("symbol"), lenient_double(f(PRICE)).alias("price"),
        lenient_double(f(OPEN)).alias("open"), lenient_double(f(HIGH)).alias("high"), lenient_double(f(LOW)).alias("low"), lenient_double(f(CLOSE)).alias("close"),
        lenient_double(f(VOLUME)).alias("volume"), f(ASSET).alias("asset_type"), "file", "pos",
    )
    bar = F.col("kind") == "candle"
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return d.filter(F.col("ts").isNotNull() & F.when(bar, whole).otherwise(F.col("price").isNotNull()))


def strict_records(rows: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(records, classified) of raw rows (file, pos, raw): validated, and of each (instrument, time) the last row kept."""
    from ..operators.validate import strict_rows

    classified = strict_rows(rows.withColumn("kind", is_candle(F.col("raw"))), provider)
    good = classified.filter("reject_reason is null")
    kept = [c for c in good.columns if c not in ("instrument_id", "timestamp")]
    last = good.groupBy("instrument_id", "timestamp").agg(F.max_by(F.struct(*kept), F.struct((~F.col("kind")).cast("int").alias("k"), "file", "pos")).alias("r"))
    return last.select("instrument_id", "timestamp", "r.*").drop("kind", "file", "pos", "reject_reason"), classified


def read_strict(spark: SparkSession, path: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """``strict_records`` of a strict JSON-lines file, in time order."""
    records, classified = strict_records(read_file(spark, path), provider)
    return records.orderBy("timestamp"), classified


# Keys a stored hourly record must have.
REQUIRED = ("timestamp", "market", "instrumentId", "symbol", "assetType", "open", "high", "low", "close", "changeRate", "source", "provider", "observedAt", "dataMode")


def load_existing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records with ``seq``, rejected lines) of an hourly JSON-lines file."""
    return existing_records(read_lines(spark, path).select(F.col("pos").alias("seq"), "line"))


def existing_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of lines (seq, line). Blank lines count for nothing; NULL in a required number rejects the line."""
    rows = lines.filter("trim(line) <> ''").withColumn("raw", F.from_json("line", _MAP))
    ok = F.col("raw").isNotNull()
    for k in REQUIRED:
        ok = ok & F.map_contains_key("raw", F.lit(k))
    g = lambda k: F.element_at(F.col("raw"), F.lit(k))
    for k in ("open", "high", "low", "close", "changeRate"):
        ok = ok & lenient_double(g(k)).isNotNull()
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = rows.filter("ok").select(
        F.col("seq").cast("long").alias("seq"), g("timestamp").alias("timestamp"), g("market").alias("market"), g("instrumentId").alias("instrument_id"), g("symbol").alias("symbol"),
        *[lenient_double(g(k)).alias(k) for k in ("open", "high", "low", "close")], lenient_double(g("volume")).alias("volume"), lenient_double(g("changeRate")).alias("change_rate"),
        g("source").alias("source"), g("provider").alias("provider"), g("assetType").alias("asset_type"), g("observedAt").alias("observed_at"), g("dataMode").alias("data_mode"),
        F.coalesce(g("isPartial").try_cast("boolean"), F.lit(False)).alias("is_partial"),
    )
    return good, rows.filter("not ok").select("seq", "line")


def sample_market(spark: SparkSession, end: str, hours: int = 8, base: float = 3200.0) -> DataFrame:
    """Sample bars up to ``end``; each opens off the close before, so closes are a running sum."""
    from pyspark.sql import Window

    i = F.col("id")
    sign = F.when(i % 2 == 0, 1.0).otherwise(-1.0)
    d = spark.range(hours).withColumns({"step": sign * (i * 0.5 + 2), "turn": sign * -3})
    w = Window.orderBy("id")
    d = d.withColumn("c", F.lit(base) + F.sum(F.col("step") + F.col("turn")).over(w)).withColumn("o", F.col("c") - F.col("turn"))
    ts = kst(F.lit(end)) - F.make_interval(hours=(hours - 1 - i).cast("int"))
    price = {"open": F.col("o"), "high": F.greatest("o", "c") + 2, "low": F.least("o", "c") - 2, "close": F.col("c")}
    return d.select(
        iso(ts).alias("timestamp"), F.lit("KOSPI").alias("market"), F.lit("KOSPI").alias("instrument_id"), F.lit("KOSPI").alias("symbol"), *[F.bround(v, 2).alias(k) for k, v in price.items()],
        F.lit(None).cast("double").alias("volume"), F.bround((F.col("c") - F.col("o")) / F.col("o") * 100, 2).alias("change_rate"), F.lit("sample-data").alias("source"), F.lit("sample").alias("provider"),
        F.lit("index").alias("asset_type"), F.lit(end).alias("observed_at"), F.lit("sample").alias("data_mode"), F.lit(False).alias("is_partial"),
    )
