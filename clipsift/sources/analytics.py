"""Audience-analytics exports: headers, numbers, durations, tables in CSV, ZIP and XLSX files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a source: bytes of a file, files of an archive, bytes that an archive expands to.
FILE_BYTES, ARCHIVE_FILES, ARCHIVE_BYTES = 20_000_000, 30, 50_000_000


def normalized_header(raw: Column) -> Column:
    """Camel case split, percent signs spelled out, lower case, everything else one space."""
    spaced = F.regexp_replace(F.replace(raw, F.lit("%"), F.lit(" percentage ")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " "))


def parsed_number(raw: Column) -> Column:
    """A number with thousands separators or a percent sign; dashes, n/a and non-finite values are null."""
    text = F.trim(raw)
    number = F.replace(F.regexp_replace(text, "%$", ""), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.lower(text).isin("—", "-", "n/a", "") & ~F.isnan(number) & (F.abs(number) != float("inf")), number)


def parsed_seconds(raw: Column) -> Column:
    """Seconds of ``1h 5m 30s``, ``mm:ss``, ``hh:mm:ss`` or a plain number."""
    text = F.lower(F.trim(raw))
    clock = F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60.0 + x.try_cast("double"))
    unit = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?)\s*{u}", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.contains(text, F.lit(":")), clock).when(text.rlike(r"\d\s*[hms]"), unit("h") * 3600.0 + unit("m") * 60.0 + unit("s")).otherwise(parsed_number(raw))


def compact_count(raw: Column) -> Column:
    """A whole number from ``1.2M``, ``17k`` or digits."""
    text = F.upper(F.replace(F.trim(raw), F.lit(","), F.lit("")))
    scale = F.when(text.endswith("K"), 1e3).when(text.endswith("M"), 1e6).otherwise(1.0)
    return F.round(F.regexp_extract(text, r"^([0-9.]+)[KM]?$", 1).try_cast("double") * scale).cast("long")


def column_ordinal(reference: Column) -> Column:
    """The column of a cell reference such as AB12, from 0."""
    letters = F.split(F.regexp_extract(F.upper(reference), "^([A-Z]+)", 1), "")
    value = F.aggregate(letters, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return value - 1


def decoded(data: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16, else Latin-1."""
    for encoding in ("utf-8-sig", "utf-16"):
        try:
            return data.decode(encoding)
        except UnicodeError:
            continue
    return data.decode("latin-1")


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; cells that are left out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > ARCHIVE_BYTES:
            raise ValueError("the workbook expands beyond its bound")
        names = z.namelist()
        local = lambda e: e.tag.rpartition("}")[2]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if local(t) == "t"))
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for number, row in enumerate(r for r in ElementTree.fromstring(z.read(name)).iter() if local(r) == "row"):
                cells: dict[int, str] = {}
                for cell in row:
                    letters = re.match("[A-Za-z]+", cell.get("r", ""))
                    at = len(cells) if not letters else _ordinal(letters[0])
                    text = "".join(t.text or "" for t in cell.iter() if local(t) in ("v", "t"))
                    cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
                yield name, number, [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def _ordinal(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def tables_of(name: str, data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row number, cells) of a CSV, TSV, ZIP of these, or XLSX file."""
    suffix = name.rpartition(".")[2].lower()
    if suffix == "xlsx":
        yield from xlsx_rows(data)
    elif suffix == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = [i for i in z.infolist() if i.filename.lower().endswith((".csv", ".tsv")) and not i.is_dir()]
            if len(inside) > ARCHIVE_FILES or sum(i.file_size for i in inside) > ARCHIVE_BYTES:
                raise ValueError("the archive passes its bounds")
            for i in inside:
                yield from tables_of(i.filename, z.read(i))
    else:
        for number, row in enumerate(csv.reader(io.StringIO(decoded(data)), delimiter="\t" if suffix == "tsv" else ",")):
            yield name, number, row


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, header, value) of all tables in the export files under ``path``; the first row of a table is its header.

    A file that can't be read gives one row with the reason in ``value`` and a null header. Files are read where Spark finds them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "table", "row", "header", "value"]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                heads: dict[str, list[str]] = {}
                try:
                    for table, number, cells in tables_of(file, bytes(data)):
                        if table not in heads:
                            heads[table] = cells
                            continue
                        rows += [(file, table, number, h, v) for h, v in zip(heads[table], cells) if h.strip()]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error, IndexError) as e:
                    rows = [(file, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names).astype({"row": "Int64"})

    files = spark.read.format("binaryFile").load(path)
    rows = files.where(F.col("length") <= FILE_BYTES).select("path", "content").mapInPandas(run, "file string, table string, row long, header string, value string")
    none = lambda kind: F.lit(None).cast(kind)
    too_large = files.where(F.col("length") > FILE_BYTES).select(F.col("path").alias("file"), none("string").alias("table"), none("long").alias("row"), none("string").alias("header"), F.format_string("the file has %d bytes, more than %d", "length", F.lit(FILE_BYTES)).alias("value"))
    return rows.unionByName(too_large)


#: What exports call each field (a normalised header is looked up here).
ALIASES: dict[str, tuple[str, ...]] = {
    "date": ("date", "day"),
    "content": ("content", "video", "video title", "post", "post caption", "caption", "description", "reel"),
    "video_id": ("video id", "post id", "media id", "reel id", "item id"),
    "channel_id": ("channel id",),
    "creator_content_type": ("creator content type", "content type"),
    "subscribed_status": ("subscribed status",),
    "country_code": ("country code", "country"),
    "traffic_source_type": ("traffic source type",),
    "traffic_source_detail": ("traffic source detail",),
    "device_type": ("device type",),
    "operating_system": ("operating system",),
    "playback_location_type": ("playback location type",),
    "age_group": ("age group",),
    "gender": ("gender",),
    "sharing_service": ("sharing service",),
    "subtitle_language": ("subtitle language",),
    "views": ("views", "video views", "post views", "reel views", "reels views", "plays", "video play count", "initial plays", "initial views"),
    "engaged_views": ("engaged views",),
    "watch_time_hours": ("watch time hours",),
    "watch_time_minutes": ("watch time minutes", "estimated minutes watched"),
    "watch_time_seconds": ("watch time", "watch time seconds", "total watch time", "total play time", "total watch duration", "video view total time", "ig reels video view total time"),
    "average_view_duration_seconds": ("average view duration", "average view duration seconds", "average watch time", "average watch time seconds", "avg watch time", "ig reels avg watch time"),
    "average_view_percentage": ("average percentage viewed percentage", "average percentage viewed", "average view percentage", "average view duration percentage"),
    "likes": ("likes",),
    "dislikes": ("dislikes",),
    "comments": ("comments",),
    "shares": ("shares",),
    "saves": ("saves", "saved"),
    "reach": ("reach", "accounts reached", "unique viewers", "reached audience"),
    "follows": ("follows", "new follows", "new followers", "followers gained"),
    "profile_visits": ("profile visits", "profile views"),
    "replays": ("replays", "replay count", "clips replays count", "aggregated all plays count"),
    "total_interactions": ("total interactions", "interactions", "engagement"),
    "completion_rate_percentage": ("watched full video percentage", "watched full video", "full video watched percentage", "completion rate percentage", "completion rate", "completed video percentage"),
    "subscribers": ("subscribers",),
    "subscribers_gained": ("subscribers gained",),
    "subscribers_lost": ("subscribers lost",),
    "shown_in_feed": ("shown in feed", "shorts shown in feed"),
    "chose_to_view_percentage": ("how many chose to view percentage", "chose to view percentage", "stayed to watch percentage", "stayed to watch"),
    "thumbnail_impressions": ("thumbnail impressions", "impressions", "video thumbnail impressions"),
    "thumbnail_ctr": ("thumbnail click through rate percentage", "impressions click through rate percentage", "click through rate percentage", "video thumbnail impressions ctr"),
    "elapsed_video_time_ratio": ("elapsed video time ratio", "elapsed video time percentage"),
    "audience_watch_ratio": ("audience watch ratio", "audience watch ratio percentage"),
    "relative_retention_performance": ("relative retention performance", "relative retention performance percentage"),
}


def canonical_field(header: Column) -> Column:
    """The field that a normalised header names; null for an unknown one."""
    names = F.create_map(*[F.lit(x) for field, aliases in ALIASES.items() for alias in aliases for x in (alias, field)])
    return F.try_element_at(names, header)


def report_type(fields: Column) -> Column:
    """What a report is about, by the first telling field that it has."""
    has = lambda *names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    return (
        F.when(has("elapsed_video_time_ratio"), "audience_retention").when(has("traffic_source_type"), "traffic_sources").when(has("device_type", "operating_system"), "device_and_os")
        .when(has("age_group", "gender"), "demographics").when(has("thumbnail_impressions"), "reach").when(has("date"), "daily_performance").otherwise("summary")
    )
