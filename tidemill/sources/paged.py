"""Paged listings as a data source: one partition per (keyword, department), read page by page from a folder of answers.

A listing is asked for each keyword in each department, newest first, with an offset; a source
serves a window of offsets at most.  An answer is a JSON object with the list of results and
their total number; it lies in <path>/keyword=K/department=D/offset=N, or, with its offset and
a tab before it, in a line of <path>/keyword=K/department=D/block=B, which holds BLOCK pages.
No answer at an offset means that nothing more came; an answer with an error status ends the
listing there.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Results of a page, and how many results of a listing a source serves.
PAGE, WINDOW = 150, 1150
#: Pages of one exported file: a folder a page costs more than its rows.
BLOCK = 1000
ITEMS = "keyword string, department string, place int, published string, item string, complete boolean"
REPORT = "keyword string, department string, pages int, n int, total int, complete boolean, ended_by string"


@dataclass
class Listing(InputPartition):
    keyword: str
    department: str


def export_answers(rows: DataFrame, where: str, item: Column, page: int = PAGE, status: Column | None = None) -> None:
    """Writes rows (keyword, department, published, id) as answers in pages, newest first, then by id.

    item is a JSON text of a result; it must have the published date in dateCreation.  status
    (an error, or null) is that of the whole page if a row of it has one.
    """
    ranked = rows.where("keyword IS NOT NULL AND department IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("keyword", "department").orderBy(F.desc("published"), "id")) - 1)
    totals = rows.groupBy("keyword", "department").agg(F.count("*").alias("total"))
    ranked = ranked.withColumn("offset", F.floor(F.col("place") / page) * page).withColumn("item", item).withColumn("status", F.lit(None).cast("int") if status is None else status)
    pages = ranked.groupBy("keyword", "department", "offset").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("own"), F.max("status").alias("status")).join(totals, ["keyword", "department"])
    results = F.array_join(F.transform("own", lambda x: x["item"]), ",")
    value = F.when(F.col("status").isNotNull(), F.format_string('{"status":%d}', "status")).otherwise(F.format_string('{"total":%d,"results":[%s]}', "total", results))
    blocks = pages.select("keyword", "department", F.floor(F.col("offset") / (page * BLOCK)).alias("block"), F.format_string("%d\t%s", "offset", value).alias("value"))
    blocks.repartition("keyword", "department", "block").write.partitionBy("keyword", "department", "block").text(where)


class PagedListing(DataSource):
    """spark.read.format("paged_listing"): options path, page, window, keywords and departments (JSON lists; without them, those at hand), since, report.

    With report, a row per listing in place of its results.  since is a text like the published
    dates: results come newest first, so a listing stops at the page that is past it.  It is an
    option, as a filter that is pushed down would stay with the reader when the same DataFrame
    is used again without it.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return REPORT if self.options.get("report", "false") == "true" else ITEMS

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.where, self.report = options["path"], options.get("report", "false") == "true"
        self.page, self.window = int(options.get("page", PAGE)), int(options.get("window", WINDOW))
        self.keywords, self.departments = (json.loads(options[k]) if k in options else None for k in ("keywords", "departments"))
        self.since: str | None = options.get("since")

    def partitions(self) -> list[InputPartition]:
        files, base = pyarrow.fs.FileSystem.from_uri(self.where)
        here = lambda folder, key: sorted(unquote(x.base_name.removeprefix(f"{key}=")) for x in files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if x.base_name.startswith(f"{key}="))
        out = []
        for k in self.keywords if self.keywords is not None else here(base, "keyword"):
            for d in self.departments if self.departments is not None else here(f"{base}/keyword={quote(k)}", "department"):
                out.append(Listing(k, d))
        return out

    def _files(self, keyword: str, department: str, folder: str) -> Iterator[io.BufferedReader]:
        files, base = pyarrow.fs.FileSystem.from_uri(self.where)
        for x in files.get_file_info(pyarrow.fs.FileSelector(f"{base}/keyword={quote(keyword)}/department={quote(department)}/{folder}", allow_not_found=True)):
            if x.base_name.startswith("part-") and x.size:
                with files.open_input_file(x.path) as f:
                    yield io.BufferedReader(f)

    def _block(self, keyword: str, department: str, block: int) -> dict[int, bytes]:
        """The answers of a block that the window can reach, by offset."""
        lines = (line.rstrip(b"\n").partition(b"\t") for f in self._files(keyword, department, f"block={block}") for line in f)
        return {int(offset): answer for offset, _, answer in lines if int(offset) < self.window}

    def _answers(self, keyword: str, department: str) -> Iterator[tuple[int, dict | None]]:
        """Offsets of the window with their answers, each read when it is asked for."""
        known: tuple[int, dict[int, bytes]] = (-1, {})
        for offset in range(0, self.window, self.page):
            alone = next((f.read() for f in self._files(keyword, department, f"offset={offset}")), None)
            if alone is None and known[0] != (block := offset // (self.page * BLOCK)):
                known = block, self._block(keyword, department, block)
            answer = alone if alone is not None else known[1].get(offset)
            yield offset, None if answer is None else json.loads(answer)

    def read(self, partition: Listing | None) -> Iterator[tuple]:
        if partition is None:  # there is no listing at all
            return
        results: list[dict] = []
        total, pages, ended = None, 0, "window"
        for offset, answer in self._answers(partition.keyword, partition.department):
            if answer is None:
                ended = "nothing"
                break
            pages += 1
            if not isinstance(answer.get("results"), list):
                ended = "error"
                break
            total = answer.get("total", total)
            results += [x for x in answer["results"] if x.get("id")]
            if total is not None and offset + self.page >= total:
                ended = "total"
                break
            if self.since is not None and results and (results[-1].get("dateCreation") or "") < self.since:
                ended = "since"
                break
        results = results[: self.window]
        # all there is, or all that is asked for
        complete = ended == "since" or (total is not None and len(results) >= total) or (ended == "nothing" and total is None)
        if self.report:
            yield partition.keyword, partition.department, pages, len(results), total, complete, ended
            return
        for place, x in enumerate(results):
            yield partition.keyword, partition.department, place, x.get("dateCreation"), json.dumps(x, ensure_ascii=False), complete


def paged(spark: SparkSession, where: str, since: str | None = None, **options: object) -> DataFrame:
    """The listing in a folder, what was published from since on; page, window, keywords, departments, report as options."""
    spark.dataSource.register(PagedListing)
    options |= {"since": since} if since is not None else {}
    told = {k: json.dumps(v) if isinstance(v, list | tuple | bool) else str(v) for k, v in options.items()}
    rows = spark.read.format("paged_listing").options(path=where, **told).load()
    return rows if since is None or options.get("report") else rows.where(F.col("published") >= since)  # the last page holds older results, too
