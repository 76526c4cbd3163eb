"""Report renderers. Lines are built as column expressions; the driver only adds headers and joins a bounded report.

``compat`` keeps the plain output: no escaping or quoting, NULL as None. Without it values are escaped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators import reports

# Section names as headers spell them.
TITLES = {
    "5xx or 0 status codes": "5Xx Or 0 Status Codes", "4xx status codes": "4Xx Status Codes", "missing canonical": "Missing Canonical", "missing title": "Missing Title",
    "missing meta description": "Missing Meta Description", "lint level critical": "Lint Level Critical", "lint level error": "Lint Level Error", "all": "All",
}


def title_case(name: str) -> str:
    """Underscores to spaces, and a capital after anything that is no letter."""
    return TITLES.get(name) or name.replace("_", " ").title()


def _value(c: Column, compat: bool, none: str = "None") -> Column:
    return F.coalesce(c.cast("string"), F.lit(none if compat else ""))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def csv_lines(rows: DataFrame, run_id: str, section: str, columns: list[str], compat: bool = True) -> DataFrame:
    """rows with a ``line`` column; columns: those rendered, in order."""
    quote = lambda c: c if compat else F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return rows.withColumn("line", F.concat_ws(",", F.lit(run_id), F.lit(title_case(section)), *[quote(_value(F.col(c), compat)) for c in columns]))


def csv_header(columns: list[str]) -> str:
    return ",".join(["Run Id", "Name", *map(title_case, columns)])


def sql_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sql_lines(rows: DataFrame, run_id: str, section: str, columns: list[str], compat: bool = True, table: str = "audit_report") -> DataFrame:
    """rows with an INSERT statement in ``line``; without compat NULL is the SQL NULL."""
    names = ",".join(f"`{c}`" for c in ["run_id", "report_type", *columns])
    quoted = lambda c: F.concat(F.lit("'"), sql_escape(_value(c, True)), F.lit("'")) if compat else F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), sql_escape(c.cast("string")), F.lit("'")))
    return rows.withColumn("line", F.concat(F.lit(f"INSERT INTO `{table}` ({names}) VALUES ('{run_id}','{title_case(section)}',"), F.concat_ws(",", *[quoted(F.col(c)) for c in columns]), F.lit(");")))


def sql_table(columns: list[str], table: str = "audit_report") -> str:
    """DDL of the dump's table; each column once, in first-seen order."""
    fields = "".join(f"  `{c}` varchar(2048) NOT NULL DEFAULT '',\n" for c in dict.fromkeys(columns) if c not in ("id", "run_id"))
    return f"DROP TABLE IF EXISTS `{table}`;\nCREATE TABLE `{table}` (\n  `id` int(11) unsigned NOT NULL AUTO_INCREMENT,\n  `run_id` varchar(36) NOT NULL DEFAULT '',\n  `report_type` varchar(36) NOT NULL DEFAULT '',\n{fields}  PRIMARY KEY (`id`),\n  KEY `run_id` (`run_id`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;\n"


# The markup of test suites and of worksheets, which readers of these files expect.
SUITE = '<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{suite}-{kind}" tests="{tests}" timestamp="{now}" time="{elapsed}" errors="{errors}" failures="" id="{run_id}" package="{suite}" skipped="0">\n'
CELL = ('<Cell><Data ss:Type="String">', "</Data></Cell>")
WORKBOOK = '<?xml version="1.0"?>\n<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:x="urn:schemas-microsoft-com:office:excel" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">'
SHEET = '<Worksheet ss:Name="{name}"><Table ss:ExpandedColumnCount="{columns}" x:FullColumns="1" x:FullRows="1">'


def junit_pieces(parts: list[tuple[str, DataFrame]], kind: str, run_id: str, now: datetime, elapsed: float, compat: bool = True, suite: str = "audit") -> Iterator[str]:
    """JUnit XML a piece at a time: a testcase per (section, rows in order), one error element with all its addresses.

    The driver holds a partition of a section at a time, not its addresses.
    """
    counts = [rows.count() for _, rows in parts]
    yield SUITE.format(suite=suite, kind=kind, tests=len(parts), now=now, elapsed=elapsed, errors=sum(counts), run_id=run_id)
    for (name, rows), n in zip(parts, counts):
        yield f'\t<testcase name="{name}">\n'
        if n:
            yield '\t\t<error type="addresses">'
            address = F.col("address") if compat else xml_escape(F.col("address"))
            for k, r in enumerate(rows.select(address.alias("a")).toLocalIterator()):
                yield (", " if k else "") + str(r["a"])
            yield "</error>\n"
        yield "\t</testcase>\n"
    yield "</testsuite>"


def junit(sections: DataFrame, kind: str, run_id: str, now: datetime, elapsed: float, compat: bool = True, suite: str = "audit") -> str:
    """The same from reports.junit_sections, whose rows hold all addresses of a section: for reports of a bounded size."""
    addresses = F.col("addresses") if compat else xml_escape(F.col("addresses"))
    rows = sections.orderBy("section_ord").select("section", "errors", addresses.alias("a")).collect()
    cases = "".join(f'\t<testcase name="{r["section"]}">\n' + (f'\t\t<error type="addresses">{r["a"]}</error>\n' if r["errors"] else "") + "\t</testcase>\n" for r in rows)
    return SUITE.format(suite=suite, kind=kind, tests=len(rows), now=now, elapsed=elapsed, errors=sum(r["errors"] for r in rows), run_id=run_id) + f"{cases}</testsuite>"


def xls_pieces(parts: Iterator[tuple[str, list[str], DataFrame]], run_id: str, compat: bool = True) -> Iterator[str]:
    """SpreadsheetML a piece at a time: a worksheet of text cells for each non-empty section; the driver holds a partition at most."""
    cell = lambda v: v.join(CELL)
    yield WORKBOOK
    for name, columns, rows in parts:
        values = [F.concat(F.lit(CELL[0]), v if compat else xml_escape(v), F.lit(CELL[1])) for v in (_value(F.col(c), compat) for c in columns)]
        begun = False
        for r in rows.select(F.concat(F.lit(cell(run_id)), *values).alias("line")).toLocalIterator():
            if not begun:
                head = "".join(map(cell, ["Run Id", *map(title_case, columns)]))
                yield SHEET.format(name=title_case(name), columns=(2 if compat else 1) + len(columns)) + f"<Row>{head}</Row>"
                begun = True
            yield f"<Row>{r['line']}</Row>"
        if begun:
            yield "</Table></Worksheet>"
    yield "\n</Workbook>"


def xls(parts: Iterator[tuple[str, list[str], DataFrame]], run_id: str, compat: bool = True) -> str:
    return "".join(xls_pieces(parts, run_id, compat))


FORMATS = ("junit", "csv", "xls", "sql")


def report_pieces(urls: DataFrame, kind: str, form: str, run_id: str, now: datetime | None = None, compat: bool = True) -> Iterator[str]:
    """A whole report of a crawl_urls table in one of the formats, a piece at a time."""
    if form not in FORMATS:
        raise ValueError(f"unknown report format {form}")
    began = datetime.now()
    parts = reports.parts(urls, kind, run_id)
    if form == "junit":
        yield from junit_pieces([(n, rows) for n, _, rows in parts], kind, run_id, now or began, (datetime.now() - began).total_seconds(), compat)
    elif form == "xls":
        yield from xls_pieces(iter(parts), run_id, compat)
    else:
        if form == "sql":
            yield sql_table([c for _, columns, _ in parts for c in columns])
        for name, columns, rows in parts:
            if form == "csv":
                yield csv_header(columns) + "\n"
            lines = csv_lines(rows, run_id, name, columns, compat) if form == "csv" else sql_lines(rows, run_id, name, columns, compat)
            for r in lines.select("line").toLocalIterator():
                yield r["line"] + "\n"


def write_report(pieces: Iterator[str], path: str | None = None, upload: Callable[[str], object] | None = None) -> None:
    """Writes a report to a file of the driver, or prints it; upload, if given, gets the path of the finished file."""
    if path is None:
        for p in pieces:
            print(p, end="")
        return
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(pieces)
    if upload is not None:
        upload(path)


def html_file_name(address: Column) -> Column:
    """The first 50 characters, then schemes taken out and slashes doubled to underscores."""
    name = F.substring(address, 1, 50)
    for a, b in (("http://", ""), ("https://", ""), ("/", "__")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return F.concat(name, F.lit(".html"))


def html_files(urls: DataFrame) -> DataFrame:
    """(file_name, body) of HTML pages; of pages whose names collide the last stays."""
    pages = urls.where("content_type = 'text/html'").select(html_file_name(F.col("address")).alias("file_name"), "body", "timestamp", "id")
    return pages.groupBy("file_name").agg(F.max_by("body", F.struct("timestamp", "id")).alias("body"))


def write_html_files(urls: DataFrame, folder: str) -> None:
    """One file per page below folder, a path that executors share: all of them, or none if a task fails."""
    from auditloom.sources.files import write_files

    write_files(html_files(urls), folder)
