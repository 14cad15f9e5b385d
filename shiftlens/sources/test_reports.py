"""JUnit reports and the failure texts built from them."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ISSUE_NAMES = (("error", "error"), ("failure", "failed"), ("skipped", "skipped"))
REPORT_SCHEMA = (
    "seconds double, cases array<struct<name:string,classname:string,outcome:string,time:double,details:string>>"
)


def _report(xml: str | None) -> dict | None:
    """One report; a bare suite is a report with one, and what is no XML is no report."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None
    if root is None:
        return None
    suites = root.findall("testsuite") if root.tag == "testsuites" else [root]
    cases = []
    for case in (c for suite in suites for c in suite.iterfind("testcase")):
        # an error outranks a failure, which outranks a skip
        hits = ((case.find(tag), outcome) for tag, outcome in _ISSUE_NAMES)
        issue, outcome = next((h for h in hits if h[0] is not None), (None, "passed"))
        details = "" if issue is None else (issue.text or issue.get("message", ""))
        cases.append({
            "name": case.get("name", "?"),
            "classname": case.get("classname", ""),
            "outcome": outcome,
            "time": float(case.get("time") or 0),
            "details": details[:6000],
        })
    return {"seconds": sum(float(s.get("time") or 0) for s in suites), "cases": cases}


def _reports(xml: pa.Array) -> pa.Array:
    # Spark's own from_xml sets up a parser per row, which costs a hundred times the parsing
    case = pa.struct([(n, pa.float64() if n == "time" else pa.string()) for n in ("name", "classname", "outcome", "time", "details")])
    kind = pa.struct([("seconds", pa.float64()), ("cases", pa.list_(case))])
    return pa.array([_report(x) for x in xml.to_pylist()], kind)


def parsed(reports: DataFrame) -> DataFrame:
    """Reports with a ``report`` column in place of ``xml``."""
    # declared so that a filter on the result is not pushed down and the text parsed twice
    parse = F.arrow_udf(_reports, REPORT_SCHEMA).asNondeterministic()
    return reports.withColumn("report", parse("xml")).drop("xml")


def cases(reports: DataFrame) -> DataFrame:
    """One row per test case."""
    rows = parsed(reports)
    keep = [c for c in rows.columns if c != "report"]
    return rows.select(*keep, F.explode("report.cases").alias("c")).select(*keep, "c.*")


def totals(reports: DataFrame) -> DataFrame:
    """Counts per report and the time its suites took, without a shuffle."""
    rows = parsed(reports)
    keep = [c for c in rows.columns if c != "report"]

    def count(outcome: str) -> Column:
        return F.size(F.filter("report.cases", lambda c: c["outcome"] == outcome)).cast("long")

    return rows.filter(F.col("report.cases").isNotNull()).select(
        *keep,
        F.bround("report.seconds", 3).alias("duration_seconds"),
        F.size("report.cases").cast("long").alias("total"),
        count("passed").alias("passed"),
        count("failed").alias("failed"),
        count("error").alias("errors"),
        count("skipped").alias("skipped"),
    )


def failure_context(details: Column, stdout: Column, stderr: Column, limit: int = 12000) -> Column:
    """Failing cases and both output streams, the end of it."""
    streams = T.elided(T.strip(F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))))
    return T.last_characters(T.strip(F.array_join(F.concat(details, F.array(streams)), "\n\n")), limit)


def case_text(classname: Column, name: Column, outcome: Column, details: Column) -> Column:
    return F.format_string("%s::%s (%s):\n%s", classname, name, outcome, details)
