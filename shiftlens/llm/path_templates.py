"""URL rules, and a tree of path templates per host that judges what no rule decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lower_ascii, written

#: A segment with one url in so many of its node stands by itself.  The others of the node are one variable segment if two of its
#: urls meet in one of them less often than that, and would still with ``SPARE`` meetings more.  Both are shares, so that
#: they come out alike on small and large tables.
COMMON, SPARE = 16, 3
#: A branch without labels is like rejected (or accepted) siblings if so much of what lies below it points to these.
LIKE = 0.6
#: The smoothed share of rejected labels from which a template is rejected, and the weight of what it is smoothed with.
REJECT, WEIGHT = 0.5, 4.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (host, path) rule whose host, or a host under it, has the path's beginning; NULL if none."""
    found = F.lit(None).cast("string")
    for rule_host, rule_path in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found)
    return found


def _shapes(path: Column) -> Column:
    """The segments, with numbers and long hexadecimal strings as placeholders."""
    shaped = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{h}"), r"[0-9]+", "{n}")
    return F.split(F.regexp_replace(shaped, "^/", ""), "/")


def _levels(state: DataFrame, children: int) -> list[int]:
    """The levels at which some host has that many different segments; at the others there is nothing to do.  One number a level."""
    segments = state.select("host", F.posexplode("template").alias("level", "segment"))
    found = segments.groupBy("host", "level").agg(F.count_distinct("segment").alias("n")).filter(F.col("n") >= children)
    return sorted(r["level"] for r in found.select("level").distinct().collect())


def _at(state: DataFrame, level: int) -> DataFrame:
    """Adds the node at a level (``head``), the ``segment`` there and the ``rest`` below, of rows that are as deep."""
    return state.withColumns({
        "head": F.slice("template", 1, level), "segment": F.get("template", F.lit(level)),
        "rest": F.slice("template", F.lit(level + 2), F.greatest(F.size("template") - (level + 1), F.lit(0))),
    })


def _named(at: DataFrame, names: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows with ``name`` in place of their segment where ``names`` has one for their keys."""
    template = F.when(F.col("name").isNotNull(), F.concat("head", F.array("name"), "rest")).otherwise(F.col("template"))
    return at.join(names, keys, "left").withColumn("template", template).select(*columns)


def _general(state: DataFrame) -> DataFrame:
    """Wildcards for variable segments, level by level from the root."""
    for level in _levels(state, SPARE):
        at = _at(state, level)
        children = at.filter("segment IS NOT NULL").groupBy("host", "head", "segment").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "head").agg(F.sum("n").alias("all"))
        rare = children.join(nodes, ["host", "head"]).filter(F.col("n") * COMMON < F.col("all")).select("host", "head", "segment", "n")
        met = F.sum(F.col("n") * (F.col("n") - 1)) + 2 * SPARE
        wide = rare.groupBy("host", "head").agg(met.alias("met"), F.sum("n").alias("all")).filter(F.col("met") * COMMON <= F.col("all") * (F.col("all") - 1))
        names = rare.join(wide, ["host", "head"], "left_semi").select("host", "head", "segment", F.lit("*").alias("name"))
        state = written(_named(at, names, ["host", "head", "segment"], state.columns), "templates")
    return state


def _merged(state: DataFrame) -> DataFrame:
    """Branches below one node that are alike are merged where they lead to the same rest, level by level from the root.

    A branch with labels is on the side of most of them (accepted if they are even).  One without is held against both
    sides by what lies below it: each rest points to a side by the share of the side's urls that have it, against
    the same share of the other side.  It joins the side to which ``LIKE`` of its urls point, and none if rests are
    common to both or not known.  Branches of one side and rest become ``*-`` (rejected) or ``*+``.
    """
    for level in _levels(state, 2):
        at = _at(state, level)
        node, branch = ["host", "head"], ["host", "head", "segment"]
        cells = at.filter("segment IS NOT NULL").groupBy(*branch, "rest").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
        branches = cells.groupBy(*branch).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "labelled")])
        side = F.when(F.col("all_labelled") > 0, F.when(2 * F.col("all_bad") > F.col("all_labelled"), F.lit("*-")).otherwise(F.lit("*+")))
        cells = written(cells.join(branches.withColumn("side", side), branch), "branches")
        sums = [F.sum(F.when(F.col("side") == name, F.col("n")).otherwise(0)).alias(c) for c, name in (("minus", "*-"), ("plus", "*+"))]
        known = cells.filter("side IS NOT NULL")
        below = known.groupBy(*node, "rest").agg(*sums).join(
            known.groupBy(*node).agg(*[s.alias(f"all_{c}") for s, c in zip(sums, ("minus", "plus"), strict=True)]), node
        )
        minus = F.coalesce(F.try_divide("minus", "all_minus"), F.lit(0.0))
        plus = F.coalesce(F.try_divide("plus", "all_plus"), F.lit(0.0))
        points = below.select(*node, "rest", (minus / (minus + plus)).alias("to_minus"))
        like = (
            cells.filter("side IS NULL").join(points, [*node, "rest"]).groupBy(*branch)
            .agg((F.sum(F.col("n") * F.col("to_minus")) / F.first("all_n")).alias("minus"), (F.sum(F.col("n") * (1 - F.col("to_minus"))) / F.first("all_n")).alias("plus"))
            .select(*branch, F.when(F.col("minus") >= LIKE, F.lit("*-")).when(F.col("plus") >= LIKE, F.lit("*+")).alias("found"))
        )
        sided = cells.join(like, branch, "left").withColumn("name", F.coalesce("side", "found")).filter("name IS NOT NULL")
        several = sided.groupBy(*node, "rest", "name").agg(F.count("*").alias("branches")).filter("branches > 1")
        names = sided.join(several, [*node, "rest", "name"], "left_semi").select(*branch, "rest", "name")
        state = written(_named(at, names, [*branch, "rest"], state.columns), "merged")
    return state


def template_verdicts(urls: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, bad_share, rejected) for each host and shape of path.

    ``urls`` has host, path and ``bad`` (1 rejected, 0 accepted, NULL unlabelled).  The share of rejected labels of a
    template is smoothed with that of its parent's other templates, this with that of the host's others, and this with
    that among all labels (0 without any), each at the weight of four.  A template without labels is not rejected.
    There is no limit on depth; a level at which no host branches costs no job.
    """
    paths = urls.groupBy("host", _shapes(F.col("path")).alias("shape")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled")
    )
    merged = _merged(_general(written(paths.withColumn("template", F.col("shape")), "paths")))
    totals = [F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")]
    prior = merged.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior")).select("prior").scalar()
    templates = merged.groupBy("host", "template").agg(*totals).withColumn("parent", F.slice("template", F.lit(1), F.size("template") - 1))
    for keys, name in ((["host"], "host"), (["host", "parent"], "parent")):
        above = templates.groupBy(*keys).agg(F.sum("bad").alias(f"{name}_bad"), F.sum("labelled").alias(f"{name}_labelled"))
        templates = templates.join(above, keys)

    def smoothed(bad: Column, labelled: Column, share: Column) -> Column:
        return (bad + WEIGHT * share) / (labelled + WEIGHT)

    share = smoothed(F.col("host_bad") - F.col("parent_bad"), F.col("host_labelled") - F.col("parent_labelled"), prior)
    share = smoothed(F.col("parent_bad") - F.col("bad"), F.col("parent_labelled") - F.col("labelled"), share)
    judged = templates.select("host", "template", F.col("labelled").alias("all_labelled"), smoothed(F.col("bad"), F.col("labelled"), share).alias("bad_share"))
    return merged.join(judged, ["host", "template"]).select(
        "host", "shape", F.array_join("template", "/").alias("template"), F.col("all_labelled").alias("labelled"), "bad_share", ((F.col("all_labelled") > 0) & (F.col("bad_share") >= REJECT)).alias("rejected")
    )


def judge_urls(pages: DataFrame, allow: Sequence[tuple[str, str]], block: Sequence[tuple[str, str]], *, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, template, bad_share, verdict) of every row.

    What a rule decides is also what the tree learns from; a template that it rejects is blocked.  NULL urls and
    those without ``://`` have an empty host and path and are judged as such; equal rows are judged alike.
    No rows: no rows.  ``allow`` and ``block`` are short lists, written into the plan.
    """
    rows = pages.select(F.col(id_column).alias("_id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    allowed, blocked = rule_of(F.col("host"), F.col("path"), allow), rule_of(F.col("host"), F.col("path"), block)
    wins = F.coalesce(F.length(blocked), F.lit(-1)) > F.coalesce(F.length(allowed), F.lit(-1))
    rows = rows.select("*", F.when(wins, blocked).otherwise(allowed).alias("rule"), F.when(wins, 1).when(allowed.isNotNull(), 0).alias("bad"))
    judged = template_verdicts(rows)
    found = rows.withColumn("shape", _shapes(F.col("path"))).join(judged, ["host", "shape"], "left")
    bad = F.coalesce(F.col("bad") == 1, F.col("rejected"), F.lit(False))
    return found.select(
        F.col("_id").alias(id_column), "host", "path", "rule", "template", "bad_share", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("verdict")
    )
