"""Queries over file texts, failure outputs and test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import predicates as B
from ..functions import text as T
from ..operators import failures as X
from ..sources import repo_files as S
from ..sources import test_reports as J
from . import relations as R
from .catalogue import growing, over

# ------------------------------------------------------------------------ repository files

_DENIED = r"(?i)^(\.env|\.env\..*|.*\.pem|.*\.key|.*\.p12|.*\.pfx|id_rsa.*|id_ed25519.*|id_ecdsa.*|credentials.*|.*credentials\.json|service-account.*\.json|\.netrc|\.npmrc|\.pypirc|htpasswd|.*\.htpasswd)$"
_OTHER = f"""
, o AS (SELECT *, string_split(path, '/') AS parts, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS place
        FROM repo_texts WHERE NOT regexp_matches(path, '[^/.][^/]*\\.py$') AND NOT list_contains(string_split(path, '/'), '.git')
        AND NOT regexp_matches(string_split(path, '/')[-1], '{_DENIED}')),
z AS (SELECT *, CASE WHEN regexp_matches(lower(path), '\\.(html|jinja|jinja2|sql|toml|yaml|yml)$') THEN text ELSE '' END AS body FROM o),
b AS (SELECT repo, path, parts, place, substring(body, 1, CAST(greatest(0, 24000 - coalesce(sum(length(body)) OVER (PARTITION BY repo ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT)) AS body FROM z)
"""


@growing(
    "S-01 K-16",
    over("repo_texts", "SELECT repo, path, text FROM repo_texts WHERE path LIKE '%.py' AND NOT list_contains(string_split(path, '/'), '.git')"),
)
def python_files(spark: SparkSession, folder: str) -> DataFrame:
    return S.python_files(R.repo_texts(spark, folder))


@growing(
    "S-02",
    over("repo_texts", _OTHER + """SELECT repo, path, CAST(place AS INTEGER) AS place FROM o WHERE place <= 10
         UNION ALL SELECT repo, '… (truncated)', 11 FROM o WHERE place = 10"""),
)
def non_python_listing(spark: SparkSession, folder: str) -> DataFrame:
    return S.listing(R.repo_texts(spark, folder), 10)


@growing("S-03 W-03", over("repo_texts", _OTHER + "SELECT repo, path, body FROM b WHERE place <= 500"))
def content_budget(spark: SparkSession, folder: str) -> DataFrame:
    return S.budgeted_text(R.repo_texts(spark, folder))


@growing(
    "W-03",
    over("repo_texts", """
, s AS (SELECT repo, path, text, sum(least(length(text), 12000)) OVER (PARTITION BY repo ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM repo_texts WHERE path LIKE '%.py')
SELECT repo, path, substring(text, 1, CAST(least(12000, 60000 - coalesce(spent, 0)) AS BIGINT)) AS body FROM s WHERE coalesce(spent, 0) < 60000"""),
)
def architecture_text(spark: SparkSession, folder: str) -> DataFrame:
    return S.architecture_text(R.repo_texts(spark, folder).filter(F.col("path").endswith(".py")))


@growing(
    "S-04",
    over("repo_texts", _OTHER + """SELECT repo, string_agg('--- ' || path || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY parts) AS context
         FROM b WHERE place <= 500 AND body <> '' GROUP BY repo"""),
)
def non_python_context(spark: SparkSession, folder: str) -> DataFrame:
    return S.context_text(S.budgeted_text(R.repo_texts(spark, folder)))


@growing(
    "S-05",
    over("repo_texts", """
, w AS (SELECT repo, path FROM repo_texts WHERE path LIKE '%.html' UNION SELECT DISTINCT repo, 'absent.txt' FROM repo_texts)
SELECT w.repo, w.path, CASE WHEN length(text) > 800 THEN substring(text, 1, 800) || chr(10) || '# … (truncated)' || chr(10) ELSE text END AS text
FROM w LEFT JOIN repo_texts r ON r.repo = w.repo AND r.path = w.path"""),
)
def read_files(spark: SparkSession, folder: str) -> DataFrame:
    files = R.repo_texts(spark, folder)
    wanted = files.filter(F.col("path").endswith(".html")).select("repo", "path")
    absent = files.select("repo", F.lit("absent.txt").alias("path")).distinct()
    return S.read_file(files, wanted.unionByName(absent), 800)


@growing("X-06 K-09", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return S.written(R.table(spark, folder, "documents")).select("doc_id", "content_hash")


@growing(
    "F-41",
    over("repo_texts", f"""
SELECT repo, path, length(text) AS n FROM repo_texts
WHERE path <> 'en/m2.py' AND NOT regexp_matches(string_split(path, '/')[-1], '{_DENIED}') AND path NOT LIKE '%.html'"""),
)
def visible_context(spark: SparkSession, folder: str) -> DataFrame:
    files = R.repo_texts(spark, folder)
    waiting = files.filter(F.col("path").endswith(".html"))
    seen = S.visible_context(files, F.lit("en/m2.py"), waiting)
    return seen.select("repo", "path", F.length("text").cast("long").alias("n"))


@growing(
    "F-26",
    over("repo_texts", f"SELECT repo, path, regexp_matches(string_split(path, '/')[-1], '{_DENIED}') AS denied FROM repo_texts"),
)
def denied_paths(spark: SparkSession, folder: str) -> DataFrame:
    return R.repo_texts(spark, folder).select("repo", "path", P.is_denied(F.col("path")).alias("denied"))


_PATHS = """
WITH p AS (SELECT DISTINCT CASE l_partkey % 7 WHEN 0 THEN 'src/tests/m' WHEN 1 THEN 'tests/a' WHEN 2 THEN 'src/test_' WHEN 3 THEN 'a/b/c' WHEN 4 THEN 'testsuite/x' WHEN 5 THEN 'pkg/' ELSE '' END
     || CASE l_suppkey % 6 WHEN 0 THEN '/tests' WHEN 1 THEN '/conftest.py' WHEN 2 THEN CAST(l_suppkey AS VARCHAR) || '_test.py' WHEN 3 THEN '/tests.py' WHEN 4 THEN '/__init__.py' ELSE CAST(l_partkey AS VARCHAR) || '.py' END AS path FROM lineitem)
"""


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    heads = ["src/tests/m", "tests/a", "src/test_", "a/b/c", "testsuite/x", "pkg/", ""]
    tails = [
        F.lit("/tests"), F.lit("/conftest.py"), F.concat(R.text_of("l_suppkey"), F.lit("_test.py")),
        F.lit("/tests.py"), F.lit("/__init__.py"), F.concat(R.text_of("l_partkey"), F.lit(".py")),
    ]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (part % 7 + 1).cast("int"))
    tail = F.element_at(F.array(*tails), (supplier % 6 + 1).cast("int"))
    return R.table(spark, folder, "lineitem").select(F.concat(head, tail).alias("path")).distinct()


@growing(
    "F-27 F-28",
    _PATHS + """
, n AS (SELECT path, string_split(path, '/')[-1] AS b FROM p)
SELECT path, b IN ('conftest.py', 'tests.py') OR b LIKE 'test\\_%' ESCAPE '\\' OR b LIKE '%\\_test.py' ESCAPE '\\' OR '/' || path LIKE '%/tests/%' AS oracle_test,
       CASE WHEN b = 'conftest.py' THEN 'basename "conftest.py" is reserved for pytest configuration' WHEN b = 'tests.py' THEN 'basename "tests.py" is a test module'
            WHEN b LIKE 'test\\_%' ESCAPE '\\' THEN 'basename "' || b || '" starts with forbidden prefix "test_"'
            WHEN b LIKE '%\\_test.py' ESCAPE '\\' THEN 'basename "' || b || '" ends with forbidden suffix "_test.py"'
            WHEN list_contains(string_split(path, '/'), 'tests') THEN 'path component "tests" marks a test tree' ELSE '' END AS reason
FROM n""",
)
def test_file_rules(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, folder).select("path", P.is_oracle_test(path).alias("oracle_test"), P.test_path_reason(path).alias("reason"))


@growing(
    "X-02",
    _PATHS + """
, q AS (SELECT path, string_split(regexp_replace(path, '\\.py$', ''), '/') AS parts FROM p),
r AS (SELECT path, CASE WHEN parts[-1] = '__init__' THEN parts[:-2] ELSE parts END AS parts FROM q)
SELECT path, array_to_string(parts[i:], '.') AS module FROM r, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
)
def module_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, folder).select("path", F.explode(P.module_names(F.col("path"))).alias("module"))


@growing(
    "X-03",
    _PATHS + """
, l AS (SELECT path, level FROM p, (SELECT unnest(range(0, 3)) AS level))
SELECT path, CAST(level AS INTEGER) AS level, array_to_string(list_concat(CASE WHEN level = 0 THEN [] ELSE list_slice(string_split(path, '/'), 1, greatest(len(string_split(path, '/')) - level, 0)) END, ['db', 'core']), '.') AS module FROM l""",
)
def relative_imports(spark: SparkSession, folder: str) -> DataFrame:
    rows = _paths(spark, folder).withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return rows.select("path", "level", P.resolve_module(F.lit("db.core"), F.col("level"), F.col("path")).alias("module"))


@growing(
    "X-23 F-39",
    _PATHS + """
SELECT path, string_split(path, '/')[-1] AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent,
       regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) AS suffix, CASE WHEN path LIKE 'src/%' THEN substring(path, 5) ELSE path END AS rel
FROM p""",
)
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, folder).select(
        "path", P.basename(path).alias("base"), P.parent(path).alias("parent"), P.suffix(path).alias("suffix"),
        P.relative_to(path, F.lit("src/")).alias("rel"),
    )


@growing(
    "F-34",
    over("repo_texts", """
, t AS (SELECT repo, path, path LIKE 'en/%' OR path = 'fr' OR path LIKE 'fr/%' AS hit FROM repo_texts),
a AS (SELECT repo, bool_or(hit) AS found FROM t GROUP BY repo)
SELECT t.repo, t.path FROM t WHERE hit UNION ALL SELECT repo, s FROM a, (SELECT unnest(['en', 'fr']) AS s) WHERE NOT found"""),
)
def scoped_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets within the sanctioned scopes; a repository with none runs all scopes."""
    scopes = ["en", "fr/"]
    rows = R.repo_texts(spark, folder).select("repo", "path")
    hits = rows.filter(B.in_scope(F.col("path"), scopes))
    none = rows.select("repo").distinct().join(hits, "repo", "left_anti")
    return hits.unionByName(none.select("repo", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("path")))


# ------------------------------------------------------------------------------- redaction


@growing(
    "X-01",
    """
SELECT doc_id, text || chr(10) || 'k [REDACTED:aws-access-key] g [REDACTED:github-token] s [REDACTED:slack-token] o [REDACTED:openai-key] a [REDACTED:google-api-key]'
  || chr(10) || 'db://svc:[REDACTED:url-credentials]@host password = "[REDACTED:secret-assignment]" token_x secret: "changeme-please"'
  || chr(10) || 'x [REDACTED:private-key] y [REDACTED:jwt] z' AS text
FROM documents""",
)
def scrub_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with secrets made from its own hash appended, then scrubbed."""
    digest = F.sha2(R.text_of("doc_id"), 256)
    planted = F.concat(
        F.col("text"),
        F.lit("\nk AKIA"), F.upper(F.substring(digest, 1, 16)),
        F.lit(" g ghp_"), F.substring(digest, 1, 36),
        F.lit(" s xoxb-"), F.substring(digest, 1, 12),
        F.lit(" o sk-"), F.substring(digest, 1, 24),
        F.lit(" a AIza"), F.substring(digest, 1, 35),
        F.lit("\ndb://svc:"), F.substring(digest, 1, 10), F.lit("@host password = \""), F.substring(digest, 1, 12),
        F.lit("\" token_x secret: \"changeme-please\"\nx -----BEGIN RSA PRIVATE KEY-----\n"), digest,
        F.lit("\n-----END RSA PRIVATE KEY----- y eyJ"), F.substring(digest, 1, 12), F.lit(".eyJ"), F.substring(digest, 1, 12),
        F.lit("."), F.substring(digest, 1, 12), F.lit(" z"),
    )
    return R.table(spark, folder, "documents").select("doc_id", T.scrub(planted).alias("text"))


@growing(
    "X-07",
    """
WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, chr(27) || '\\[[0-9;]*m', '', 'g'),
       '(line )\\d+|\\b\\d+(?:\\.\\d+)?s\\b|0x[0-9a-fA-F]+|/tmp/[^\\s:]+', '\\1<volatile>', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS stable FROM documents)
SELECT doc_id, sha256('a.py' || chr(10) || 'b.py' || chr(10) || stable || ' <volatile> line <volatile> at <volatile>' || chr(10) || 'd' || CAST(doc_id % 5 AS VARCHAR)) AS fingerprint
FROM s""",
)
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of one failure differ in times, lines and addresses but share the fingerprint."""
    noise = F.concat(
        F.regexp_replace("text", r"\s+$", ""), F.lit(" \x1b[31m"), (F.col("doc_id") % 7).cast("string"), F.lit(".5s\x1b[0m line "), R.text_of("doc_id"), F.lit(" at 0xAF"),
        F.hex("doc_id"), F.lit("\n"),
    )
    diff = F.concat(F.lit("  d"), (F.col("doc_id") % 5).cast("string"), F.lit("\n"))
    return R.table(spark, folder, "documents").select(
        "doc_id", T.failure_fingerprint(noise, diff, F.array(F.lit("b.py"), F.lit("a.py"))).alias("fingerprint")
    )


@growing(
    "X-04 X-13",
    """
SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(13) || chr(9)) || chr(10) AS code,
       CASE WHEN turn % 2 = 0 THEN '[' || CAST(turn AS VARCHAR) || ']' ELSE 'no json ' || CAST(turn AS VARCHAR) END AS payload
FROM conversations""",
)
def fenced_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies wrapped in fences, every third without one."""
    fenced = F.concat(F.lit("Here it is\n```python\n"), F.col("text"), F.lit("```\nand ```x\nmore```"))
    reply = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(fenced)
    number = F.col("turn").cast("string")
    payload = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ```json\n["), number, F.lit("]\n``` "))).otherwise(F.concat(F.lit("no json "), number))
    return R.table(spark, folder, "conversations").select(
        "conv_id", "turn", T.extract_code(reply).alias("code"), T.json_payload(payload).alias("payload")
    )


@growing(
    "X-10 X-12",
    """
WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'mod' || CAST(user_id AS VARCHAR) || '.x' END AS module,
    CASE event_id % 4 WHEN 1 THEN 'sym_' || CAST(user_id AS VARCHAR) END AS symbol, CASE event_id % 4 WHEN 1 THEN 'pkg.' || event_type END AS symbol_module,
    CASE event_id % 4 WHEN 2 THEN event_type END AS member, event_id % 4 < 2 AS crashed FROM events)
SELECT *, CASE WHEN event_id % 4 = 3 THEN 'assert 1 == 2 ' ELSE NULL END AS region FROM o""",
)
def failure_messages(spark: SparkSession, folder: str) -> DataFrame:
    user, kind = R.text_of("user_id"), F.col("event_type")
    which = F.col("event_id") % 4
    output = (
        F.when(which == 0, F.concat(F.lit("E ModuleNotFoundError: No module named 'mod"), user, F.lit(".x'")))
        .when(which == 1, F.concat(F.lit("ImportError: cannot import name 'sym_"), user, F.lit("' from 'pkg."), kind, F.lit("' (x.py)")))
        .when(which == 2, F.concat(F.lit("AttributeError: 'Db' object has no attribute '"), kind, F.lit("'")))
        .otherwise(F.lit("assert 1 == 2 short test summary info\nFAILED tests/test_a.py"))
    )
    rows = R.table(spark, folder, "events").select("event_id", output.alias("output"))
    text = F.col("output")
    return rows.select(
        "event_id",
        T.missing_module(text).alias("module"),
        T.missing_name(text).alias("symbol"),
        T.missing_name_module(text).alias("symbol_module"),
        T.missing_attribute(text).alias("member"),
        T.crashed(text).alias("crashed"),
        F.when(text.contains(T.SUMMARY_LINE), T.trace_region(text)).alias("region"),
    )


@growing(
    "F-33",
    "SELECT doc_id, doc_id % 3 = 0 AS missing FROM documents",
)
def missing_compat(spark: SparkSession, folder: str) -> DataFrame:
    module = F.when(F.col("doc_id") % 3 == 0, "lib.compat_layer").otherwise("lib.compat_layer2")
    output = F.concat(F.col("text"), F.lit("\nModuleNotFoundError: No module named '"), module, F.lit("'\n"))
    return R.table(spark, folder, "documents").select("doc_id", T.lacks_compat_module(output, F.lit("lib/compat_layer.py")).alias("missing"))


@growing(
    "G-15 S-14 K-15",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, count(*) FILTER (i % 3 = 1 AND NOT line LIKE '++%') AS a, count(*) FILTER (i % 3 = 2 AND NOT line LIKE '--%') AS d FROM l GROUP BY doc_id)
SELECT doc_id, CAST(1 + doc_id % 2 AS BIGINT) AS files, a AS additions, d AS deletions FROM c""",
)
def diff_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A diff made of every document's lines: added, removed and kept in turn."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), F.regexp_replace(x, "[\r\x0b\x0c\x1c-\x1e\x85  ]", "")),
    )
    head = F.lit("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n")
    tail = F.when(F.col("doc_id") % 2 == 1, "\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py").otherwise("")
    diff = F.concat(head, F.array_join(lines, "\n"), tail)
    return R.table(spark, folder, "documents").select("doc_id", T.diff_stats(diff).alias("s")).select("doc_id", "s.*")


@growing(
    "X-24",
    """SELECT doc_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS evidence FROM documents""",
)
def evidence_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return R.table(spark, folder, "documents").select("doc_id", T.evidence(F.col("text")).alias("evidence"))


@growing(
    "F-32",
    """
SELECT source AS repo, lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents d
WHERE doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def residue_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an old import on top, except those a label says are planned."""
    path = F.concat(F.col("lang"), F.lit("/"), R.text_of("doc_id"))
    docs = R.table(spark, folder, "documents").select(
        F.col("source").alias("repo"), path.alias("path"), "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("import flask\n"), F.col("text"))).otherwise(F.col("text")).alias("text"),
    )
    planned = docs.join(R.table(spark, folder, "labels"), "doc_id", "left_semi").select("repo", "path")
    return X.unplanned_residue(docs, planned)


# ---------------------------------------------------------------------------- attribution


_OWNERS = """
WITH o AS (SELECT event_id, CAST(event_id AS VARCHAR) AS job_id, event_id % 3 AS which, user_id % 6 AS u FROM events)
"""


def _failures(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One failure per event and three pinned files for it."""
    which, u = F.col("event_id") % 3, (F.col("user_id") % 6)
    output = (
        F.when(which == 0, F.concat(F.lit("ModuleNotFoundError: No module named 'app.m"), u.cast("string"), F.lit("'")))
        .when(which == 1, F.concat(F.lit("cannot import name 'f"), u.cast("string"), F.lit("' from 'app.m1'")))
        .otherwise(F.concat(F.lit("AttributeError: 'D' object has no attribute 'close"), u.cast("string"), F.lit("'")))
    )
    events = R.spread(R.table(spark, folder, "events").select("event_id", "user_id"))
    outputs = events.select(R.text_of("event_id").alias("job_id"), output.alias("output"))
    numbers = outputs.select("job_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    path = F.concat(F.lit("src/app/m"), F.col("i").cast("string"), F.lit(".py"))
    pins = numbers.select("job_id", path.alias("path"), F.concat(F.lit("f"), F.col("i").cast("string")).alias("symbol"), (F.col("i") != 3).alias("planned"))
    # m2 and m3 both pin close2, so nobody owns it alone
    member = F.concat(F.lit("close"), F.least(F.col("i"), F.lit(2)).cast("string"))
    members = numbers.select("job_id", path.alias("path"), F.concat(F.lit("f"), F.col("i").cast("string")).alias("symbol"), member.alias("member"))
    batch = numbers.select("job_id", path.alias("path"))
    consumers = numbers.select("job_id", path.alias("path"), F.concat(F.lit("f"), F.col("i").cast("string")).alias("symbol"), F.lit("src/app/m0.py").alias("consumer"))
    return {"outputs": outputs, "pins": pins, "members": members, "batch": batch, "consumers": consumers}


@growing(
    "J-13",
    _OWNERS + """
SELECT job_id, 'src/app/m' || CAST(u AS VARCHAR) || '.py' AS path FROM o
WHERE (which = 0 AND u < 3) OR (which = 1 AND u = 1) OR (which = 2 AND u < 2)""",
)
def contract_owners(spark: SparkSession, folder: str) -> DataFrame:
    f = _failures(spark, folder)
    return X.contract_owner(f["outputs"], f["pins"], f["members"].drop("symbol"), f["batch"])


@growing(
    "J-14",
    _OWNERS + """
SELECT job_id, CASE WHEN which = 2 AND u = 1 THEN 'src/app/m0.py' ELSE 'src/app/m' || CAST(u AS VARCHAR) || '.py' END AS target FROM o
WHERE (which = 0 AND u < 3) OR (which = 1 AND u = 1) OR (which = 2 AND u < 2)""",
)
def contract_targets(spark: SparkSession, folder: str) -> DataFrame:
    """m1 does implement its member, so its only consumer in the batch is at fault."""
    f = _failures(spark, folder)
    owners = X.contract_owner(f["outputs"], f["pins"], f["members"].drop("symbol"), f["batch"])
    implemented = f["members"].filter("path = 'src/app/m1.py'")
    return X.contract_target(owners, f["outputs"], f["members"], implemented, f["consumers"], f["batch"])


@growing(
    "X-11",
    """
SELECT CAST(event_id AS VARCHAR) AS job_id, 'src/app/m' || CAST(user_id % 3 AS VARCHAR) || '.py' AS path FROM events
WHERE event_id % 4 <> 1 AND (event_id % 4 <> 2 OR user_id % 3 = 0)""",
)
def traceback_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Logs with one or two tracebacks; a second one in another file leaves no single leaf."""
    which, u = F.col("event_id") % 4, (F.col("user_id") % 3).cast("string")
    first = F.concat(
        F.lit("/work/src/app/m0.py:3: in f\nsrc/other/x.py:4: in g\n/work/src/app/m"), u, F.lit(".py:9: in h\n    raise\nE   pkg.DbError: no\n")
    )
    second = F.when(which == 2, "src/app/m0.py:1: in k\nAssertionError\n").otherwise("E ValueError: late\n")
    output = F.when(which == 1, "tests/test_a.py:3: in t\nE AssertionError: x\n").otherwise(F.concat(first, second))
    events = R.spread(R.table(spark, folder, "events").select("event_id", "user_id"))
    outputs = events.select(R.text_of("event_id").alias("job_id"), output.alias("output"))
    eligible = outputs.select("job_id", F.explode(F.array(*[F.lit(f"src/app/m{i}.py") for i in range(3)])).alias("path"))
    return X.traceback_leaf(outputs, eligible)


_CLASSIFY = """
WITH v AS (SELECT event_id, event_id % 40 AS visit, 30 AS hard_limit, user_id % 6 AS used, event_id % 17 = 0 AS restoring, event_id % 5 = 0 AS integration,
  event_id % 19 = 0 AS compat, event_id % 23 = 0 AS residue, user_id % 3 = 0 AS has_contract, user_id % 4 = 0 AS has_leaf, event_type = 'error' AS crashed,
  event_id % 2 = 0 AS mentioned, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1 AS repeat, user_id % 2 AS repairs FROM events),
w AS (SELECT *, restoring OR (NOT integration AND (compat OR residue)) AS early, NOT integration AND (has_contract OR has_leaf) AS owned,
  NOT integration AND repeat >= 3 AS stalled, NOT integration AND repeat = 2 AS diagnosing FROM v),
x AS (SELECT *, early OR NOT (owned AND repairs < 1 AND NOT stalled AND repeat = 1) AS charged,
  CASE WHEN owned AND has_contract THEN 'contract_failure' WHEN owned THEN 'traceback_leaf' WHEN integration THEN 'integration_regression'
       WHEN crashed AND mentioned THEN 'crash_batch' ELSE 'behavioral' END AS kind FROM w)
SELECT event_id, CASE WHEN visit > hard_limit THEN 'hard_safety_cap' WHEN used + CAST(charged AS INTEGER) > 4 THEN 'budget_exhausted'
    WHEN restoring THEN 'restored_cut_reverify_failed' WHEN NOT integration AND compat THEN 'missing_test_compat' WHEN NOT integration AND residue THEN 'unplanned_residue'
    WHEN diagnosing THEN kind || '_no_progress_diagnostic' WHEN stalled THEN 'no_progress' ELSE kind END AS classification,
  CASE WHEN visit > hard_limit OR used + CAST(charged AS INTEGER) > 4 OR restoring THEN 'integrate' WHEN early THEN 'plan' WHEN stalled THEN 'integrate' ELSE 'execute' END AS route,
  CASE WHEN visit > hard_limit THEN false ELSE charged END AS budget_charged
FROM x
"""


@growing("Q-13", _CLASSIFY)
def recovery_decisions(spark: SparkSession, folder: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    visits = R.table(spark, folder, "events").select(
        "event_id",
        (e % 40).alias("visit"),
        F.lit(30).alias("hard_limit"),
        (u % 6).alias("budget_used"),
        F.lit(4).alias("max_visits"),
        (e % 17 == 0).alias("restoring"),
        (e % 5 == 0).alias("integration"),
        (e % 19 == 0).alias("missing_compat"),
        (e % 23 == 0).alias("residue"),
        F.when(u % 3 == 0, "a.py").alias("contract_owner"),
        F.when(u % 4 == 0, "b.py").alias("leaf_owner"),
        (F.col("event_type") == "error").alias("crashed"),
        (e % 2 == 0).alias("mentioned"),
        (R.props_k() % 4 + 1).alias("repeat"),
        (u % 2).alias("owner_repairs"),
        F.lit(1).alias("max_repairs"),
    )
    return X.classified(visits).select("event_id", "classification", "route", "budget_charged")


# --------------------------------------------------------------------------- test reports


def _junit(spark: SparkSession, folder: str) -> DataFrame:
    """A report per line item: 1 to 7 cases whose outcome follows from their number."""
    q = F.col("l_quantity").cast("int")

    def case(i):
        name = F.concat(F.lit("<testcase name=\"t"), i.cast("string"), F.lit("\" classname=\"k\" time=\"0.5\">"))
        body = (
            F.when((q + i) % 5 == 0, "<failure message=\"m\">boom &lt;1&gt;</failure>")
            .when((q + i) % 5 == 1, "<error message=\"only message\"/><failure>x</failure>")
            .when((q + i) % 5 == 2, "<skipped/>")
            .otherwise("")
        )
        return F.concat(name, body, F.lit("</testcase>"))

    cases = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), case), "")
    suite = F.concat(F.lit("<testsuite time=\"1.25\">"), cases, F.lit("</testsuite>"))
    whole = F.concat(F.lit("<testsuites>"), suite, F.lit("<testsuite time=\"0.5\"/></testsuites>"))
    lines = R.spread(R.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines.select(R.line_id().alias("id"), F.when(q % 2 == 0, suite).otherwise(whole).alias("xml"))


_JUNIT = """
WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS id, CAST(l_quantity AS INTEGER) AS q, i, (CAST(l_quantity AS INTEGER) + i) % 5 AS m
           FROM lineitem, LATERAL (SELECT unnest(range(1, l_linenumber + 1)) AS i))
"""


@growing(
    "S-08",
    _JUNIT + """
SELECT id, 't' || CAST(i AS VARCHAR) AS name, 'k' AS classname, CASE m WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'passed' END AS outcome,
       CAST(0.5 AS DOUBLE) AS time, CASE m WHEN 0 THEN 'boom <1>' WHEN 1 THEN 'only message' ELSE '' END AS details FROM c""",
)
def junit_cases(spark: SparkSession, folder: str) -> DataFrame:
    return J.cases(_junit(spark, folder))


@growing(
    "G-11 S-08",
    _JUNIT + """
SELECT id, CASE WHEN any_value(q) % 2 = 0 THEN 1.25 ELSE 1.75 END::DOUBLE AS duration_seconds, count(*) AS total, count(*) FILTER (m > 2) AS passed,
       count(*) FILTER (m = 0) AS failed, count(*) FILTER (m = 1) AS errors, count(*) FILTER (m = 2) AS skipped FROM c GROUP BY id""",
)
def junit_totals(spark: SparkSession, folder: str) -> DataFrame:
    return J.totals(_junit(spark, folder))


@growing(
    "G-22",
    """
SELECT doc_id, CASE WHEN length(body) > 12000 THEN right(body, 12000) ELSE body END AS context FROM (
  SELECT doc_id, trim('k::t1 (failed):' || chr(10) || 'boom' || chr(10) || chr(10) || CASE WHEN length(s) > 6000 THEN left(s, 3000) || chr(10) || '... output elided ...' || chr(10) || right(s, 3000) ELSE s END, w) AS body
  FROM (SELECT doc_id, ' ' || chr(10) || chr(13) || chr(9) AS w, trim(text || chr(10) || 'err', ' ' || chr(10) || chr(13) || chr(9)) AS s FROM documents))""",
)
def failure_contexts(spark: SparkSession, folder: str) -> DataFrame:
    case = J.case_text(F.lit("k"), F.lit("t1"), F.lit("failed"), F.lit("boom"))
    context = J.failure_context(F.array(case), F.col("text"), F.lit("err"))
    return R.table(spark, folder, "documents").select("doc_id", context.alias("context"))
