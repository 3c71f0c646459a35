"""The policy rules over a generated tree of files, each with a DuckDB statement.

DuckDB reads no YAML, so for permissions the expected violations are stated.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import policy

_FLOWS = ".github/workflows/"
_PIN = "0123456789abcdef" * 2 + "01234567"
_JOB = f"jobs:\n  build:\n    runs-on: box\n    steps:\n      - uses: own/step@{_PIN}\n"
_READ = "permissions:\n  contents: read\n"
#: Path, text, whether it is a file, whether it is tracked.
TREE = [
    ("README.md", "# Engine\r\nAll Work Is Reviewed.\n", True, True),
    ("docs/rules.md", "nothing of note\n", True, True),
    ("docs/gone.md", None, False, True),
    ("keys/.env", "A=1", True, True),
    ("keys/local/.env", "A=1", True, False),
    ("keys/id_rsa", "x", True, True),
    ("keys/old.PEM", "x", True, True),
    ("keys/.pem", "x", True, True),
    ("keys/a.b.p12", "x", True, True),
    ("keys/auth.json", None, False, True),
    (_FLOWS + "good.yml", f"on: push\n{_READ}{_JOB}", True, True),
    (_FLOWS + "sub/deep.yml", "permissions: write-all\n", True, True),
    (_FLOWS + "notes.txt", "permissions: write-all\n", True, True),
    (_FLOWS + "odd.yXml", f"{_READ}{_JOB}", True, True),
    (_FLOWS + "target.yaml", f"on:\n  pull_request_target:\n{_READ}{_JOB}", True, True),
    (_FLOWS + "flow-target.yaml", f"on: [pull_request_target]\n{_READ}{_JOB}", True, True),
    (_FLOWS + "pipe.yml", f"{_READ}{_JOB}      - run: CURL -fsS https://x.invalid/i |  bash -s\n", True, True),
    (_FLOWS + "tee.yml", f"{_READ}{_JOB}      - run: wget x | tee y | sh\n", True, True),
    (_FLOWS + "dependency-review.yml", f"on:\n  pull_request:\n  workflow_dispatch:\n{_READ}{_JOB}", True, True),
    (_FLOWS + "manual.yml", f"on:\n  workflow_dispatch:\n{_READ}{_JOB}", True, True),
    (_FLOWS + "actions.yml", f"{_READ}{_JOB}      - uses: own/tag@v1\n      - uses: own/bare # note\n      - uses: ./here\n      - uses:\n          own/next@main\n      - uses: 'own/quoted@{_PIN}'\n      - uses: docker://img@sha256:ab\n", True, True),
    (_FLOWS + "codeql.yml", f"permissions:\n  contents: read\n  security-events: write\n{_JOB}", True, True),
    (_FLOWS + "other-scan.yml", f"permissions:\n  security-events: write\n{_JOB}", True, True),
    (_FLOWS + "write.yml", f"permissions: write-all\n{_JOB}", True, True),
    (_FLOWS + "read.yml", f"permissions: read-all\n{_JOB}", True, True),
    (_FLOWS + "null.yml", f"permissions:\n{_JOB}", True, True),
    (_FLOWS + "none.yml", _JOB, True, True),
    (_FLOWS + "list.yml", "- permissions\n", True, True),
    (_FLOWS + "access.yml", f"permissions: {{contents: admin, issues: none, packages: [write], pages: write}}\n{_JOB}", True, True),
    (_FLOWS + "jobs.yml", f"{_READ}jobs: [a]\n", True, True),
    (_FLOWS + "job-level.yml", f"{_READ}jobs:\n  a: {{permissions: write-all}}\n  b: {{permissions: {{packages: write}}}}\n  c: text\n  d: {{runs-on: box}}\n  e: {{permissions: }}\n", True, True),
]
REQUIRED = ["README.md", "docs/gone.md", "docs/never.md", _FLOWS + "good.yml"]
MARKERS = [("README.md", "all work is reviewed"), ("docs/rules.md", "All Work Is Reviewed"), ("docs/rules.md", "NOTHING of note"), ("docs/never.md", "x")]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, None if t is None else bytearray(t.encode()), f, k) for p, t, f, k in TREE], policy.FILES)


def _texts(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    return files(spark).filter("content is not null").withColumn("text", policy.text_of(F.col("content")))


def _required(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in REQUIRED], "path string")


def _markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKERS, "path string, marker string")


def _run(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    return rule(spark)


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


_FILES_SQL = "f(path, text, is_file, tracked) AS (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(t)}, {f}, {k})" for p, t, f, k in TREE) + ")"
_REQUIRED_SQL = "r(path) AS (VALUES " + ", ".join(f"({_quoted(p)})" for p in REQUIRED) + ")"
_MARKERS_SQL = "m(path, marker) AS (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(t)})" for p, t in MARKERS) + ")"
_FLOWS_SQL = r"w AS (SELECT path, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM f WHERE is_file AND regexp_full_match(path, '\.github/workflows/[^/]*\.y[^/]*ml'))"
_PATHS = "SELECT path, 'required-path' AS rule, NULL::VARCHAR AS detail FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = r.path AND is_file)"
_MARKS = "SELECT path, 'required-marker', marker FROM f JOIN m USING (path) WHERE is_file AND NOT contains(lower(text), lower(marker))"
_TRIGGERS = r"""SELECT path, 'privileged-trigger', NULL FROM w WHERE contains(text, 'pull_request_target:')
  UNION ALL SELECT path, 'piped-download', NULL FROM w WHERE regexp_matches(text, '(?i)(curl|wget)\b[^\n|]*\|\s*(ba)?sh\b')
  UNION ALL SELECT path, 'manual-trigger', NULL FROM w WHERE path = '.github/workflows/dependency-review.yml' AND regexp_matches(text, '(?m)^[ \t]*workflow_dispatch[ \t]*:')"""
_ACTIONS = r"""SELECT path, CASE WHEN contains(a, '@') THEN 'mutable-action' ELSE 'unpinned-action' END, a FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^\s*-?\s*uses:\s*([^\s#]+)', 1)) AS a FROM w) x
  WHERE NOT starts_with(a, './') AND NOT (contains(a, '@') AND regexp_full_match(split_part(a, '@', -1), '[0-9a-f]{40}'))"""
_SECRETS = r"""SELECT path, 'credential-name', split_part(path, '/', -1) FROM f WHERE is_file AND tracked AND split_part(path, '/', -1) IN ('.env', 'auth.json', 'credentials.json', 'id_rsa', 'id_ed25519')
  UNION ALL SELECT path, 'key-file', lower(regexp_extract(split_part(path, '/', -1), '.(\.[^.]*)$', 1)) FROM f WHERE is_file AND tracked AND lower(regexp_extract(split_part(path, '/', -1), '.(\.[^.]*)$', 1)) IN ('.pem', '.p12', '.pfx')"""
_EXPECTED = [
    ("other-scan.yml", "workflow write-scope security-events"),
    ("write.yml", "workflow write-all"),
    ("read.yml", "workflow read-all"),
    ("null.yml", "workflow not-a-scope-mapping"),
    ("none.yml", "workflow no-permissions"),
    ("list.yml", "workflow not-a-mapping"),
    ("access.yml", "workflow invalid-access contents"),
    ("access.yml", "workflow invalid-access packages"),
    ("access.yml", "workflow write-scope pages"),
    ("jobs.yml", "workflow jobs-not-a-mapping"),
    ("job-level.yml", "job a write-all"),
    ("job-level.yml", "job b write-scope packages"),
    ("job-level.yml", "job e not-a-scope-mapping"),
]
_PERMITS = "SELECT * FROM (VALUES " + ", ".join(f"('{_FLOWS}{p}', 'permissions', '{d}')" for p, d in _EXPECTED) + ") p(path, rule, detail)"


def _sql(*parts: str) -> str:
    return f"WITH {_FILES_SQL}, {_REQUIRED_SQL}, {_MARKERS_SQL}, {_FLOWS_SQL} SELECT DISTINCT path, rule, detail FROM (SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS rule, NULL::VARCHAR AS detail WHERE false UNION ALL {' UNION ALL '.join(parts)}) x"


QUERIES = {
    "policy_required_paths": partial(_run, rule=lambda s: policy.missing_paths(files(s), _required(s))),
    "policy_required_markers": partial(_run, rule=lambda s: policy.missing_markers(_texts(s), _markers(s))),
    "policy_workflow_files": partial(_run, rule=lambda s: policy.workflows(files(s)).select("path")),
    "policy_triggers": partial(_run, rule=lambda s: policy.trigger_rules(policy.workflows(_texts(s)))),
    "policy_action_references": partial(_run, rule=lambda s: policy.action_rules(policy.workflows(_texts(s)))),
    "policy_permissions": partial(_run, rule=lambda s: policy.permission_rules(policy.workflows(_texts(s)))),
    "policy_secret_files": partial(_run, rule=lambda s: policy.secret_files(files(s))),
    "policy_violations": partial(_run, rule=lambda s: policy.violations(files(s), _required(s), _markers(s))),
}
ORACLE = {
    "policy_required_paths": _sql(_PATHS),
    "policy_required_markers": _sql(_MARKS),
    "policy_workflow_files": f"WITH {_FILES_SQL}, {_FLOWS_SQL} SELECT path FROM w",
    "policy_triggers": _sql(_TRIGGERS),
    "policy_action_references": _sql(_ACTIONS),
    "policy_permissions": _PERMITS,
    "policy_secret_files": _sql(_SECRETS),
    "policy_violations": _sql(_PATHS, _MARKS, _TRIGGERS, _ACTIONS, _PERMITS, _SECRETS),
}
