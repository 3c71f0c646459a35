"""Repository policy as queries over a table of files, and the rule for change titles.

``files`` has ``path``, ``content`` (bytes), ``is_file`` and ``tracked``.  Every
rule is a filter or a join that gives violations; all rules always run and
the result is distinct and sorted.  Rules about what a file must hold come as
tables, not as code.

Workflows are YAML, which Spark can't read: one function turns a document into
JSON, and the rules on it are expressions over variants and maps.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Title types, credential names, key suffixes, folders outside of Git that don't count, and the patterns of shell downloads, manual triggers and action references.
TITLE_TYPES = ["feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert"]
CREDENTIAL_NAMES = [".env", "auth.json", "credentials.json", "id_rsa", "id_ed25519"]
KEY_SUFFIXES = [".pem", ".p12", ".pfx"]
SKIPPED_FOLDERS = {".git", ".venv", "node_modules", "__pycache__"}
LONGEST_TITLE = 100
PRIVILEGED = "pull_request_target:"
PIPED = r"(?idU)(?:curl|wget)\b[^\n|]*\|\s*(?:ba)?sh\b"
MANUAL = r"(?md)^[ \t]*workflow_dispatch[ \t]*:"
ACTION = r"(?mdU)^\s*-?\s*uses:\s*([^\s#]+)"
WORKFLOW = r"\A\.github/workflows/[^/]*\.y[^/]*ml\z"
MANUAL_PATH = ".github/workflows/dependency-review.yml"
SCANNING_PATH = ".github/workflows/codeql.yml"

FILES = "path string, content binary, is_file boolean, tracked boolean"


def valid_title(title: Column) -> Column:
    """Type, optional scope and mark, colon, blank and a body of 3 to 73 characters; 100 in all; null is invalid."""
    pattern = rf"(?d)\A(?:{'|'.join(TITLE_TYPES)})(?:\([a-z0-9][a-z0-9._/-]*\))?!?: [a-z0-9].{{2,72}}\z"
    return F.coalesce(title.rlike(pattern) & (F.length(title) <= LONGEST_TITLE), F.lit(False))


def _shown(name: bytes) -> str:
    """A name as text; bytes that aren't UTF-8 are escaped."""
    return name.decode("utf-8", "backslashreplace")


def list_files(spark: SparkSession, root: str, texts: Iterable[str] = ()) -> DataFrame:
    """The files of a tree: those in the index of a Git tree, or all outside of ``SKIPPED_FOLDERS``.

    The paths in ``texts`` and the workflows are there too, whether tracked or
    not, and theirs is the only content that is read.  Spark's readers hide names
    that begin with a dot, so names are listed on the driver.
    """
    base = os.fsencode(root)
    names: set[bytes] | None = None
    if os.path.exists(os.path.join(base, b".git")):  # a folder, or a file in a linked tree
        got = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=False)
        if got.returncode == 0:
            names = set(filter(None, got.stdout.split(b"\0")))
    if names is None:
        names = set()
        for folder, folders, found in os.walk(base):
            folders[:] = [d for d in folders if os.fsdecode(d) not in SKIPPED_FOLDERS]
            names |= {os.path.relpath(os.path.join(folder, n), base) for n in found}
    flows = os.path.join(base, b".github", b"workflows")
    read = {os.fsencode(t) for t in texts} | ({b".github/workflows/" + n for n in os.listdir(flows)} if os.path.isdir(flows) else set())
    rows = []
    for name in sorted(names | read):
        path = os.path.join(base, name)
        there = os.path.isfile(path)
        content = None
        if there and name in read:
            with open(path, "rb") as file:
                content = bytearray(file.read())
        rows.append((_shown(name), content, there, name in names))
    return spark.createDataFrame(rows, FILES)


def text_of(content: Column) -> Column:
    """Strict UTF-8 with universal newlines; a file that isn't fails the run."""
    return F.regexp_replace(F.validate_utf8(content.cast("string")), "\r\n?", "\n")


def _violation(frame: DataFrame, rule: str | Column, detail: Column) -> DataFrame:
    return frame.select("path", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), detail.cast("string").alias("detail"))


def missing_paths(files: DataFrame, required: DataFrame) -> DataFrame:
    return _violation(required.join(files.filter("is_file"), "path", "left_anti"), "required-path", F.lit(None))


def missing_markers(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``markers`` has ``path`` and ``marker``; absent files are another rule's matter.  Both are case-folded."""

    @F.pandas_udf(StringType())
    def folded(text):
        return text.str.casefold()

    found = files.filter("is_file").select("path", folded("text").alias("text")).join(markers.withColumn("folded", folded("marker")), "path")
    return _violation(found.filter(~F.col("text").contains(F.col("folded"))), "required-marker", F.col("marker"))


def workflows(files: DataFrame) -> DataFrame:
    return files.filter(F.col("is_file") & F.col("path").rlike(WORKFLOW))


def trigger_rules(flows: DataFrame, manual_path: str = MANUAL_PATH) -> DataFrame:
    """Privileged triggers, downloads piped to a shell, and a manual trigger where a review needs its bounds."""
    text = F.col("text")
    privileged = _violation(flows.filter(text.contains(PRIVILEGED)), "privileged-trigger", F.lit(None))
    piped = _violation(flows.filter(text.rlike(PIPED)), "piped-download", F.lit(None))
    manual = _violation(flows.filter((F.col("path") == manual_path) & text.rlike(MANUAL)), "manual-trigger", F.lit(None))
    return privileged.unionByName(piped).unionByName(manual)


def action_rules(flows: DataFrame) -> DataFrame:
    """References to actions outside of the tree: each needs a full commit as its revision."""
    used = flows.select("path", F.explode(F.regexp_extract_all("text", F.lit(ACTION), 1)).alias("reference")).filter("not startswith(reference, './')")
    at = F.col("reference").contains("@")
    pinned = F.substring_index("reference", "@", -1).rlike(r"\A[0-9a-f]{40}\z")
    return _violation(used.filter(~at | ~pinned), F.when(at, "mutable-action").otherwise("unpinned-action"), F.col("reference"))


def secret_files(files: DataFrame) -> DataFrame:
    """Tracked files named like credentials or keys; a name that only is a suffix has none."""
    there = files.filter("is_file and tracked").withColumn("name", F.element_at(F.split("path", "/"), -1))
    dot = F.length("name") - F.length(F.substring_index("name", ".", -1))
    suffix = F.when(dot > 1, F.lower(F.concat(F.lit("."), F.substring_index("name", ".", -1))))
    named = _violation(there.filter(F.col("name").isin(CREDENTIAL_NAMES)), "credential-name", F.col("name"))
    return named.unionByName(_violation(there.filter(suffix.isin(KEY_SUFFIXES)), "key-file", suffix))


@F.udf(StructType().add("error", StringType()).add("document", StringType()))
def _yaml(text):
    """A YAML document as JSON, or what is wrong with it."""
    import json

    try:
        import yaml
    except ModuleNotFoundError:
        return "no-parser", None

    def plain(value):
        if isinstance(value, dict):
            return {k if isinstance(k, str) else json.dumps(k, default=str): plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return value if isinstance(value, (str, bool, int, type(None))) else str(value)

    try:
        return None, json.dumps(plain(yaml.safe_load(text)))
    except (yaml.YAMLError, RecursionError) as error:
        return f"invalid-yaml {error}", None


def _mapping(value: Column) -> Column:
    """An object as a map of variants; null for anything else."""
    return value.try_cast("map<string,variant>")


def _has(mapping: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(mapping, key), F.lit(False))


def permission_rules(flows: DataFrame, scanning_path: str = SCANNING_PATH) -> DataFrame:
    """Permissions broader than reading, but for security events at the workflow level of ``scanning_path``.

    Whatever can't be read as a workflow with declared permissions is a violation itself.
    """
    read = flows.select("path", _yaml("text").alias("read")).select("path", "read.error", F.parse_json("read.document").alias("whole"))
    read = read.withColumn("top", _mapping(F.col("whole"))).withColumn("declared", _has(F.col("top"), "permissions"))
    read = read.withColumn("jobs", F.when(F.col("declared") & _has(F.col("top"), "jobs"), F.col("top")["jobs"]))
    state = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("top").isNull(), "not-a-mapping")
        .when(~F.col("declared"), "no-permissions")
        .when(F.col("jobs").isNotNull() & _mapping(F.col("jobs")).isNull(), "jobs-not-a-mapping")
    )
    unreadable = _violation(read.withColumn("state", state).filter("state is not null"), "permissions", F.concat(F.lit("workflow "), F.col("state")))

    # each place that declares permissions, with the declared value
    own = read.filter("declared").select("path", F.lit("workflow").alias("place"), F.col("top")["permissions"].alias("value"))
    each = read.select("path", F.explode(_mapping(F.col("jobs"))).alias("job", "body")).withColumn("body", _mapping(F.col("body")))
    each = each.filter(_has(F.col("body"), "permissions")).select("path", F.concat(F.lit("job "), F.col("job")).alias("place"), F.col("body")["permissions"].alias("value"))
    values = own.unionByName(each).withColumn("scopes", _mapping(F.col("value")))

    word = lambda c: F.when(F.schema_of_variant(c) == "STRING", c.cast("string"))
    named = word(F.col("value"))
    broad = F.when(named.isin("write-all", "read-all"), named).when(F.col("scopes").isNull(), "not-a-scope-mapping")
    whole = _violation(values.withColumn("broad", broad).filter("broad is not null"), "permissions", F.concat_ws(" ", "place", "broad"))
    scoped = values.select("path", "place", F.explode("scopes").alias("scope", "access")).withColumn("access", F.coalesce(word(F.col("access")), F.lit("")))
    excepted = (F.col("path") == scanning_path) & (F.col("place") == "workflow") & (F.col("scope") == "security-events")
    problem = F.when((F.col("access") == "write") & ~excepted, "write-scope").when(~F.col("access").isin("write", "read", "none"), "invalid-access")
    granted = _violation(scoped.withColumn("problem", problem).filter("problem is not null"), "permissions", F.concat_ws(" ", "place", "problem", "scope"))
    return unreadable.unionByName(whole).unionByName(granted)


def violations(files: DataFrame, required: DataFrame, markers: DataFrame, manual_path: str = MANUAL_PATH, scanning_path: str = SCANNING_PATH) -> DataFrame:
    """All violations, distinct, by path, rule and detail."""
    texts = files.filter("content is not null").withColumn("text", text_of(F.col("content")))
    flows = workflows(texts)
    out = missing_paths(files, required)
    for part in (missing_markers(texts, markers), trigger_rules(flows, manual_path), action_rules(flows), permission_rules(flows, scanning_path), secret_files(files)):
        out = out.unionByName(part)
    return out.distinct().orderBy("path", "rule", "detail")
