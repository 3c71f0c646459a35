"""Command lines of the two policy checks; both print what they find and end with 0 or 1.

    PR_TITLE="feat: add a thing" python -m tidewater.cli title
    python -m tidewater.cli tree [ROOT [RULES.json]]

``RULES.json`` has ``required`` (paths) and ``markers`` (path to texts).
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import policy
from .session import session


def check_title(spark: SparkSession, env: Mapping[str, str]) -> int:
    """0 if the title in ``PR_TITLE`` is valid; a missing one is empty, so it isn't."""
    title = env.get("PR_TITLE", "")
    if spark.range(1).select(policy.valid_title(F.lit(title))).first()[0]:
        print("The title is valid.")
        return 0
    print(f"The title is not of the form type(scope): summary: {title!r}", file=sys.stderr)
    return 1


def check_tree(spark: SparkSession, root: str = ".", rules_path: str | None = None) -> int:
    rules = {"required": [], "markers": {}}
    if rules_path:
        with open(rules_path, encoding="utf-8") as file:
            rules |= json.load(file)
    required = spark.createDataFrame([(p,) for p in rules["required"]], "path string")
    markers = spark.createDataFrame([(p, m) for p, texts in rules["markers"].items() for m in texts], "path string, marker string")
    files = policy.list_files(spark, os.path.realpath(root), [*rules["required"], *rules["markers"]])
    found = policy.violations(files, required, markers).collect()
    print(f"{len(found)} violations" if found else "No violations")
    for r in found:
        print("-", r.path, r.rule, *([r.detail] if r.detail else []))
    return int(bool(found))


def main(argv: list[str]) -> int:
    if argv[:1] == ["title"] and len(argv) == 1:
        return check_title(session("title", "local[1]"), os.environ)
    if argv[:1] == ["tree"] and len(argv) <= 3:
        return check_tree(session("tree", "local[*]"), *argv[1:])
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
