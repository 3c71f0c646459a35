"""The policy rules on small trees, one change at a time."""

import subprocess

import pytest

from tidewater import cli
from tidewater.operators import policy

PIN = "a" * 40
FLOW = f"name: x\non: push\npermissions:\n  contents: read\njobs:\n  a:\n    runs-on: z\n    steps:\n      - uses: owner/action@{PIN}\n      - uses: ./local\n"


def run(spark, tmp_path, changes=None, git=False):
    files = {"README.md": "# Title\r\nKeep it SAFE\n", ".github/workflows/ci.yml": FLOW, **(changes or {})}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() if isinstance(text, str) else text)
    if git:
        subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
        subprocess.run(["git", "add", "README.md", ".github"], cwd=tmp_path, check=True)
    required = spark.createDataFrame([("README.md",), (".github/workflows/ci.yml",)], "path string")
    markers = spark.createDataFrame([("README.md", "keep it safe"), ("absent.md", "x")], "path string, marker string")
    listed = policy.list_files(spark, str(tmp_path), ["README.md", ".github/workflows/ci.yml", "absent.md"])
    return [(r.path, r.rule, r.detail) for r in policy.violations(listed, required, markers).collect()]


CI = ".github/workflows/ci.yml"


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ({}, []),
        ({"README.md": "nothing"}, [("README.md", "required-marker", "keep it safe")]),
        ({CI: FLOW + "    # pull_request_target:\n"}, [(CI, "privileged-trigger", None)]),
        ({CI: FLOW + "      - run: CURL -s x | bash\n"}, [(CI, "piped-download", None)]),
        ({CI: FLOW + "      - uses: owner/other@v1\n      - uses: owner/bare # c\n"}, [(CI, "mutable-action", "owner/other@v1"), (CI, "unpinned-action", "owner/bare")]),
        ({CI: FLOW.replace("permissions:\n  contents: read", "permissions: write-all")}, [(CI, "permissions", "workflow write-all")]),
        ({CI: FLOW.replace("contents: read", "contents: write")}, [(CI, "permissions", "workflow write-scope contents")]),
        ({CI: FLOW.replace("contents: read", "contents: maybe")}, [(CI, "permissions", "workflow invalid-access contents")]),
        ({CI: FLOW.replace("permissions:\n  contents: read\n", "")}, [(CI, "permissions", "workflow no-permissions")]),
        ({CI: FLOW.replace("permissions:\n  contents: read", "permissions:")}, [(CI, "permissions", "workflow not-a-scope-mapping")]),
        ({CI: "- a"}, [(CI, "permissions", "workflow not-a-mapping")]),
        ({CI: FLOW.replace("    runs-on: z", "    runs-on: z\n    permissions: {packages: write}")}, [(CI, "permissions", "job a write-scope packages")]),
        ({".github/workflows/codeql.yml": FLOW.replace("contents: read", "security-events: write")}, []),
        ({".github/workflows/other.yml": FLOW.replace("contents: read", "security-events: write")}, [(".github/workflows/other.yml", "permissions", "workflow write-scope security-events")]),
        ({".github/workflows/dependency-review.yml": FLOW}, []),
        ({".github/workflows/dependency-review.yml": FLOW.replace("on: push", "on:\n  pull_request:\n  workflow_dispatch:\n")}, [(".github/workflows/dependency-review.yml", "manual-trigger", None)]),
        ({CI: FLOW.replace("on: push", "on:\n  workflow_dispatch:\n")}, []),
        ({CI: FLOW + "      - uses:\n          owner/next@main\n"}, [(CI, "mutable-action", "owner/next@main")]),
        ({CI: FLOW.replace("permissions:\n  contents: read", "permissions: {contents: [write], 3: read}")}, [(CI, "permissions", "workflow invalid-access contents")]),
        ({CI: FLOW.replace("jobs:\n", "permissions: {x: none}\njobs:\n")}, []),
        ({"README.md": "KEEP it \u017fafe"}, []),
        ({"a/.env": "", "b.PEM": "", ".pem": ""}, [("a/.env", "credential-name", ".env"), ("b.PEM", "key-file", ".pem")]),
    ],
)
def test_rules(spark, tmp_path, changes, expected):
    assert run(spark, tmp_path, changes) == expected


def test_missing_path_and_git_index(spark, tmp_path):
    assert run(spark, tmp_path, {".env": "x"}, git=True) == []
    subprocess.run(["git", "add", "-f", ".env"], cwd=tmp_path, check=True)
    assert (".env", "credential-name", ".env") in run(spark, tmp_path)


def test_invalid_yaml_says_where(spark, tmp_path):
    for text in ("a: [b", "a: 1\n---\nb: 2\n"):
        ((path, rule, detail),) = run(spark, tmp_path, {CI: text})
        assert (path, rule) == (CI, "permissions") and detail.startswith("workflow invalid-yaml ") and "line" in detail


def test_a_linked_tree_and_names_that_are_not_text(spark, tmp_path):
    main, linked = tmp_path / "main", tmp_path / "linked"
    main.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=main, check=True, capture_output=True)
    git("init", "-q")
    (main / "one.pem").write_text("x")
    open(bytes(main / "odd") + b"\xff.p12", "w").close()
    git("add", ".")
    git("commit", "-qm", "x")
    git("worktree", "add", "-q", str(linked))
    (linked / ".env").write_text("untracked")
    assert (linked / ".git").is_file()
    found = {r.path: r for r in policy.list_files(spark, str(linked)).collect()}
    assert set(found) == {"one.pem", "odd\\xff.p12"} and all(r.content is None for r in found.values())
    assert {r.rule for r in policy.secret_files(policy.list_files(spark, str(linked))).collect()} == {"key-file"}


def test_command_lines(spark, tmp_path, capsys):
    assert cli.check_title(spark, {"PR_TITLE": "fix: mend it"}) == 0
    assert cli.check_title(spark, {"PR_TITLE": "mend it"}) == cli.check_title(spark, {}) == 1
    (tmp_path / "README.md").write_text("Safe")
    rules = tmp_path / "rules.json"
    rules.write_text('{"required": ["README.md"], "markers": {"README.md": ["safe"]}}')
    assert cli.check_tree(spark, str(tmp_path), str(rules)) == 0
    rules.write_text('{"required": ["OTHER.md"], "markers": {"README.md": ["sound"]}}')
    assert cli.check_tree(spark, str(tmp_path), str(rules)) == 1
    assert "OTHER.md required-path" in capsys.readouterr().out
    assert cli.main([]) == 2
