import os

import pytest
from pyspark.sql import functions as F

from leaksieve.functions.paths import file_name
from leaksieve.operators.files import ScanConfig, is_binary, outside_excluded_dirs, scannable_hosted_name, scannable_name
from leaksieve.operators.ignore import ignore_regex, is_ignored, parse_ignore_lines
from leaksieve.plans.sources import scan_files, scan_tree, scan_trees
from leaksieve.sources.patterns import load_patterns, rules_with_file
from leaksieve.sources.listing import Share, _entries, list_shares
from leaksieve.sources.stores import LocalTree, StoreTree
from leaksieve.sources.tree import list_tree, read_files, select_files

SECRET = "pwd = 'abcdefghij'\n"
AWS = "key = \"AK" + "IA" + "ABCDEFGHIJKLMNOP" + "\"\n"


def write(root, path, content):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture()
def project(tmp_path):
    write(tmp_path, "config.py", AWS + "# safe line here\n" + SECRET)
    write(tmp_path, "main.py", "print('hello')\n")
    write(tmp_path, ".env", SECRET)
    write(tmp_path, "_private/__init__.py", SECRET)
    write(tmp_path, "node_modules/package.json", SECRET)
    write(tmp_path, "src/build/x.py", SECRET)
    write(tmp_path, "image.py", b"\x00" + SECRET.encode())
    write(tmp_path, "late_null.py", b"#" * 8192 + b"\n" + SECRET.encode() + b"\x00")
    write(tmp_path, "early_null.py", b"#" * 8191 + b"\x00\n" + SECRET.encode())
    write(tmp_path, "empty.py", b"")
    write(tmp_path, "max.py", SECRET.encode() + b"\n" * (2097152 - len(SECRET)))
    write(tmp_path, "over.py", SECRET.encode() + b"\n" * (2097153 - len(SECRET)))
    write(tmp_path, "malformed.py", b"p\xffwd = 'abcdefghij'\xc3\n")
    write(tmp_path, "data.bin", SECRET)
    write(tmp_path, "my-credentials.bin", SECRET)
    write(tmp_path, "Dockerfile", SECRET)
    write(tmp_path, "script.R", SECRET)
    write(tmp_path, "deep/a/b/c/d.YML", SECRET)
    return tmp_path


HITS = {"config.py", ".env", "_private/__init__.py", "late_null.py", "max.py", "malformed.py", "my-credentials.bin",
        "Dockerfile", "deep/a/b/c/d.YML", "script.R"}


def test_tree(spark, project):
    scan = scan_tree(spark, str(project))
    found = scan.findings.collect()
    assert {r.file_path for r in found} == HITS
    assert {(r.line_number, r.rule_id) for r in found if r.file_path == "config.py"} == {
        (1, "aws-access-key-id"), (3, "generic-password-assignment")}
    assert {r.source_id for r in scan.scan_log.collect()} == HITS | {"main.py"}
    assert scan.errors.count() == 0
    row = next(r for r in found if r.file_path == "malformed.py")
    assert row.matched_text == "pwd = 'abcdefghij'" and row.snippet == row.matched_text


def test_ignore_files(spark, project):
    write(project, ".gitignore", "# comment\n\nmax.py\n_private/\n*.YML\n")
    write(project, ".leaksieveignore", "!deep/**/d.YML\n/Dockerfile\n")
    write(project, "deep/.gitignore", "*\n")
    found = scan_tree(spark, str(project), config=ScanConfig(ignore_patterns=("script.*",))).findings
    assert {r.file_path for r in found.collect()} == HITS - {"max.py", "_private/__init__.py", "Dockerfile", "script.R"}


def test_single_file_skips_every_filter(spark, project):
    scan = scan_tree(spark, str(project / "data.bin"))
    assert [(r.file_path, r.rule_id) for r in scan.findings.collect()] == [("data.bin", "generic-password-assignment")]
    assert scan_tree(spark, str(project / "image.py")).findings.count() == 1


def test_several_targets(spark, project):
    scan = scan_trees(spark, [str(project), str(project / "nope"), str(project / "data.bin")])
    assert {r.target for r in scan.findings.collect()} == {str(project), str(project / "data.bin")}
    assert [r.message for r in scan.errors.collect()] == [f"Path not found: {project / 'nope'}"]


def test_clean_tree(spark, tmp_path):
    write(tmp_path, "clean.py", "# mentions a password in a comment\ndef password(): pass\n")
    scan = scan_tree(spark, str(tmp_path))
    assert scan.findings.count() == 0 and scan.scan_log.count() == 1


def test_unreadable_file_is_counted(spark, project):
    files = read_files(select_files(list_tree(spark, str(project / "config.py"))))
    assert [r.status for r in files.collect()] == ["ok"]
    listing = list_tree(spark, str(project)).withColumn("path", F.concat("path", F.lit(".gone")))
    gone = read_files(select_files(listing))
    assert {r.status for r in gone.collect()} == {"unreadable"}
    scan = scan_files(gone, "t")
    assert scan.findings.count() == scan.scan_log.count() == 0 and scan.errors.count() == gone.count()


def test_empty_settings_mean_defaults(spark, project):
    assert {r.rel_path for r in list_tree(spark, str(project), ScanConfig(excluded_dirs=())).collect()}.isdisjoint(
        {"node_modules/package.json", "src/build/x.py"})
    listed = list_tree(spark, str(project), ScanConfig(excluded_dirs=("src",))).collect()
    assert "node_modules/package.json" in {r.rel_path for r in listed}
    assert len({r.path for r in listed}) == len(listed)


def test_many_directories(spark, tmp_path):
    """Rounds hand directories on, whatever the budget, and find each file once."""
    for i in range(300):
        write(tmp_path, f"d{i % 20}/e{i}/f{i}.py", SECRET)
    expected = sorted(f"d{i % 20}/e{i}/f{i}.py" for i in range(300))
    for budgets in ((1, 1), (7, 40), (256, 65536)):
        found = list_shares(spark, str(tmp_path), frozenset(), 8, None, *budgets)
        assert sorted(r.rel_path for r in found.collect()) == expected


def test_names_that_are_not_utf8(spark, tmp_path):
    write(tmp_path, "good.py", SECRET)
    with open(os.path.join(os.fsencode(str(tmp_path)), b"odd\xff.py"), "w") as file:
        file.write(SECRET)
    found = scan_tree(spark, str(tmp_path)).findings.collect()
    assert {r.file_path for r in found} == {"good.py", "odd\ufffd.py"}


def test_uris(spark, project):
    assert {r.file_path for r in scan_tree(spark, project.as_uri()).findings.collect()} == HITS
    assert {r.file_path for r in scan_tree(spark, (project / "config.py").as_uri()).findings.collect()} == {"config.py"}
    assert scan_tree(spark, (project / "nope").as_uri()).errors.count() == 1


def walked(tree):
    rows, stack = set(), [tree.root]
    while stack:
        for page in tree.pages(stack.pop()):
            for name, path, below, size in page:
                if below:
                    stack.append(path)
                else:
                    with tree.open(path) as file:
                        rows.add((name, path, size, bytes(file.read())))
    return rows


def test_stores_list_and_read_as_folders_do(project):
    local, store = LocalTree(str(project)), StoreTree(project.as_uri())
    assert (local.kind(), store.kind()) == ("directory", "directory") and StoreTree(project.as_uri() + "/nope").kind() is None
    assert walked(local) == walked(store) and len(walked(store)) > 5


def test_wide_directories_are_listed_in_pages(tmp_path):
    for i in range(1500):
        write(tmp_path, f"wide/d{i % 700}/f{i}.py", SECRET)
        write(tmp_path, f"wide/f{i}.py", SECRET)
    rows = list(_entries(LocalTree(str(tmp_path)), [Share(str(tmp_path / "wide"))], frozenset({"d7"}), 100))
    assert sorted(r[3] for r in rows if r[0] == "file") == sorted(f"f{i}.py" for i in range(1500))
    assert {os.path.basename(r[1]) for r in rows if r[0] == "share"} == {b"d%d" % i for i in range(700)} - {b"d7"}
    assert all(len(page) <= 1000 for page in LocalTree(str(tmp_path)).pages(str(tmp_path / "wide")))


def test_symlinked_directories_are_not_followed(spark, project):
    os.symlink(project / "deep", project / "link")
    os.symlink(project / "gone.py", project / "broken.py")
    assert {r.file_path for r in scan_tree(spark, str(project)).findings.collect()} == HITS


NAMES = {
    "a.py": (True, True), "A.PY": (True, True), "x.bin": (False, False), "Makefile": (True, False), "my.Token": (True, True),
    "server.key": (False, True), "password.bin": (True, False), ".env": (True, True), ".envrc": (True, True), "x.R": (True, False),
    "x.css": (True, False), "keyfile": (True, True), "id_rsa": (True, False), "x.r": (True, False), "README": (False, False),
    "noext.": (False, False), "gradle": (False, False), "x.kts": (True, False), "monkey.bin": (False, True),
}


def test_names(spark):
    frame = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = frame.select("n", scannable_name(F.col("n")).alias("t"), scannable_hosted_name(F.col("n")).alias("h")).collect()
    assert {r.n: (r.t, r.h) for r in rows} == NAMES


def test_excluded_directories(spark):
    frame = spark.createDataFrame([("a/vendor/x.py",), ("vendor",), ("a/vendors/x.py",), ("env/x",)], "p string")
    assert [r[0] for r in frame.select(outside_excluded_dirs(F.col("p"))).collect()] == [False, True, True, False]
    assert [r[0] for r in frame.select(file_name(F.col("p"))).collect()] == ["x.py", "vendor", "x.py", "x"]


def test_binary(spark):
    frame = spark.createDataFrame([(b"a\x00",), (b"a" * 8192 + b"\x00",), (b"a" * 8191 + b"\x00",), (b"",)], "c binary")
    assert [r[0] for r in frame.select(is_binary(F.col("c"))).collect()] == [True, False, True, False]


IGNORE_CASES = [
    (["*.log"], {"a.log": 1, "d/a.log": 1, "a.log/x": 1, "a.logs": 0}),
    (["dir/"], {"dir": 0, "dir/x": 1, "a/dir/x/y": 1, "adir/x": 0}),
    (["/top"], {"top": 1, "top/x": 1, "a/top": 0}),
    (["a/b"], {"a/b": 1, "a/b/c": 1, "x/a/b": 0}),
    (["**/x"], {"x": 1, "a/x": 1, "a/b/x/y": 1, "ax": 0}),
    (["a/**"], {"a/x": 1, "a/b/c": 1, "a": 0, "b/a/x": 0}),
    (["a/**/z"], {"a/z": 1, "a/b/z": 1, "a/b/c/z": 1, "az": 0}),
    (["*.js", "!keep.js"], {"x.js": 1, "keep.js": 0, "d/keep.js": 0}),
    (["d/", "!d/k", "d/k/z"], {"d/x": 1, "d/k": 0, "d/k/z": 1}),
    (["fo?.py", "[ab]x", "[!ab]y"], {"foo.py": 1, "fo/.py": 0, "ax": 1, "cx": 0, "cy": 1, "ay": 0}),
    ([r"\#x", r"\!y"], {"#x": 1, "!y": 1}),
    (["a*b"], {"aXb": 1, "a/b": 0}),
    (["*"], {"x": 1, "a/b": 1}),
    (["a.b"], {"a.b": 1, "aXb": 0}),
    (["/"], {"x": 0}),
    (["# c", ""], {"# c": 0}),
]


@pytest.mark.parametrize("patterns, cases", IGNORE_CASES)
def test_ignore_patterns(spark, patterns, cases):
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: int(r.x) for r in frame.select("p", is_ignored(F.col("p"), patterns).alias("x")).collect()}
    assert got == cases


def test_ignore_lines():
    assert parse_ignore_lines(["  a ", "", "# x", "b"]) == ["a", "b"]
    assert ignore_regex("#x") is None


def test_pattern_file(spark, tmp_path):
    write(tmp_path, "p.txt", "# first\n\n  MYCO_[A-Z]{4}  \nsecond_[0-9]{3}\nMYCO_[A-Z]{4}\n")
    assert load_patterns(spark, str(tmp_path / "p.txt")) == [
        ("Custom Pattern #3", "MYCO_[A-Z]{4}"), ("Custom Pattern #4", "second_[0-9]{3}"), ("Custom Pattern #5", "MYCO_[A-Z]{4}")]
    assert load_patterns(spark, str(tmp_path / "missing")) == [] == load_patterns(spark, None)
    rules = rules_with_file(spark, str(tmp_path / "p.txt"))
    assert [r.rule_id for r in rules.rules[78:]] == ["custom-custom-pattern-#3", "custom-custom-pattern-#4", "custom-custom-pattern-#5"]
    write(tmp_path, "t/x.py", "the MYCO_ABCD code\n")
    assert [r.ord for r in scan_tree(spark, str(tmp_path / "t"), rules).findings.orderBy("ord").collect()] == [79, 81]
