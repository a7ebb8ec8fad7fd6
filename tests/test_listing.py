"""Paged stores, failures while listing, one read of each file, and files read in ranges."""

import io
import os
import random
import re
import uuid
from collections import Counter

import pytest

from leaksieve.functions.text import LINE_BOUNDARY
from leaksieve.operators.files import ScanConfig
from leaksieve.plans.sources import scan_tree, scan_trees
from leaksieve.sources.listing import FOUND_SCHEMA, Share, _entries, key_ranges, list_shares
from leaksieve.sources.ranges import pieces
from leaksieve.sources.stores import Entry, PagedTree, S3Lister
from tests.test_files import SECRET, write

# A store in a module that is shipped to the tasks. Its folders: a flat one of many files, one that refuses, one that fails at first.
STORE = '''
import bisect, io, os
from leaksieve.sources.stores import Entry

FLAT = [f"file-{i:06d}.py" for i in range(%(n)d)]
KEYS = sorted(["readme.md", "zeta/deep/x.py", "refused/", "shaky/", *(f"flat/{n}" for n in FLAT)], key=str.encode)

class Store:
    def page(self, directory, after, limit):
        below = directory.partition("/")[2]
        if below.startswith("refused"):
            raise PermissionError(13, "Permission denied")
        if below.startswith("shaky"):
            raise OSError(5, "Input/output error")
        if below == "flat":
            at = bisect.bisect_right(FLAT, after)
            found = [Entry(n, f"{directory}/{n}", False, 20) for n in FLAT[at:at + limit]]
        else:
            prefix, names = below + "/" if below else "", {}
            for key in KEYS:
                if key.startswith(prefix) and key != prefix:
                    name, folder, _ = key[len(prefix):].partition("/")
                    names[name + folder] = Entry(name, f"{directory}/{name}", bool(folder), None if folder else 20)
            found = [names[k] for k in sorted(names, key=str.encode) if k.encode() > after.encode()][:limit]
        with open(%(log)r, "a") as log:
            log.write(f"{limit} {len(found)}\\\\n")
        return found

    def open(self, path):
        return io.BytesIO(b"pwd = 'abcdefghij'\\\\n")

    def size(self, path):
        return 20 if path.endswith((".py", ".md")) else None

def lister():
    return Store()
'''


@pytest.fixture()
def store(spark, tmp_path):
    def make(n):
        name = f"store_{uuid.uuid4().hex}"
        (tmp_path / f"{name}.py").write_text(STORE.replace("\\\\", "\\") % {"n": n, "log": str(tmp_path / "requests")})
        spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
        return f"{name}:lister"
    return make


def test_flat_prefix_is_listed_in_ranges_once(spark, store, tmp_path):
    lister = store(100_000)
    found = list_shares(spark, "store://bucket/flat", frozenset(), 8, lister, 2000, 5000)
    assert Counter(r.name for r in found.collect()) == Counter(f"file-{i:06d}.py" for i in range(100_000))
    requests = [tuple(map(int, line.split())) for line in open(tmp_path / "requests")]
    assert max(limit for limit, _ in requests) == 1000
    listed, probes = sum(n for limit, n in requests if limit > 1), sum(1 for limit, _ in requests if limit == 1)
    # Pages that pass the end of their range hold some names of the next one.
    assert listed < 140_000 and probes < 5000


def test_errors_while_listing_are_rows(spark, store):
    lister = store(3)
    found = list_shares(spark, "store://bucket", frozenset(), 4, lister).collect()
    assert sorted((r.kind, r.rel_path, r.message) for r in found) == [
        ("error", "refused", "Error listing refused: Permission denied"), ("error", "shaky", "Error listing shaky: Input/output error"),
        *[("file", f"flat/file-{i:06d}.py", None) for i in range(3)], ("file", "readme.md", None), ("file", "zeta/deep/x.py", None)]
    scan = scan_tree(spark, "store://bucket", config=ScanConfig(lister=lister))
    assert {(r.source_id, r.stage) for r in scan.errors.collect()} == {("refused", "list"), ("shaky", "list")}
    assert {r.file_path for r in scan.findings.collect()} == {r.rel_path for r in found if r.kind == "file"}
    single = scan_tree(spark, "store://bucket/flat/file-000001.py", config=ScanConfig(lister=lister))
    assert [(r.file_path, r.line_number) for r in single.findings.collect()] == [("file-000001.py", 1)]
    gone = scan_tree(spark, "store://bucket/nothing", config=ScanConfig(lister=lister))
    assert [r.message for r in gone.errors.collect()] == ["Path not found: store://bucket/nothing"]


class Fails:
    paged, root = False, "/r"

    def __init__(self, problem):
        self.problem = problem

    def pages(self, directory, after=None, before=None):
        yield [Entry("a", "/r/a", False, 1)]
        raise self.problem


def test_failures_that_may_pass_fail_the_task(monkeypatch):
    from leaksieve.sources import listing

    monkeypatch.setattr(listing, "last_attempt", lambda tries: False)
    assert [r[0] for r in _entries(Fails(PermissionError(13, "no")), [Share("/r")], frozenset(), 10)] == ["file", "error"]
    with pytest.raises(OSError):
        list(_entries(Fails(OSError(5, "Input/output error")), [Share("/r")], frozenset(), 10))


class Names:
    """A lister of names in memory."""

    def __init__(self, names):
        self.names = sorted(names, key=str.encode)

    def page(self, directory, after, limit):
        return [Entry(n, f"d/{n}", False, 1) for n in self.names if n.encode() > after.encode()][:limit]

    def size(self, path):
        return None


@pytest.mark.parametrize("names", [
    [f"part-{i:05d}" for i in range(3000)], [f"{i}" for i in range(3000)], [f"ünï{i}" for i in range(500)] + ["a", "b"], ["x"] * 1 + ["x" * i for i in range(2, 60)],
    [uuid.UUID(int=random.Random(i).getrandbits(128)).hex for i in range(3000)], ["~" * 5, "~~", " a", "a b", "\x7f", "\U0001F600"]])
def test_ranges_of_keys_hold_every_key_once(names):
    tree = PagedTree("store://b", Names(names))
    for share in (Share("b"), Share("b", sorted(names, key=str.encode)[len(names) // 3]), Share("b", None, "part-02")):
        inside = [n for n in names if (share.after or "").encode() < n.encode() and (share.before is None or n.encode() < share.before.encode())]
        ranges = key_ranges(tree, share)
        got = [e.name for r in ranges for page in tree.pages(*r) for e in page]
        assert sorted(got) == sorted(inside)
    if len(names) == 3000:
        sizes = [sum(len(p) for p in tree.pages(*r)) for r in key_ranges(tree, Share("b", min(names)))]
        assert sum(n > 0 for n in sizes) > 3 and max(sizes) <= 1500


class Client:
    """``list_objects_v2`` over keys in memory, a few at a time."""

    def __init__(self, keys):
        self.keys = sorted(keys, key=str.encode)

    def list_objects_v2(self, Bucket, Prefix="", Delimiter=None, StartAfter="", MaxKeys=1000, ContinuationToken=None):
        start = ContinuationToken or StartAfter
        found, folders, last, truncated = [], [], None, False
        for key in self.keys:
            if not key.startswith(Prefix) or key.encode() <= start.encode():
                continue
            folder = Delimiter and Delimiter in key[len(Prefix):] and Prefix + key[len(Prefix):].split(Delimiter)[0] + Delimiter
            if folder and folders and folders[-1]["Prefix"] == folder:
                last = key
                continue
            if len(found) + len(folders) == min(MaxKeys, 3):
                truncated = True
                break
            if folder:
                folders.append({"Prefix": folder})
            else:
                found.append({"Key": key, "Size": len(key)})
            last = key
        return {"Contents": found, "CommonPrefixes": folders, "IsTruncated": truncated, **({"NextContinuationToken": last} if truncated else {})}


def test_pages_of_object_stores():
    keys = ["p/", "p/a", "p/dir/1", "p/dir/2", "p/dir/sub/3", "p/dir-x", "p/dir.y/z", "p/e", "q", *(f"p/n{i}" for i in range(20))]
    for limit in (1, 2, 5, 1000):
        lister, found, after = S3Lister(Client(keys)), [], ""
        while page := lister.page("bkt/p", after, limit):
            assert len(page) <= limit
            found += page
            after = page[-1].key
        assert sorted(e.key for e in found) == sorted(["a", "dir/", "dir-x", "dir.y/", "e", *(f"n{i}" for i in range(20))])
        assert [e.key for e in found] == sorted((e.key for e in found), key=str.encode)
    tree = PagedTree("bkt/p", lister)
    stack, files = [tree.root], []
    while stack:
        for page in tree.pages(stack.pop()):
            files += [e.path for e in page if not e.below]
            stack += [e.path for e in page if e.below]
    assert sorted(files) == sorted(f"bkt/{k}" for k in keys if k.startswith("p/") and k != "p/")
    assert (tree.kind(), PagedTree("bkt/q", lister).kind(), PagedTree("bkt/q", lister).size(), PagedTree("bkt/none", lister).kind()) == ("directory", "file", 1, None)


def test_a_scan_written_reads_each_file_once(spark, tmp_path):
    for i in range(20):
        write(tmp_path, f"src/f{i}.py", SECRET)
    write(tmp_path, "src/empty_binary.py", b"\x00")
    scan = scan_tree(spark, str(tmp_path / "src"))
    text = scan.tagged._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1
    kept = scan.written(str(tmp_path / "out"))
    for i in range(20):
        write(tmp_path, f"src/f{i}.py", "nothing here any more\n")
    assert kept.findings.count() == kept.scan_log.count() == 20 and kept.errors.count() == 0
    assert {r.source_id for r in kept.scan_log.collect()} == {r.file_path for r in kept.findings.collect()}
    assert kept.merge(kept).findings.count() == 40 and kept.duration_seconds > 0


def odd_lines(rng, n):
    return b"".join(rng.choice([b"short", b"x" * rng.randrange(300), "naïve   sign".encode(), b"bad \xff\xc3", SECRET.strip().encode()])
                    + rng.choice([b"\n", b"\n", b"\r\n", b"\r", b"\x0c", " ".encode()]) for _ in range(n))


def test_pieces_hold_every_line_once():
    rng = random.Random(3)
    for _ in range(200):
        data = b"".join(rng.choice([b"a" * rng.randrange(12), b""]) + rng.choice([b"\n", b"", b"\r\n"]) for _ in range(rng.randrange(30)))
        width, size = rng.randrange(1, 20), rng.randrange(1, 9)
        got = [list(pieces(io.BytesIO(data), b, b + width, size)) for b in range(0, max(1, len(data)), width)]
        flat = [p for ps in got for p in ps]
        assert b"".join(flat) == data
        assert all(p.endswith(b"\n") for p in flat[:-1])
        # A line is read by the range it begins in.
        at = 0
        for i, ps in enumerate(got):
            for p in ps:
                assert i * width <= at < (i + 1) * width
                at += len(p)


@pytest.mark.parametrize("range_bytes", [1000, 64 << 20])
def test_single_file_in_ranges(spark, tmp_path, range_bytes):
    import re

    data = odd_lines(random.Random(5), 900)
    write(tmp_path, "big.log", data)
    text = data.decode("utf-8", "ignore")
    expected = sorted(i for i, line in enumerate(re.split(LINE_BOUNDARY, text), 1) if line.strip() == SECRET.strip())
    scan = scan_tree(spark, str(tmp_path / "big.log"), config=ScanConfig(range_bytes=range_bytes))
    assert sorted(r.line_number for r in scan.findings.collect()) == expected and len(expected) > 100
    assert [(r.source_id, r.target) for r in scan.scan_log.collect()] == [("big.log", str(tmp_path / "big.log"))]
    assert scan.errors.count() == 0
    assert scan.tagged.rdd.getNumPartitions() == max(1, -(-len(data) // range_bytes))
    assert "Exchange hash" not in scan.tagged._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_share_tasks(spark, tmp_path):
    data = odd_lines(random.Random(7), 9000)
    write(tmp_path, "big.log", data)
    expected = sorted(i for i, line in enumerate(re.split(LINE_BOUNDARY, data.decode("utf-8", "ignore")), 1) if line.strip() == SECRET.strip())
    scan = scan_tree(spark, str(tmp_path / "big.log"), config=ScanConfig(range_bytes=200))
    assert len(data) // 200 > 1800 and scan.tagged.rdd.getNumPartitions() < 300
    assert sorted(r.line_number for r in scan.findings.collect()) == expected and len(expected) > 1000
    assert scan.scan_log.count() == 1 and scan.errors.count() == 0


def test_a_range_is_not_read_far_beyond_its_end():
    file = io.BytesIO(b"a line\n" * (1 << 20))
    assert b"".join(pieces(file, 1 << 18, 1 << 19)) == b"a line\n" * (((1 << 19) + 6) // 7 - ((1 << 18) + 6) // 7)
    assert file.tell() < 2 << 20


def test_odd_single_files(spark, tmp_path):
    write(tmp_path, "empty.py", b"")
    write(tmp_path, "long.py", b"x" * 5000 + SECRET.encode())
    scan = scan_trees(spark, [str(tmp_path / "empty.py"), str(tmp_path / "long.py")], config=ScanConfig(range_bytes=700))
    assert {r.source_id for r in scan.scan_log.collect()} == {"empty.py", "long.py"}
    assert [r.line_number for r in scan.findings.collect()] == [1]
    gone = tmp_path / "gone.py"
    write(tmp_path, "gone.py", SECRET)
    late = scan_tree(spark, str(gone))
    os.remove(gone)
    assert [(r.stage, r.message) for r in late.errors.collect()] == [("read", "Error scanning gone.py")]
    assert late.scan_log.count() == 1 and late.findings.count() == 0


def test_listing_schema_is_stable(spark, tmp_path):
    assert list_shares(spark, str(tmp_path), frozenset(), 4).schema == spark.createDataFrame([], FOUND_SCHEMA).schema
