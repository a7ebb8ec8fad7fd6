import random
from collections import Counter

from pyspark.sql import functions as F

from leaksieve.llm import line_dedup
from leaksieve.llm.line_dedup import GRAM_WORDS, GUARANTEE, dedup_lines, keep_first_lines
from tests.llm.data import PASSAGE, empty_frame, odd_frame, words

SCHEMA = "doc_id long, text string"


def spoken(text):
    return [(i, tuple(words(line))) for i, line in enumerate((text or "").split("\n")) if words(line)]


def runs(lines, n_words):
    """Places (begin, end) of the runs of lines that are the shortest with so many words from their first or up to their last line."""
    found = set()
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            count = sum(len(x) for _, x in lines[i:j])
            if count >= n_words and (count - len(lines[j - 1][1]) < n_words or count - len(lines[i][1]) < n_words):
                found.add((i, j))
    return found


def brute_force(rows):
    """The kept lines of each row: lines of windows that stand in an earlier row go, and of grams that repeat in their own."""
    seen, out = set(), []
    for _, text in rows:
        lines = spoken(text)
        content = lambda r: tuple(x for _, x in lines[r[0]:r[1]])
        windows, own, gone = runs(lines, GUARANTEE), set(), set()
        for r in sorted(runs(lines, GRAM_WORDS)):
            if content(r) in own:
                gone |= set(range(*r))
            own.add(content(r))
        for r in windows:
            if content(r) in seen:
                gone |= set(range(*r))
        seen |= {content(r) for r in windows}
        numbers, kept = [n for n, _ in lines], []
        for n, line in enumerate(text.split("\n")):
            # A blank line goes with the line before it.
            before = [k for k, m in enumerate(numbers) if m <= n]
            if not before or before[-1] not in gone:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def run(spark, rows):
    """The kept lines of each row, in the order of rows."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(t for _, t in rows)], SCHEMA).repartition(3)
    return [r.text for r in dedup_lines(frame).orderBy("doc_id").collect()]


def test_passage_goes_from_later_documents(spark):
    own = [" ".join(f"d{i}w{j}" for j in range(30)) for i in range(4)]
    rows = [(0, own[0] + "\n" + PASSAGE), (1, PASSAGE + "\n\n" + own[1]), (2, own[2] + "\n" + PASSAGE + "\n" + own[3]), (3, PASSAGE.split("\n")[0])]
    assert run(spark, rows) == [rows[0][1], own[1], own[2] + "\n" + own[3], rows[3][1]]


def test_single_long_line(spark):
    line = " ".join(f"q{i}" for i in range(51))
    assert run(spark, [(0, line), (1, "before\n" + line + "\nafter"), (2, "  " + line.replace(" ", "  "))]) == [line, "before\nafter", ""]


def test_matches_are_extended(spark):
    """Short lines on either side of the fingerprint go with it."""
    passage = "start\n" + PASSAGE + "\nend"
    assert run(spark, [(0, "a\n" + passage + "\nb"), (1, "c\n" + passage + "\nd")])[1] == "c\nd"


def test_repeats_within_a_document(spark):
    text = "\n".join(["only four words here"] * 30)
    kept = run(spark, [(0, text)])[0].split("\n")
    assert 1 <= len(kept) < 30


def test_random_documents(spark):
    rng = random.Random(9)
    pool = [" ".join(f"l{k}w{j}" for j in range(rng.randrange(1, 20))) for k in range(40)]
    rows = []
    for i in range(60):
        at = rng.randrange(30)
        rows.append((i, "\n".join([f"own {i}", *pool[at:at + rng.randrange(3, 10)], "", f"more {i}", *rng.sample(pool, 2)])))
    rows += [rows[3], rows[17]]
    kept = run(spark, rows)
    assert kept == brute_force(rows) and sum(len(words(t)) for t in kept) < sum(len(words(t)) for _, t in rows) * 0.7


def test_odd_rows(spark):
    frame = odd_frame(spark)
    rows = dedup_lines(frame).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in frame.collect())
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    original = {r.doc_id: r.text for r in frame.collect()}
    assert texts[0] == [None] and texts[1] == [""] and texts[6] == [original[6]]
    assert sorted(texts[7]) == ["", "", original[7]] and texts[8] == [""]
    assert PASSAGE in texts[11][0] and PASSAGE.split("\n")[0] not in texts[12][0] + texts[13][0]


def test_stage_keeps_columns(spark):
    frame = odd_frame(spark).withColumn("_key", F.lit(7)).withColumn("_left", F.lit("x")).withColumn("places", F.lit(1))
    kept = keep_first_lines(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows if r.doc_id not in (None, 0))
    assert sum(r.doc_id == 7 for r in rows) == 1 and not any(r.doc_id == 8 for r in rows)


def test_empty_table(spark):
    assert dedup_lines(empty_frame(spark)).collect() == []
    assert keep_first_lines(empty_frame(spark)).collect() == []


def line(name, n=30):
    return " ".join(f"{name}{j}" for j in range(n))


def test_passage_whose_lines_stand_earlier_in_its_text(spark):
    """Frequent and doubled lines: each line of a window that stands in an earlier row goes, whatever stands elsewhere."""
    rng = random.Random(4)
    g, x, y, z = (line(c) for c in "gxyz")
    for m in (line(f"m{k}") for k in range(8)):
        assert run(spark, [(0, "\n".join([g, x, g, m])), (1, "\n".join([y, g, m, z]))])[1] == "\n".join([y, z])
        assert run(spark, [(0, "\n".join([g, g, m])), (1, "\n".join([y, g, g, m, z]))])[1] == "\n".join([y, z])
    pool = [line(f"l{k}w", rng.randrange(5, 40)) for k in range(9)]
    rows = [(i, "\n".join([f"own {i}", *rng.choices(pool, [8, 4, *[1] * 7], k=rng.randrange(4, 12))])) for i in range(25)]
    assert run(spark, rows) == brute_force(rows)


def test_frequent_windows_are_joined_in_parts(spark, monkeypatch):
    """A passage that most documents hold, and one in fewer."""
    monkeypatch.setattr(line_dedup, "PART_ROWS", 5)
    rows = [(i, "\n".join([f"own {i}", PASSAGE if i % 4 else line(f"p{i % 8}", 60), f"more {i}"])) for i in range(80)]
    assert run(spark, rows) == brute_force(rows)


def test_passage_goes_whole_where_an_earlier_text_holds_a_part(spark):
    """The first occurrence of some lines has only those; a text between holds the whole passage."""
    for m in (line(f"m{k}") for k in range(8)):
        texts = [line("g") + "\n" + line("x"), "\n".join([line("y"), line("g"), m]), "\n".join([line("z"), line("g"), m, line("u")])]
        assert run(spark, list(enumerate(texts)))[2] == line("z") + "\n" + line("u")
