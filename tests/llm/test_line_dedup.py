"""Line dedup against a brute-force version, with special cases."""

import random
from collections import defaultdict

from riskloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, h1 string, place int, lines string, keeper string"
BLANKS = " \t\n\x0b\f\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _brute(rows):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= 20 and i is not None:
                held[_key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if _key(x) not in common or common[_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in L.line_dedup(df, **kw).collect()], key=repr)


def _rows():
    rnd = random.Random(5)
    shared = ["this passage stands in many of them", "  THIS passage stands in many of them\t\r", "\x0bkurze Zeile mit Ähnlichkeit ÄÖ\f",
              "short line", "a" * 19, "a" * 20, "\x85 not a blank of the rule here", "Ünïcödé line with twenty çhars"]
    rows = [(i, "\n".join(rnd.choice([*shared, f"own line number {i} of {rnd.random()}", ""]) for _ in range(rnd.randint(1, 12))))
            for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n"), (73, "\n\n"), (74, shared[0]), (75, f"{shared[0]}\n{shared[0]}\n"),
             (59, "other text\n" + shared[0]), (5, rows[5][1]), (5, rows[5][1]),        # shared ids, repeated rows
             (None, shared[0] + "\nrow without an id"), (None, None), (None, shared[0] + "\nrow without an id")]
    return rows


def test_equals_brute_force(spark):
    rows = _rows()
    want = _brute(rows)
    assert sum(r[2] for r in want) > 50
    assert _run(spark, rows) == want
    assert _run(spark, rows, hot_keys=1) == want          # nothing is broadcast
    assert _run(spark, rows, hot_keys=1 << 40) == want    # everything is


def test_very_long_text_and_hot_line(spark):
    line = "the one line that every document holds"
    long = "\n".join(f"line {i} of a long text, line {i}" if i % 3 else line for i in range(30_000))
    rows = [(1, long), *[(i, f"{line}\nown words of document {i}") for i in range(2, 400)]]
    assert _run(spark, rows) == _brute(rows)


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
