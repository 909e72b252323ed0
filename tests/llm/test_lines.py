import hashlib
import random

import pytest

from driftscope.llm import lines
from driftscope.llm.scratch import Scratch
from tests.llm.conftest import CLASHING, ROWS


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=10):
    """(id, lines, dropped, text that stays) of each row."""
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k, place = key(line), (i is None, i or 0)
            first[k] = min(first.get(k, place), place)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        stays = [x for x in own if len(key(x)) < min_chars or first[key(x)] == (i is None, i or 0)]
        out.append((i, len(own), len(own) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest())
                   for r in frame.collect()), key=str)


LINES = ["a line that repeats", "  A LINE that repeats\t", "short", "tencharsxx", "ninechars", "", " ", "É a line of ten",
         "é a line of ten", "ends in \x85 here\x85", "x" * 5000, "a\rb\rc\rd\re\rf", "nbsp at the end\xa0"]


def made():
    draw = random.Random(4)
    rows = [(i, "\n".join(draw.choice(LINES) + draw.choice(["", "", str(draw.randrange(40))])
                          for _ in range(draw.randrange(1, 9)))) for i in range(0, 400, 2)]
    draw.shuffle(rows)
    return rows + [(3, None), (5, ""), (7, "\n\n"), (9, "a line that repeats\n" * 50), (None, "a line that repeats\nsome new line"),
                   (None, "some new line"), (8, rows[0][1]), (8, rows[0][1])]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (7, 2)])
def test_equal_to_all_lines(spark, batches, fanout):
    docs = spark.createDataFrame(made(), "doc_id int, text string").repartition(3)
    assert found(lines.drop_repeated_lines(docs, batches=batches, fanout=fanout)) == brute(made())


def test_runs_are_merged_level_by_level(spark):
    runs = lines.LineRuns(Scratch(spark, "t"), fanout=2, buckets=3)
    for batch in range(5):
        new = runs.add(spark.range(batch * 5, batch * 5 + 10).selectExpr("id AS h1", "id * 3 AS h2", f"{batch} AS id"))
        assert sorted(r.h1 for r in new.collect()) == list(range(0 if batch == 0 else batch * 5 + 5, batch * 5 + 10))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1: r.first_id for r in runs.seen().collect()} == {i: max(0, (i - 5) // 5) for i in range(30)}
    # a run isn't moved for the join
    left = spark.range(40).selectExpr("id AS h1", "id * 3 AS h2").groupBy("h1", "h2").count().hint("merge")
    plan = left.join(spark.table(runs.levels[2][0]), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    runs.close()


def test_odd_rows(spark, odd, none):
    kept = lines.drop_repeated_lines(odd)
    assert kept.count() == len(ROWS) and set(CLASHING) <= set(kept.columns)
    assert found(kept) == brute([(r[0], r[1]) for r in ROWS])
    assert lines.drop_repeated_lines(none).count() == 0
