"""Sections in the lines form against those of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from brevilog.operators import compact as K
from brevilog.operators.lines import lines_of_texts
from brevilog.operators.sections import distill_lines, distill_lines_report, section_lines
from brevilog.operators.texts import distill, distill_report, sections
from brevilog.params import Params
from . import corpus

EDGES = ["", "\n", "\n\n", "a", "\na", "\n\na", "\n \n\ta \n", "a\n\n\n \nb\n", " a\n\n b \n\n\n", "a\r\n\r\nb\r\r\n c\r\n", "  \n  x\n", "　a\n \nb　"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(1000 + i, t) for i, t in enumerate(EDGES)]
    rows += [(i, t) for i, t, _ in corpus.texts(40)]
    rows += [(2000 + i, "".join(r.choice(["\n", "\n", " ", "word", "ERROR x\n", "a  b  c\n", "\t"]) for _ in range(r.randint(0, 200)))) for i in range(30)]
    return spark.createDataFrame(rows, "doc bigint, text string").repartition(3).cache()


def joined(found):
    """Text of each section from its numbered lines."""
    out = {}
    for r in found.orderBy("run_id", "line_no").collect():
        out.setdefault((r.run_id.doc, r.run_id.section_no), []).append(r.line + "\r" * r.cr + "\n" * r.lf)
    return {k: "".join(v) for k, v in out.items()}


@pytest.mark.parametrize("window,block", [(0, 5), (0, 65_536), (3, 5), (12, 5)])
def test_sections_of_lines_and_texts(texts, window, block):
    found = section_lines(lines_of_texts(texts, "doc"), window, Params(block_lines=block)).cache()
    want = {(r.doc, r.section_no): r.text for r in sections(texts, "doc", window_lines=window).collect()}
    assert joined(found) == want
    numbers = {}
    for r in found.collect():
        numbers.setdefault(r.run_id, []).append(r.line_no)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


@pytest.mark.parametrize("window,intent", [(0, None), (40, "debug:test-failure")])
def test_distill_of_lines_and_texts(texts, window, intent):
    asked = None if intent is None else F.lit(intent)
    done = distill_lines(lines_of_texts(texts, "doc"), window, Params(block_lines=5), asked)
    ends = {r.run_id: r.ends_newline for r in done.runs.collect()}
    out = {}
    for r in K.number_lines(done).orderBy("run_id", "out_no").collect():
        out.setdefault(r.run_id, []).append(r.line)
    whole = distill(texts, "doc", window_lines=window, intent=asked).cache()
    rows = whole.collect()
    assert len(rows) == len(out)
    plain = [r for r in rows if "\r" not in r.text]
    assert {(r.doc, r.section_no): r.compacted for r in plain} == {
        (k.doc, k.section_no): "\n".join(v) + "\n" * ends[k] for k, v in out.items() if (k.doc, k.section_no) in {(r.doc, r.section_no) for r in plain}}
    totals = {r.doc_id: r[1:] for r in distill_lines_report(done).collect()}
    want = {r.doc: r[1:] for r in distill_report(whole, "doc").collect()}
    with_cr = {r.doc for r in rows if "\r" in r.text}
    assert {k: v for k, v in totals.items() if k not in with_cr} == {k: v for k, v in want.items() if k not in with_cr}


def test_one_paragraph_holds_a_third(spark):
    """A paragraph over many blocks keeps one number and dense lines."""
    lines = spark.range(1, 3001).select(F.lit(1).alias("run_id"), F.col("id").alias("line_no"), F.when(F.col("id").isin(2, 1500, 2999), " ").otherwise(" x ").alias("line"))
    got = section_lines(lines, p=Params(block_lines=7)).groupBy("run_id.section_no").agg(
        F.count("*").alias("n"), F.max("line_no").alias("last"), F.sum(F.length("line")).alias("size")).orderBy("section_no").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1), (1, 1497, 1497, 3 * 1497 - 2), (2, 1498, 1498, 3 * 1498 - 2), (3, 1, 1, 1)]


def test_no_lines(spark):
    empty = spark.createDataFrame([], "run_id bigint, line_no bigint, line string")
    assert section_lines(empty).count() == 0 and K.number_lines(distill_lines(empty, 5)).count() == 0
