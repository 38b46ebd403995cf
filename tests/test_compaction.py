import pytest
from pyspark.sql import functions as F

from brevilog.operators import compact as K
from brevilog.operators.classify import sample_facts
from brevilog.operators.intents import focus_failures
from brevilog.operators.lines import lines_of_texts
from brevilog.operators.mining import templates
from brevilog.operators.texts import compact_texts, distill, sections
from brevilog.params import Params
from . import brute, corpus

SCHEMA = "run_id bigint, text string, intent string"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(corpus.texts(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def expected():
    return {i: brute.compact(t, intent) for i, t, intent in corpus.texts()}


def test_corpus_reaches_every_branch(expected):
    assert {k for k, _ in expected.values()} == {"tabular", "linear-log", "tree", "passthrough"}


def test_texts_match_definitions(texts, expected):
    rows = compact_texts(texts, intent=F.col("intent")).collect()
    for r in rows:
        assert (r.archetype, r.compacted) == expected[r.run_id]
        assert r.tokens_in == (len(r.text.encode()) + 3) // 4
        assert r.tokens_out == (len(r.compacted.encode()) + 3) // 4
        assert r.tokens_saved == max(r.tokens_in - r.tokens_out, 0)


# Blocks of 7 and 23 lines cut nearly every run; the default leaves each run whole.
@pytest.mark.parametrize("block,parts", [(7, 1), (23, 17), (65_536, 4)])
def test_lines_match_texts(texts, block, parts):
    # As a lines table: line ends are LF and the text ends with one.
    lf = texts.withColumn("text", F.concat(F.regexp_replace(F.regexp_replace("text", "\r", ""), r"\n\z", ""), F.lit("\n")))
    expected = {r.run_id: (brute.compact(r.text, r.intent)) for r in lf.collect()}
    lines = lines_of_texts(lf, "run_id").repartition(parts)
    done = K.compact_lines(lines, Params(block_lines=block), intent=lf.select("run_id", "intent"))
    ends = {r.run_id: (r.archetype, r.ends_newline) for r in done.runs.collect()}
    out = {}
    for r in K.number_lines(done).orderBy("run_id", "out_no").collect():
        out.setdefault(r.run_id, []).append(r)
    sizes = {r.run_id: r.out_bytes for r in K.report(done).collect()}
    for run_id, (kind, text) in expected.items():
        got = out.get(run_id, [])
        assert [r.out_no for r in got] == list(range(1, len(got) + 1))
        built = "\n".join(r.line for r in got) + ("\n" if got and ends[run_id][1] else "")
        assert (ends[run_id][0], built) == (kind, text)
        assert sizes[run_id] == len(text.encode())


def test_focus_over_block_edges(spark):
    rows = [(1, i, "ERROR here" if i in (15, 16, 60, 95) else f"line {i}") for i in range(1, 101)]
    rows += [(2, i, f"calm {i}") for i in range(1, 31)]
    df = spark.createDataFrame(rows, "run_id bigint, out_no bigint, line string")
    for block in (12, 40, 1000):
        got = focus_failures(df, Params(block_lines=block)).orderBy("run_id", "out_no").collect()
        assert [r.line for r in got if r.run_id == 1] == brute.focus([l for run, _, l in rows if run == 1])
        assert [r.line for r in got if r.run_id == 2] == [l for run, _, l in rows if run == 2]


def test_sections(spark):
    text = "  a\nb \n \n\n\nc\n\u3000\nd\n"
    df = spark.createDataFrame([(1, text), (2, "\n \n"), (3, "")], "doc bigint, text string")
    assert [r.text for r in sections(df, "doc").orderBy("section_no").collect()] == ["a\nb", "c", "d"]
    by_two = sections(df.filter("doc = 1"), "doc", window_lines=2).orderBy("section_no").collect()
    assert [r.text for r in by_two] == ["a\nb", "c", "d"]


def test_distill_compacts_each_section(spark):
    log = "\n".join(f"Connection error at 10.0.0.{i}" for i in range(200))
    df = spark.createDataFrame([(1, log + "\n\nshort tail\n")], "doc bigint, text string")
    rows = distill(df, "doc").orderBy("section_no").collect()
    assert [r.archetype for r in rows] == ["linear-log", "passthrough"]
    assert rows[0].compacted.startswith("Connection error at 10.0.0.0  × 195\n--- last 5 lines ---\n")
    assert rows[1].compacted == "short tail"


def test_templates_count_lines_and_runs(spark):
    rows = [(r, i, f"user {100 + i} in" if i % 3 else "tick") for r in (1, 2, 3) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "run_id bigint, line_no bigint, line string")
    got = {r.template: (r.lines, r.runs, r.first_run, r.first_line_no, r.sample) for r in templates(df).collect()}
    assert got == {"user <NUM> in": (18, 3, 1, 1, "user 101 in"), "tick": (9, 3, 1, 3, "tick")}


def test_empty_lines_table(spark):
    lines = spark.createDataFrame([], "run_id bigint, line_no bigint, line string")
    done = K.compact_lines(lines)
    assert K.number_lines(done).count() == 0 and K.report(done).count() == 0


def test_line_numbers_with_gaps(spark):
    """Lines from 21 on, or with even numbers only, give what counted lines give, for any block size."""
    text = [f"no answer from 172.20.3.{i}:6100" for i in range(100)]
    dense = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(text)], "run_id long, line_no long, line string")
    want = [r.line for r in K.number_lines(K.compact_lines(dense)).orderBy("out_no").collect()]
    assert want
    for numbers in ([21 + i for i in range(100)], [2 * i + 2 for i in range(100)]):
        rows = spark.createDataFrame([(1, n, x) for n, x in zip(numbers, text)], "run_id long, line_no long, line string")
        for block in (50, 65_536):
            done = K.compact_lines(rows, Params(block_lines=block))
            assert [r.line for r in K.number_lines(done).orderBy("out_no").collect()] == want


def test_focus_does_not_depend_on_blocks(spark):
    rows = [(1, i, "ERROR here" if i == 50 else f"line {i}") for i in range(1, 101)]
    lines = spark.createDataFrame(rows, "run_id long, line_no long, line string").withColumn("out_no", F.col("line_no"))
    counts = {focus_failures(lines, Params(block_lines=b)).count() for b in (5, 7, 12, 1000)}
    assert len(counts) == 1


def test_every_line_number_counts(spark):
    """Numbers from 0, with a gap, or with repeats that make up for gaps: no line is lost."""
    text = [f"no answer from 172.20.3.{i}:6100" for i in range(100)]
    for numbers in ([0, *range(2, 101)], [1, 5, 6, *[n for n in range(1, 101) if n not in (2, 3, 7)]], [0] * 100, [*range(1, 100), 99]):
        rows = spark.createDataFrame([(1, n, x) for n, x in zip(numbers, text, strict=True)], "run_id long, line_no long, line string")
        for block in (50, 65_536):
            done = K.compact_lines(rows, Params(block_lines=block))
            assert [r.n_lines for r in done.runs.collect()] == [100]
            out = [r.line for r in K.number_lines(done).orderBy("out_no").collect()]
            assert "  × 95" in out[0] and len(out) == 7


def test_dense_numbers_are_told(spark):
    from brevilog.operators.classify import run_totals
    cases = {"dense": range(1, 51), "late": range(2, 52), "gap": [*range(1, 50), 51], "zero": range(50), "one": [1],
             "sums": [1, 5, 6, 1, 4, 5, 6, 8], "twice": [1, 1, 3, 4]}
    rows = [(name, n, "x") for name, numbers in cases.items() for n in numbers]
    got = {r.run_id: r.dense for r in run_totals(spark.createDataFrame(rows, "run_id string, line_no long, line string")).collect()}
    assert got == {name: sorted(n) == list(range(1, len(n) + 1)) for name, n in cases.items()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_bytes_are_exact(spark, end, last):
    """Texts around the limit of 256 bytes, with CRLF and without a last line end, count as their bytes."""
    texts = []
    for size in (200, 254, 255, 256, 257, 300, 600):
        body = end.join(f"row {i:03} waits for 10.0.0.{i}" for i in range(60))
        body = body[: size - len(end)].rstrip("\r\n") if last else body[:size].rstrip("\r\n")
        body += end if last else ""
        body = body.replace("w", "w" * (1 + max(0, size - len(body))), 1)
        texts.append((len(texts), body))
    texts += [(len(texts), end.join(["a"] * 120)), (len(texts) + 1, ""), (len(texts) + 2, end)]
    frame = spark.createDataFrame(texts, "run_id long, text string")
    want = {r.run_id: (r.archetype, r.tokens_in, r.tokens_out) for r in compact_texts(frame).collect() if r.text}
    for block in (3, 65_536):
        done = K.report(K.compact_lines(lines_of_texts(frame, "run_id", exact=True), Params(block_lines=block))).collect()
        assert {r.run_id: (r.archetype, r.tokens_in, r.tokens_out) for r in done} == want
        assert {r.run_id: r.n_bytes for r in done} == {i: len(t) for i, t in texts if t}


def test_only_blank_lines_of_prose_are_moved(spark):
    """Blank lines tell by their numbers which of them follow another, across block edges too; other lines meet no window."""
    p = Params(block_lines=4)
    texts = {1: ["one word " * 40, "", " ", "", "", "\t", "two", "", "", "three", "", "four", ""], 2: [""] * 9, 3: ["plain " * 60] * 3}
    lines = spark.createDataFrame([(r, k + 1, x) for r, t in texts.items() for k, x in enumerate(t)], "run_id long, line_no long, line string")
    done = K.compact_lines(lines, p, force="passthrough")
    want = {r: [x.rstrip() for k, x in enumerate(t) if x.strip() or not k or t[k - 1].strip()] for r, t in texts.items()}
    got = {}
    for x in K.number_lines(done).orderBy("run_id", "out_no").collect():
        got.setdefault(x.run_id, []).append(x.line)
    assert got == want
    rows = lines.selectExpr("*", "0L AS block", "13L AS n_lines", "'passthrough' AS route", "false AS is_long", "'none' AS kind")
    assert {x.line for x in K.blank_lines(rows, p, False).collect()} == {""}
    plan = K.keep_lines(rows, p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert "line" not in sample_facts(lines).columns
