import duckdb
import pytest
from tracewell.llm import line_dedup, queries

from .cases import as_set, empty, frame, nasty_rows

SPACE = " \t\r\x0b\x0c"


def brute(rows, window=3):
    """By a walk over the documents in order."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    seen, out = set(), {}
    for last, i, text in order:
        lines = text.split("\n")
        full = [(k, s.strip(SPACE)) for k, s in enumerate(lines) if s.strip(SPACE)]
        gone = set()
        for at in range(len(full) - window + 1):
            part = tuple(s for _, s in full[at : at + window])
            if part in seen:
                gone |= set(range(full[at][0], full[at + window - 1][0] + 1))
            seen.add(part)
        out[(None if last else i, text)] = ("\n".join(s for k, s in enumerate(lines) if k not in gone), len(lines), len(gone))
    return sorted(repr((i, *(out[(i, t)] if t is not None else (None, None, 0)))) for i, t in rows)


def test_against_a_walk(spark):
    rows = [r for r in nasty_rows() if r not in ((2, nasty_rows()[0][1]), (9, "y"))]  # one text for each id
    rows = list({i: (i, t) for i, t in rows}.values())
    loop = "a\nb\nc\n" * 5
    rows += [(20, loop), (21, "x\n\n  a \nb\t\n\nc\ny"), (22, "a\nb"), (23, "\n".join("qrs")), (24, "q\nr\ns\nt\nq\nr\ns")]
    assert as_set(line_dedup.dedup_lines(frame(spark, rows, clash=True))) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "z\na\nb\nc")]
    assert as_set(line_dedup.dedup_lines(frame(spark, rows))) == sorted(map(repr, [(1, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "z", 4, 3)]))


def test_empty_table(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = sorted(map(repr, con.execute(f"select doc_id, text, n_lines, n_removed from ({line_dedup.ORACLE_SQL})").fetchall()))
    got = queries.op1_line_dedup(spark, sf_small)
    assert as_set(got.select("doc_id", "text", "n_lines", "n_removed")) == want


@pytest.mark.parametrize("window", [1, 2, 4])
def test_other_windows(spark, window):
    rows = [(k, "\n".join("abcabdabc"[k:])) for k in range(5)]
    assert as_set(line_dedup.dedup_lines(frame(spark, rows), window=window)) == brute(rows, window)
