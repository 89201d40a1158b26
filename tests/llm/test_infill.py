import hashlib
import os
import re
import tracemalloc

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from trackfold.llm import infill, queries

DATA = "/root/testdata/sf0.001"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plainly(key, text):
    """The contract with all units in a list."""
    text = text or ""
    units = re.findall(UNITS, text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, body, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(head), len(body), f"<S>{tail}<P>{head}<M>{body}"
    return n, "psm", len(head), len(body), f"<P>{head}<S>{tail}<M>{body}"


ROWS = [
    *[(i, f" word{i}  naïve\t   日本語\n{'é ' * i}\x0b\x0c tail  ") for i in range(60)],
    *[(i, t) for i in range(100, 112) for t in (None, "", " ", "\n\t ", "x", "a<P>b", "a <S> b <M", "<M", "<<P>", "\x1c\x1f a\x85b")],
    (7, "repeated row"),
    (7, "repeated row"),
    (None, "no key at all here"),
    (200, "long " * 100_000),
    (201, "z" * 1_000_000),
    (202, " " * 300_000),
]


def test_equals_lists_of_units(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, form string, n int").repartition(3)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in infill.rearranged(docs).collect()]
    want = [(i, *plainly(i, t), t or "") for i, t in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_other_parameters(spark):
    docs = spark.createDataFrame(ROWS[:40], "key long, body string")
    assert infill.rearranged(docs.limit(0), key="key", text="body").count() == 0
    how = infill.Infill(seed=1, share=100, spm_share=0, prefix=b"<|pre|>", suffix=b"<|suf|>", middle=b"<|mid|>")
    rows = infill.rearranged(docs, how, key="key", text="body").collect()
    assert {r.form for r in rows} == {"psm"} and all(r.output.startswith("<|pre|>") for r in rows)
    assert sorted(r.restored for r in rows) == sorted(t for _, t in ROWS[:40])


@given(st.text(alphabet=" \tab<>PSM\x1cé　", max_size=30), st.integers(0, 400))
def test_any_text_comes_back(text, key):
    how, raw = infill.Infill(share=100), text.encode()
    draws, n = how.draws(key), infill.count_units(raw)
    form = how.form(raw, draws)
    low, high = infill.cut(raw, tuple(sorted(h % (n + 1) for h in draws[:2])))
    assert how.restore(form, how.join(form, raw, low, high)) == raw


def test_overlapping_sentinels_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        infill.Infill(prefix=b"aba")
    with pytest.raises(ValueError, match="overlap"):
        infill.Infill(prefix=b"<S>")


def test_no_unit_is_stored():
    raw = b"some words " * 200_000
    tracemalloc.start()
    n = infill.count_units(raw)
    infill.cut(raw, (n // 3, n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_001 and peak < 100_000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = queries.op13_infill(spark, DATA)
    cursor = con.execute(queries.ORACLES["op13_infill"])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(cursor.fetchall(), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
