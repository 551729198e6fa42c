"""Fill-in-middle: outputs against plain slicing of code points, and the exact way back."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearmark.llm import fim

TEXT = st.lists(st.sampled_from(["a", "é", "漢", "😀", "<", "P", ">", "S>", "<P", "M", "<S>", "\n", "\0"]), max_size=14).map("".join)


def plainly(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
@settings(max_examples=150, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 10**6)), TEXT), max_size=9))
def test_batches_equal_slicing(step, rows):
    before, fim.STEP = fim.STEP, step
    try:
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        cols = fim.transform_batch(ids, pa.array(texts, pa.string()))
        assert list(zip(*(c.to_pylist() for c in cols))) == [plainly(*r) for r in rows]
        assert fim.to_texts(*fim.gathered(*fim.buffers(cols[4]), cols[1].to_pylist())).to_pylist() == texts
    finally:
        fim.STEP = before


def test_sliced_arrays_are_read_from_their_offset():
    whole = pa.array(["aé", "漢字b", "", "xyz"])
    raw, at = fim.buffers(whole.slice(1, 2))
    assert raw.tobytes().decode() == "漢字b" and at.tolist() == [0, 7, 7]


def test_an_output_without_marks_raises():
    with pytest.raises(ValueError):
        fim.gathered(*fim.buffers(pa.array(["no marks"])), ["psm"])


def test_fim_query(docs, rows, empty, odd):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, *plainly(i, t)[:4], sha(plainly(i, t)[4]), sha(t or "")) for i, t, *_ in rows)
    made = fim.transform(docs)
    assert sorted(map(tuple, fim.digest(made).collect()), key=lambda r: r[0]) == want
    assert {r.output for r in made.collect()} == {plainly(i, t)[4] for i, t, *_ in rows}
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(empty)).count() == 0
    assert [r.form for r in fim.digest(fim.transform(odd)).collect()].count("plain") >= 1 and fim.restore(fim.transform(odd)).count() == 3


def test_a_long_text_crosses_stretches(spark):
    text = "aé漢😀" * 600_000
    got = fim.restore(fim.transform(spark.createDataFrame([(5, text)], "doc_id bigint, text string"))).first()
    assert got.restored == text and got.output == plainly(5, text)[4]
