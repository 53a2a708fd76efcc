"""Fill-in-middle: the index against a plain reading, the forms against the whole text, odd rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rulesift.llm import fill_middle
from rulesift.llm.queries import op13_fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, row):
    """The contract's rows, read off the list of all units."""
    t, u = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if row is None else row}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", t
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    return row, len(u), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0babé漢😀 \x00"), max_size=300), st.sampled_from([1, 2, 5, 64]), st.sampled_from([1, 2, 3, 50, 1 << 16]), st.randoms())
def test_checkpoints_find_every_cut(text, step, size, rng):
    units = UNIT.findall(text)
    index = fill_middle.Checkpoints(text.encode(), step, size)
    assert index.units == len(units) and len(index.at_unit) == len(units) // step + 1
    for cut in {0, len(units), rng.randint(0, len(units))}:
        head = "".join(units[:cut])
        assert index.cut(cut) == (len(head.encode()), len(head))


ODD = [None, "", " ", "\n\t ", "word", " a ", "a <P> b", "<S>", "x<M>", "<P", "a < b <S > c", "<" * 50, "漢字 😀 é" * 30, "one two three four " * 40_000, "x" * 300_000]


def test_forms_and_restored_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 12)] + [(None, "no id here"), (3, "same id"), (3, "same id"), (-7, "negative id < and <")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, output string, n int, form string").repartition(3)
    made = fill_middle.transform(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in made.collect()), key=key)
    assert got == sorted((plainly(t, i) for i, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fill_middle.restore(made["output"], made["form"]).alias("text")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)


def test_all_or_none_are_cut(spark):
    docs = spark.createDataFrame([(i, f"some words of row {i}") for i in range(60)], "doc_id long, text string")
    assert {r["form"] for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_middle.transform(docs, rate=100, spm=100).collect()} == {"spm"}
    one, other = ([r["output"] for r in fill_middle.transform(docs, rate=100, seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != other


def test_empty_table_and_query(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_fill_middle(spark, str(tmp_path)).collect() == []
