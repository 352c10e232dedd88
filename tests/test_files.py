import random

import pytest

from wordloom.sources import files


@pytest.fixture
def short_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sentences_go_on_over_splits(spark, tmp_path, short_splits):
    rng = random.Random(5)
    want = {}
    for name in ("a", "b"):
        sentences = [[f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30))] for _ in range(25)]
        text = "%% head\n\n" + "".join("".join(f"{w}\tT\tx\n" for w in sentence) + "\n" * rng.randint(1, 3) for sentence in sentences) + "%% end\n"
        (tmp_path / f"{name}.ttt").write_text(text)
        want |= {(name, i): sentence for i, sentence in enumerate(sentences, 1)}
    read = files.read_tt(spark, str(tmp_path))
    assert files.numbered_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 20
    got = {(r["file"].rsplit("/", 1)[-1][0], r["sid"]): [t["text"] for t in r["toks"]] for r in read.collect()}
    assert got == want
    assert all(t["tag"] == "T" and t["details"] == ["x"] for t in read.first()["toks"])


def test_cells_are_filled_down_over_splits(spark, tmp_path, short_splits):
    rng = random.Random(6)
    rows = sorted({(f"w{rng.randint(0, 3)}", f"v{rng.randint(0, 60)}") for _ in range(90)})
    lines, last = [], None
    for k, (a, b) in enumerate(rows):
        lines.append(f"{'' if a == last else a}\t{b}\t{k}")
        last = a
    (tmp_path / "x.123").write_text("\n".join(lines) + "\n")
    got = {(r["w1"], r["w2"], r["f"]) for r in files.read_ngrams(spark, str(tmp_path / "x.123"), 2).collect()}
    assert got == {(a, b, float(k)) for k, (a, b) in enumerate(rows)}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_text_forms_come_back(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    pairs = spark.createDataFrame([("a", "x y"), ("b", "1"), ("é", "")], "k string, v string")
    files.write_map(pairs, at("map"))
    assert rows_of(files.read_map(spark, at("map"))) == rows_of(pairs)
    files.write_set(spark.createDataFrame([("q",), ("q",), ("z",), (None,)], "s string"), "s", at("set"))
    assert rows_of(files.read_set(spark, at("set"))) == {("q",), ("z",)}
    enum = spark.createDataFrame([("x", 0), ("y z", 1)], "sym string, id long")
    files.write_enum(enum, at("enum"))
    assert rows_of(files.read_enum(spark, at("enum"))) == rows_of(enum)
    lex = spark.createDataFrame([("w", "A", 2.0), ("w", "B", 1.0), ("v", "B", 5.0)], "w string, tag string, f double")
    moves = spark.createDataFrame([("A", "B", 3.0), ("A", "A", 1.0), ("__$", "A", 4.0)], "t1 string, t2 string, f double")
    files.write_hmm(lex, moves, at("model"))
    again = files.read_hmm(spark, at("model"))
    assert rows_of(again[0]) == rows_of(lex) and rows_of(again[1]) == rows_of(moves)
    cells = spark.createDataFrame([("r", "c", 1.5), ("r", "d", -2.0), ("s", "d", 4.0)], "row string, column string, value double")
    files.write_matrix(cells, at("matrix"), "row", "column", "value", ["c", "d"])
    assert rows_of(files.read_matrix(spark, at("matrix"))) == rows_of(cells)
