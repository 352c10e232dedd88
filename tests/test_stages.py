import numpy as np
import pytest

from wordloom.functions import render
from wordloom.operators import morphology, stages


def test_singular_vectors_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(60, 6))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    values, vectors = stages.singular_vectors(points, 3)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3])
    got = np.array([r["u"] for r in stages.projected(points, vectors).orderBy("id").collect()])
    assert np.allclose(got, x @ vectors)


def test_merged_classes_find_blocks():
    c = np.zeros((6, 6))
    for i in range(6):
        for j in range(6):
            c[i, j] = 20 if (i % 2) != (j % 2) else 1
    labels = stages.merged_classes(c, 2)
    assert labels[0] == labels[2] == labels[4] != labels[1] == labels[3] == labels[5]


def test_stemmer(spark):
    words = spark.createDataFrame([("rereadings",), ("un",), ("went",), ("s",)], "w string")
    exceptions = spark.createDataFrame([("went", "go.ed")], "w string, parse string")
    found = {r["w"]: r["parse"] for r in morphology.stemmed(words, ["re", "un"], ["ing", "s"], exceptions).collect()}
    assert found == {"rereadings": "re.re.ad.ing.s", "un": "un", "went": "go.ed", "s": "s"}


def test_rendering_and_variables(spark):
    df = spark.createDataFrame([("a_b", 1), (None, 22)], "name string, n int")
    assert render.ascii_table(df).splitlines()[0] == "name  n"
    assert r"a\_b & 1 \\" in render.latex_table(df)
    assert render.expanded({"a": "$(b)/x", "b": "${c}", "c": "1"}) == {"a": "1/x", "b": "1", "c": "1"}
    with pytest.raises(ValueError):
        render.expanded({"a": "$(a)"})
