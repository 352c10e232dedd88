import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import perplexity, quality_model


def test_classifier_on_held_out_rows(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality_model.classified(documents, labels).toPandas()
    assert len(rows) == documents.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    known = rows.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out & known.quality.isin([0, 1])]
    good, bad = known.score[known.quality == 1], known.score[known.quality == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, None), (None, 1), (3, 5)], "doc_id long, quality int")
    rows = quality_model.classified(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.classified(no_docs, labels).count() == 0
    none = quality_model.classified(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def slow_score(net, text):
    """The network by plain loops: filters, half chunks, overlapping chunks, pools, weights."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pools = np.zeros((2, quality_model.FILTERS))
    if data:
        half = quality_model.CHUNK // 2
        padded = data + b"\0" * (quality_model.WIDTH - 1)
        values = [[float(sum(net.table[k, padded[i + k], f] for k in range(quality_model.WIDTH))) for f in range(quality_model.FILTERS)] for i in range(len(data))]
        halves = [[max(v[f] for v in values[a : a + half]) for f in range(quality_model.FILTERS)] for a in range(0, len(data), half)]
        chunks = [[max(x, y) for x, y in zip(a, b, strict=True)] for a, b in zip(halves, halves[1:], strict=False)] or halves
        active = [[max(x + float(net.bias[f]), 0.0) for f, x in enumerate(c)] for c in chunks]
        pools = np.array([[sum(c[f] for c in active) / len(active) for f in range(quality_model.FILTERS)], [max(c[f] for c in active) for f in range(quality_model.FILTERS)]])
    return 1 / (1 + np.exp(-(float((pools * net.weights).sum()) + net.offset)))


def test_score_against_plain_loops(spark, documents):
    net = quality_model.fit(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    docs = documents.where("doc_id < 25").unionByName(spark.createDataFrame([(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "x", "en", "s", 1)], documents.schema))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_model.scored(docs, net).collect():
        assert np.isclose(r["score"], slow_score(net, (texts[r["doc_id"]])), atol=1e-4)


def test_long_texts_are_learned_from_end_to_end(spark):
    from pyspark.sql import functions as F

    size = quality_model.SAMPLE_BYTES
    data = bytes(i % 251 for i in range(3 * size + 77))
    out = spark.createDataFrame([(bytearray(data),), (bytearray(data[:size]),), (bytearray(b""),)], "b binary").select(quality_model.spread(F.col("b")).alias("s")).collect()
    piece = 2 * quality_model.CHUNK
    many = size // piece
    want = b"".join(data[int(i * (len(data) - piece) / (many - 1)) :][:piece] for i in range(many))
    assert [bytes(r["s"]) for r in out] == [want, data[:size], b""] and want.endswith(data[-piece:])


def test_labels_of_one_document(spark):
    docs = spark.createDataFrame([(i, t) for i in (0, 2, 5, 6) for t in ("good words here " * 30, "a") * 50], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 1), (2, 1), (5, 0)], "doc_id long, quality int")
    assert quality_model.fit(docs, labels).offset == quality_model.fit(docs.dropDuplicates(), labels.where("doc_id > 0")).offset


def test_chunks_cover_the_whole_text():
    net = quality_model.train([b"aaaa " * 200, b"zz!! " * 200], [1, 0], 0.5)
    clean = "aaaa " * 2000
    assert net.score(clean) > net.score(clean + "zz!! " * 60)
    long = ("aaaa " * 150_000).encode()
    assert np.allclose(net.pooled(long)[1], net.pooled(long[:5000])[1])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_base_rules_against_brute_force(request, which):
    docs = request.getfixturevalue(which).select("doc_id", "text", "lang")
    for r in perplexity.judged(docs, ["doc_id", "text"]).collect():
        want = slow_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_an_empty_table(no_docs):
    assert perplexity.judged(no_docs.select("doc_id", "text", "lang"), ["doc_id"]).count() == 0


def slow_stream(text):
    words = WORD.findall((text or "").replace("\x02", "\ufffd").replace("\x03", "\ufffd"))
    n = perplexity.ORDER
    s = "\x02" * (n - 1) + " ".join(words) + "\x03"
    return [s[i - n + 1 : i + 1] for i in range(n - 1, len(s))] if words else []


def slow_model(texts):
    """Interpolated modified Kneser-Ney by plain recursion over the counts of one language: p(gram, one place less)."""
    n = perplexity.ORDER
    levels = {n: Counter(g for t in texts for g in slow_stream(t))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    tables = {}
    for k, counts in levels.items():
        m = [sum(1 for c in counts.values() if c == i) for i in range(5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        d = [0.0] + [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.05), i - 0.05) if m[i] and m[1] else 0.5 for i in (1, 2, 3)]
        total, cut = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3)]
        tables[k] = (counts, d, total, cut)

    def p(g, less):
        if not g:
            return 1 / (len(levels[1]) + 1)
        counts, d, total, cut = tables[len(g)]
        c, n_total, left = counts[g], total[g[:-1]], cut[g[:-1]]
        if not less:
            return (c - d[min(c, 3)] + left * p(g[1:], False)) / n_total
        lower = p(g[1:], c == 1)
        if n_total == 1:
            return lower
        return (c - 1 - d[min(c - 1, 3)] + (left - d[min(c, 3)] + d[min(c - 1, 3)]) * lower) / (n_total - 1)

    return p


MODEL_TEXTS = [("en", t) for t in ["the then  there\nother", " this that the thin ", "oh the old other tin"] * 3 + ["in it is", "", None, "\x02 odd \x03"]] + [("", "日本語 テキスト 日本"), (None, "日本 😀"), ("fr", "x"), ("fr", "é")]


def test_model_against_plain_kneser_ney(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(MODEL_TEXTS)], "doc_id int, text string, lang string").repartition(2)
    rows = perplexity.fit(perplexity.count_grams(docs)).collect()
    seen = set()
    for lang in ("en", "", "fr"):
        texts = [t for x, t in MODEL_TEXTS if (x or "") == lang]
        p, counts = slow_model(texts), Counter(g for t in texts for g in slow_stream(t))
        for r in rows:
            if r["lang"] == lang:
                assert r["n"] == counts[r["gram"]]
                assert np.isclose(r["logp"], np.log(p(r["gram"], False))) and np.isclose(r["rest"], np.log(p(r["gram"], True)))
                seen.add((lang, r["gram"]))
        assert {g for x, g in seen if x == lang} == set(counts)
    assert len(seen) == len(rows)
    model = {(r["lang"], r["gram"]): r["logp"] for r in rows}
    contexts = {("en", g[:-1]) for x, g in seen if x == "en"}
    for _, context in contexts:  # known continuations of a context never have more than all of the mass
        assert sum(np.exp(v) for (x, g), v in model.items() if x == "en" and g[:-1] == context) <= 1 + 1e-9


@pytest.mark.parametrize(("size", "sent"), [(0, 4_000_000), (40, 4_000_000), (40, 0)])
def test_perplexity_and_bands_against_brute_force(request, spark, monkeypatch, size, sent):
    monkeypatch.setattr(perplexity, "BROADCAST", sent)
    docs = request.getfixturevalue("documents").where("doc_id < 120").select("doc_id", "text", "lang")
    if size:  # texts in parts
        monkeypatch.setattr(perplexity, "TOGETHER", size)
        docs = docs.where("doc_id < 25")
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t, lang) for i, (lang, t) in enumerate(MODEL_TEXTS)], docs.schema))
    rows = docs.collect()
    langs = [r["lang"] or "" for r in rows]
    models = {x: slow_model([r["text"] for r, lang in zip(rows, langs, strict=True) if lang == x]) for x in set(langs)}
    known: dict = {}

    def log_p(lang, g):
        if (lang, g) not in known:
            known[lang, g] = np.log(models[lang](g, True))
        return known[lang, g]

    want = {}
    for r, lang in zip(rows, langs, strict=True):
        counts, grams = slow_counts(r["text"]), slow_stream(r["text"])
        want[r["doc_id"]] = [lang, counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0], -np.mean([log_p(lang, g) for g in grams]) if grams else None]
    kept = {}
    for lang in set(langs):
        own = {i: w for i, w in want.items() if w[0] == lang}
        fine = {i: w for i, w in own.items() if not w[2]}
        if fine:
            middle = np.percentile([round(w[3], 4) for w in fine.values()], 50)
            distance = {i: round((w[3] - middle) / np.sqrt(1 + perplexity.LENGTH_SCALE / (w[1][1] + w[1][0])), 5) for i, w in fine.items()}
            q1, q3 = np.percentile(list(distance.values()), [25, 75])
            spread = perplexity.SPREAD * (q3 - q1)
            kept |= {i: q1 - spread <= d <= q3 + spread for i, d in distance.items()}
    assert 0 < sum(kept.values()) < len(rows)
    for r in perplexity.judged(docs, ["doc_id"]).collect():
        lang, counts, failed, logs = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert (r["base_failed"], r["kept"]) == (failed, kept.get(r["doc_id"], False)), r
        assert r["log_perplexity"] is None if logs is None else np.isclose(r["log_perplexity"], logs, atol=1e-7)


def test_grams_of_many_characters(monkeypatch):
    monkeypatch.setattr(perplexity, "_BITS", 3)  # seven characters have numbers
    texts = ["abcabc", "defdef ghi", "abcdefghijklmnop", "ab ab"]
    counter, got = perplexity.GramCounter(), Counter()
    made = [rows for t in texts for rows in counter.add("en", perplexity.parts_of(t))] + list(counter.given_out())
    for rows in made:
        for g, n in zip(rows["gram"], rows["n"], strict=True):
            got[g] += int(n)
    assert got == Counter(g for t in texts for g in slow_stream(t))


def test_counts_of_odd_texts():
    texts = ["", " ", "a", "a\na\n\n a \na", "\n\n", "x y\nx y", "a b c d e f g h a b c d e f g h", "a b c d e f g h b c d e f g h i", "# $ \x1c \x85 \u3000", "w " * 50, "l\r\nl\r\n", "\U0001f600 é"]
    assert [tuple(r) for r in perplexity.all_base_counts(texts).tolist()] == [slow_counts(t)[:1] + slow_counts(t)[1:] for t in texts]
    assert [perplexity.base_counts(t) for t in texts] == [slow_counts(t) for t in texts]
