from collections import Counter

import pyarrow.dataset as ds

from codewarden.llm import language
from codewarden.llm.queries import QUERIES
from tests.llm.helpers import EDGES, docs

SF = "/root/testdata/sf0.001"


def grams(text):
    """Plain version: counts of all n-grams of letters with gaps at word edges."""
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    line = f" {' '.join(line.split())} "
    out = Counter()
    for n in range(1, language.GRAM + 1):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if gram.strip() and (n < 3 or " " not in gram[1:-1]) and gram != " ":
                out[gram] += 1
    return {g: c for g, c in out.items()}


def number(gram):
    value = 0
    for c in gram:
        value = value << language.BITS | (1 if c == " " else ord(c))
    return value


def test_counts_equal_a_plain_count(monkeypatch):
    for strip in (4, 1 << 20):
        monkeypatch.setattr(language, "STRIP", strip)
        for text in ("The cat's mat, 12 mats!", "a", "  ÉÇ ñ x ", "日本 語"):
            found, counts, _ = language.gram_counts(text)
            got = dict(zip(found.tolist(), counts.tolist()))
            edges = got.pop(1, None)
            assert edges is None
            assert got == {number(g): c for g, c in grams(text).items() if g != " "}


def test_held_out_accuracy(spark):
    truth = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "lang"]).to_pylist()
    lang = {r["doc_id"]: r["lang"] for r in truth}
    rows = QUERIES["op6_rank_order"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_distance_by_hand(spark):
    known = spark.createDataFrame([("aa ab", "x"), ("zz zy", "y"), ("bb", None), (None, "x")], "text string, lang string")
    model = language.RankModel(language.profiles(known))
    assert model.langs == ["x", "y"]
    assert model.classify("aa ab") == ("x", 1.0)
    assert model.classify("zz")[0] == "y"
    assert model.classify("qqq")[0] == "x"  # equally far from both
    assert model.classify("qqq")[1] == 0.0


def test_edges(spark):
    known = spark.createDataFrame([("some words here", "en")], "text string, lang string")
    model = language.RankModel(language.profiles(known))
    rows = docs(spark, [*EDGES, (8, "123 !?")], extra=True)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(rows, model).collect()}
    assert got == {
        (None, "und", False),
        (None, "en", True),
        (1, "und", False),
        (2, "und", False),
        (3, "und", False),
        (4, "en", True),
        (8, "und", False),
    }
    none = language.RankModel(language.profiles(known.limit(0)))
    assert {r.lang_pred for r in language.identify(rows, none).collect()} == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0
