import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codewarden.llm import spelling
from codewarden.llm.fm_index import DelimitedIndex
from codewarden.llm.queries import QUERIES

from .helpers import EDGES, docs


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """(word, form, root, n, n_near, form_n) by comparing all words with all."""
    words = sorted(counts)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def counted(texts):
    total = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def some_words(r, n, letters="abé", longest=9):
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcé"), (3, "a"), (4, "abcdefghijklmnopqrstuvwxyz")])
def test_index_finds_every_word_one_edit_away(seed, letters):
    r = random.Random(seed)
    words = [w.encode("latin-1") for w in some_words(r, 400, letters)]
    index = DelimitedIndex(words)
    for length in range(1, 9):
        asked = [w for w in words if len(w) == length] + [bytes(r.choice(letters).encode("latin-1")[0] for _ in range(length)) for _ in range(20)]
        asked = list(dict.fromkeys(asked))
        letters_of = np.frombuffer(b"".join(asked), np.uint8).reshape(len(asked), length)
        for loose in range(length + 1):
            rows, found = index.one_edit(letters_of, loose)
            got = sorted(zip(rows.tolist(), found.tolist()))
            want = sorted(
                (i, j)
                for i, a in enumerate(asked)
                for j, b in enumerate(words)
                if one_edit(a, b) and b.endswith(a[loose:]) and one_edit(a[:loose], b[: len(b) - (length - loose)])
            )
            assert got == want


def test_suffixes_are_ranked_by_word_where_they_end_alike():
    words = [b"aab", b"ab", b"b", b"bab", b"x" * 40, b"y" + b"x" * 40]
    index = DelimitedIndex(words)
    text = index.text.tobytes()
    key = lambda p: (text[p : text.index(0, p)], int(np.searchsorted(index.begin, p, "right")))
    order = sorted(range(len(text)), key=key)
    assert index.before.tolist() == [text[p - 1] for p in order]


@pytest.mark.parametrize("rows", [spelling.ROWS, 25])
def test_near_words_equal_brute_force(spark, rows):
    r = random.Random(7)
    words = [w for w in some_words(r, 1500, "abcé", 8) if len(w) >= 5]
    # One half that many words share, runs of a letter, and one very long word with a slip of it.
    words += [f"shared{x}" for x in some_words(r, 300, "abcd", 6)] + ["a" * n for n in range(5, 40)]
    words += ["long" * 3000, "long" * 1500 + "x" + "long" * 1500]
    counts = {w: r.choice([3, 4, 6, 8, 12, 24, 50]) for w in dict.fromkeys(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(x) for x in spelling.near_words(frame, rows).select("word", "n_near", "best_n", "best").collect()}
    want = set()
    for w, _, _, _, n_near, _ in grouped(counts):
        if n_near:
            near = [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)]
            best = min(near, key=lambda v: (-counts[v], v))
            want.add((w, n_near, counts[best], best))
    assert got == want


def noisy(r, n):
    vocabulary = ["house", "Garden", "straße", "Überall", "naïve", "letters", "better", "bitter", "butter", "aaaaa", "aaaaaa", "four", "×÷×÷×"]
    out = []
    for i in range(n):
        some = []
        for _ in range(r.randrange(60)):
            w = r.choice(vocabulary)
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "x", "é"]) + w[at + 1 :]
            some.append(w + r.choice([" ", ", ", "\n", "1", "ā", "."]))
        out.append((i if r.random() < 0.95 else None, "".join(some)))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = noisy(random.Random(8), 300) + EDGES + [(6000, "chains " * 40 + "chainsx " * 12 + "chainsxy " * 4)] + [(5000, "ordinary words " * 50_000), (5000, "ordinary"), (5000, "ordinary")]
    docs(spark, texts, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_fm_index"](spark, str(tmp_path))
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(x) for x in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == grouped(counted(texts))
    assert any(form and root != form for _, form, root, *_ in got)


def test_chains_are_followed_to_their_root(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w3")]
    found = spelling.follow(spark.createDataFrame(links, "word string, to string"))
    assert {tuple(x) for x in found.select("word", "root").collect()} == {(w, "w40") for w, _ in links}


def test_empty(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "tiny words")])).count() == 0
    alone = pa.table({"side": [0], "word": ["alone"], "n": [3], "held": [True], "asks": [True]})
    assert spelling.near_in_shard(alone).num_rows == 0


def test_slices_do_not_cut_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "abc defghij klmnopqrstuvw x yz"
    assert [w for some in spelling._runs(text) for w in some] == text.split()
