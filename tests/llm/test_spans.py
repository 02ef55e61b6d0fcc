import re

import pyarrow as pa

from codewarden.llm import spans
from tests.llm.helpers import EDGES, docs, words


def sentences(text):
    """Plain version: (lower-cased words) of each sentence, long ones in pieces."""
    out = []
    for line in (text or "").split("\n"):
        for part in re.split(r"(?<=[.!?])[ \t\r\v\f]+", line):
            found = tuple(part.lower().split())
            out += [found[i : i + spans.PIECE] for i in range(0, len(found), spans.PIECE)]
    return out


def brute(rows):
    """How many sentences go from each document."""
    first, cuts = {}, {}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]))
    for doc_id, text in order:
        found = sentences(text)
        gone = set()
        size = min(spans.RUN, len(found))
        for at in range(len(found) - size + 1 if size else 0):
            run = tuple(found[at : at + size])
            if sum(map(len, run)) < spans.LEAST_WORDS:
                continue
            if first.setdefault(run, (doc_id, at)) != (doc_id, at):
                gone |= set(range(at, at + size))
        cuts[doc_id] = len(gone)
    return cuts


def prose(seed, n):
    return " ".join(f"{words(100 * seed + k, 2 + (seed + k) % 30)}." for k in range(n))


def test_removed_sentences_equal_brute_force(spark):
    shared = prose(99, 5)
    rows = [(n, f"{prose(n, 4)}\n{shared if n % 3 else ''}\n{prose(n + 50, 2)}") for n in range(12)]
    rows += [(20, rows[0][1]), (21, "One. Two. Three."), (22, "One. Two. Three."), (23, shared), (24, prose(4, 2))]
    rows += [(25, words(7, 60)), (26, f"New start. {words(7, 60)}"), (27, words(8, 9)), (28, words(8, 9))]
    found = spans.cut_repeats(docs(spark, rows)).collect()
    assert {r["__id"]: r.removed for r in found} == brute(rows)


def test_the_first_place_stays_and_the_rest_is_untouched(spark):
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta! Iota kappa lambda mu?"
    rows = [(1, f"Mine first. {passage}\nMine last."), (2, f"Yours, too.\n{passage} And more here."), (3, "Other  text.")]
    got = {r["__id"]: r.cut_text for r in spans.cut_repeats(docs(spark, rows, extra=True)).collect()}
    assert got == {1: rows[0][1], 2: "Yours, too.\nAnd more here.", 3: "Other  text."}


def test_within_one_text(spark):
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta. Iota kappa lambda mu."
    (row,) = spans.cut_repeats(docs(spark, [(1, f"{passage} Between. {passage}")])).collect()
    assert row.cut_text == f"{passage} Between." and row.removed == 3


def test_edges_and_empty(spark):
    long = words(5, 30)
    found = spans.cut_repeats(docs(spark, [*EDGES, (9, long), (9, long)])).collect()
    assert len(found) == len(EDGES) + 2 and all(r.removed == 0 for r in found)
    assert sorted(str(r.cut_text) for r in found) == sorted([str(t) for _, t in EDGES] + [long] * 2)
    assert spans.cut_repeats(docs(spark, [])).count() == 0


def test_sentence_bounds():
    found = spans.Sentences(pa.array(["A b. C d!  E\nf", None, "", "x.y z."]))
    assert found.first.tolist() == [0, 4, 4, 4, 5] and found.sizes.tolist() == [2, 2, 1, 1, 2]


def test_a_passage_of_short_sentences(spark):
    passage = " ".join(f"{words(300 + k, 1 + k % 2)}." for k in range(60))
    rows = [(1, f"Mine stands first here.\n{passage}\nMine last."), (2, f"Yours, too.\n{passage}\nAnd more here.")]
    got = {r["__id"]: r.cut_text for r in spans.cut_repeats(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Yours, too.\nAnd more here."}


def test_a_passage_that_starts_inside_a_sentence(spark):
    rows, kept = [], {}
    for n in range(20):
        passage = words(600 + n, 49)
        for place in (2 * n, 2 * n + 1):
            before, after = words(2000 + place, 3 + 5 * (place % 7)), words(3000 + place, 4 + place % 9)
            rows.append((place, f"Start. {before} {passage} {after}."))
            kept[place] = len(f"{before} {after}".split()) + 1
    found = spans.cut_repeats(docs(spark, rows)).collect()
    for r in found:
        left = len(r.cut_text.split()) - kept[r["__id"]]
        assert left == 49 if r["__id"] % 2 == 0 else left <= 4 * (spans.NEAR - 1)


def test_content_runs_depend_on_the_words_nearby():
    texts = [words(1, 80), "a " * 50, f"{words(2, 30)} {words(1, 80)}", "", words(3, 5), words(4, 18), None]
    found = spans.Sentences(pa.array(texts))
    h, owner, at, size = found._content_runs()
    for n, text in enumerate(texts):
        a, b = found.word_first[n : n + 2]
        mine = found.words[a:b].tolist()
        cuts = {0} if mine else set()
        for i in range(len(mine) - spans.NEAR + 1):
            window = mine[i : i + spans.NEAR]
            cuts.add(i + max(k for k, x in enumerate(window) if x == min(window)))
        ends = sorted(cuts | {len(mine)})
        want = {(c, next((e for e in ends if e >= c + spans.LONG_WORDS), None)) for c in cuts}
        want = {(c, e - c) for c, e in want if e}
        assert set(zip(at[owner == n].tolist(), size[owner == n].tolist())) == want
    # Runs that have the same words have the same hash, and no others.
    by_words = {}
    for x, o, a, s in zip(h.tolist(), owner, at, size):
        by_words.setdefault(x, set()).add(tuple(texts[o].split()[a : a + s]))
    assert all(len(v) == 1 for v in by_words.values())
    assert len(by_words) == len({w for v in by_words.values() for w in v})
