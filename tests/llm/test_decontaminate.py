from itertools import combinations

from codewarden.llm import decontaminate as dc
from tests.llm.helpers import EDGES, docs, words


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, items):
    """(doc_id, item_id) of all leaks, by comparing every window with every window."""
    found = set()
    for doc_id, text in rows:
        mine = (text or "").lower().split()
        for item_id, item in items:
            theirs = (item or "").lower().split()
            size = min(len(theirs), dc.WINDOW)
            if size < dc.LEAST_WORDS:
                continue
            spare = dc.SUBSTITUTIONS if size == dc.WINDOW else 0
            for a in range(len(mine) - size + 1):
                for b in range(len(theirs) - size + 1):
                    if sum(mine[a + k] != theirs[b + k] for k in range(size)) <= spare:
                        found.add((doc_id, item_id))
    return found


def test_every_substitution_leaves_a_mask():
    for wrong in combinations(range(dc.WINDOW), dc.SUBSTITUTIONS):
        assert any(
            not {p + shift for p in mask} & set(wrong)
            for mask in dc.MASKS
            for shift in range(dc.WINDOW - max(mask))
        )


def test_leaks_equal_brute_force(spark):
    items = [(n, words(n, 5 + 3 * n)) for n in range(10)] + [(90, "too short to tell"), (91, None)]
    rows = []
    for n, (_, item) in enumerate(items[:10]):
        text = item.split()
        for wrong in range(4):
            changed = list(text)
            for at in range(wrong):
                changed[(at * 5 + 2) % len(changed)] = f"y{at}"
            around = words(500 + 10 * n + wrong, 30).split()
            rows.append((10 * n + wrong, " ".join(around[:wrong] + changed + around[wrong:])))
        rows.append((10 * n + 5, " ".join(text[: max(4, len(text) // 2)])))
        rows.append((10 * n + 6, " ".join(words(700 + n, 9).split() + text[3:16])))
    rows += [(200 + n, words(900 + n, 80)) for n in range(5)]
    found = dc.leaks(docs(spark, rows), bench(spark, items))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(rows, items)


def test_place_of_a_leak(spark):
    item = words(3, 20)
    rows = [(1, f"{words(8, 7)} {item.upper()}, {words(9, 5)}"), (1, "else")]
    (hit,) = dc.leaks(docs(spark, rows), bench(spark, [(5, item), (5, item)])).collect()
    assert (hit.doc_id, hit.item_id, hit.matched, hit.first_word, hit.last_word) == (1, 5, 13, 7, 26)


def test_edges_and_decision(spark):
    item = words(3, 20)
    rows = [*EDGES, (10, item), (None, item)]
    frame = docs(spark, rows, extra=True)
    kept = dc.decontaminate(frame, bench(spark, [(None, item), (1, ""), (2, None)]))
    assert kept.columns == frame.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for _, t in EDGES)


def test_empty_tables(spark):
    item = words(3, 20)
    assert dc.leaks(docs(spark, []), bench(spark, [(1, item)])).count() == 0
    assert dc.decontaminate(docs(spark, [(1, item)]), bench(spark, [])).count() == 1


def test_items_that_share_a_passage_have_a_row_each(spark):
    shared = words(3, 50)
    items = [(5, shared), (9, shared), (7, f"{words(4, 20)} {shared} {words(5, 20)}"), (8, words(6, 30))]
    inside = " ".join(shared.split()[15:35])
    rows = [(1, f"{words(8, 7)} {shared} {words(9, 5)}"), (2, inside), (3, items[2][1])]
    found = dc.leaks(docs(spark, rows), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(rows, items)
    at = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in found}
    assert len(found) == 9 and at[1, 5] == at[1, 9] == at[1, 7] == (7, 56)
    assert at[2, 9] == (0, 19) and at[3, 7] == (0, 89) and at[3, 9] == (20, 69)
