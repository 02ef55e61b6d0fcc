import re
from itertools import combinations

import pyarrow as pa
import pytest

from codewarden.llm import near_dup
from tests.llm.helpers import EDGES, docs, words


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute(rows):
    """(set size, least reachable id) of each distinct (id, text)."""
    rows = sorted({(-(2**63) if i is None else i, t) for i, t in rows}, key=str)
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if any_ and 100 * both >= 75 * any_:
                part[a] = part[b] = min(part[a], part[b])
    least = {}
    for p, (i, _) in zip(part, rows):
        least[p] = min(least.get(p, i), i)
    return {(i, t): (len(s), least[p]) for (i, t), s, p in zip(rows, sets, part)}


def near_copies():
    rows = []
    for base in range(6):
        text = words(base, 60 + 20 * base).split()
        for copy in range(5):
            changed = list(text)
            for at in range(copy * 2):
                changed[(at * 13 + copy) % len(changed)] = f"x{copy}"
            rows.append((100 * base + copy, " ".join(changed)))
    return rows + [(900, rows[0][1]), (901, rows[0][1].upper())]


@pytest.mark.parametrize("block", [2, 512])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # a block of two makes every bucket split
    rows = near_copies() + [(950 + n, words(50 + n, 3 + n % 4, 5)) for n in range(12)]
    found = near_dup.near_duplicates(docs(spark, rows)).collect()
    want = brute(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {
        (i, n, c) for (i, _), (n, c) in want.items()
    }


def test_edges(spark):
    found = near_dup.near_duplicates(docs(spark, EDGES, extra=True)).collect()
    assert len(found) == len(EDGES)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.first) for r in found)
    assert got == sorted(
        [
            ("None", 0, "None", True),
            ("None", 1, "None", True),
            ("1", 0, "1", True),
            ("2", 0, "2", True),
            ("3", 0, "3", True),
            ("4", 1, "4", True),
            ("4", 1, "4", True),
        ]
    )


def test_dedupe_keeps_one_row_of_each_group(spark):
    rows = [*near_copies(), (7, "same"), (7, "same"), (8, "same")]
    frame = docs(spark, rows, extra=True)
    kept = near_dup.dedupe(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows).values()})


def test_empty(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_estimate_follows_jaccard():
    near, far = [], []
    for n in range(40):
        text = words(n, 300, 10_000).split()
        other = text[:270] + words(n + 1000, 30, 10_000).split()
        apart = words(n + 2000, 300, 10_000)
        sets, _ = near_dup.shingle_sets(pa.array([" ".join(text), " ".join(other), apart]))
        regs = near_dup.registers(sets)
        size = [[len(s)] for s in sets]
        true = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
        guess, _ = near_dup.estimate(regs[:1], regs[1:2], size[0], size[1])
        near.append(guess[0] - true)
        far.append(near_dup.estimate(regs[:1], regs[2:], size[0], size[2])[0][0])
    assert abs(sum(near) / 40) < 0.03 and max(map(abs, near)) < 0.2
    assert max(far) < 0.05


def test_filled_leaves_no_gap():
    sets, _ = near_dup.shingle_sets(pa.array(["a b c d e", "one", "", words(1, 40)]))
    full = near_dup.filled(near_dup.registers(sets))
    assert (full[[0, 1, 3]] != near_dup.EMPTY).all() and (full[2] == near_dup.EMPTY).all()
