from codewarden.llm import perspectives as ps

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(spark, rows, part=ps.PART):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS speaker", "'x' AS part", "'x' AS said")
    return ps.perspectives(frame, part).collect()


def plain(rows, me, part):
    """Text and learned stretches of each part, message by message."""
    out = {}
    clean = [
        (ps.NO_TURN if t is None else t, (r or "").strip() or "unknown", x or "") for t, r, x in rows
    ]
    for turn, role, text in sorted(set(clean)):
        body, spans = out.setdefault(turn // part, ["", []])
        head = {"system": "<|system|>\n", me: "<|assistant|>\n"}.get(role, f"<|user|>{role}\n")
        begin = len(body) + len(head)
        body += head + text.replace("<|", "< |") + "<|end|>\n"
        if role == me:
            spans.append((begin, len(body) - 1))
        out[turn // part][0] = body
    return out


ROWS = [
    (0, "system", "Be kind."),
    (1, "ana", "Hello, <|assistant|> all"),
    (2, "bo", "Héllo"),
    (3, "cy", ""),
    (4, "ana", None),
    (5, None, "who am I"),
    (6, "bo", "twice"),
    (6, "bo", "twice"),
    (6, "ana", "at once"),
    (None, "cy", "late"),
]


def test_every_speaker_gets_the_dialogue(spark):
    for part in (2, 64):
        got = rendered(spark, [(1, *r) for r in ROWS], part)
        assert {r.speaker for r in got} == {"ana", "bo", "cy", "unknown"}
        for me in ("ana", "bo", "cy", "unknown"):
            mine = {r.part: (r.text, [tuple(s) for s in r.spans]) for r in got if r.speaker == me}
            assert mine == {k: tuple(v) for k, v in plain(ROWS, me, part).items()}
        assert sum(r.rows for r in got if r.speaker == "bo") == len(ROWS)


def test_masks_cover_the_speakers_words(spark):
    (row,) = [r for r in rendered(spark, [(1, 0, "a", "one"), (1, 1, "b", "two")]) if r.speaker == "b"]
    assert row.text == "<|user|>a\none<|end|>\n<|assistant|>\ntwo<|end|>\n"
    assert [row.text[s.start : s.end] for s in row.spans] == ["two<|end|>"]


def test_missing_ids_systems_alone_and_empty(spark):
    rows = [(None, 0, "a", "x"), (None, 1, "b", "y"), (2, 0, "system", "s"), (3, None, None, None)]
    got = rendered(spark, rows)
    assert sorted((str(r.conv_id), r.speaker, r.messages) for r in got) == [
        ("3", "unknown", 1),
        ("None", "a", 2),
        ("None", "b", 2),
    ]
    assert rendered(spark, []) == []


def test_a_long_dialogue_is_many_rows(spark):
    got = rendered(spark, [(1, n, "ab"[n % 2], f"m{n}") for n in range(1000)])
    assert max(r.messages for r in got) <= ps.PART and len(got) == 2 * 16
    whole = "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.speaker == "a")
    assert [f"m{n}" for n in range(1000)] == [x for x in whole.replace("<|end|>", "").split("\n") if x.startswith("m")]


def test_negative_turns_are_parts_of_their_own_in_sql_too(spark):
    import duckdb

    rows = [(1, t, r, f"t{t}") for t in (-130, -65, -64, -1, 0, 63, 64, None) for r in ("ann", "bob")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.speaker, r.part, r.messages) for r in ps.perspectives(frame).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT speaker, part, messages FROM ({ps.PERSPECTIVES_SQL})").fetchall()
    assert got == set(found) and {p for _, p, _ in got} >= {-3, -2, -1, 0, 1}
