"""Perspective rotation against a plain loop, on long dialogues and odd rows."""

from attestlake.llm import chat


def plain(rows):
    """(conv, speaker): (turns, text, spans)."""
    rows = [(c, t, "unknown" if s is None else s, x or "") for c, t, s, x in rows]
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for me in {s for _, s, _ in mine} - {"system"}:
            text, spans = "", []
            for _, s, x in mine:
                text += "<|system|>\n" if s == "system" else "<|assistant|>\n" if s == me else f"<|user name={s}|>\n"
                if s == me:
                    spans.append((len(text), len(text) + len(x)))
                text += x + "\n<|end|>\n"
            out[c, me] = (len(mine), text, spans)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, who string")
    want = plain(rows)
    got = chat.rotate(df).collect()
    assert len(got) == len(want)
    for r in got:
        n, text, spans = want[r.conv_id, r.speaker]
        assert (r.n_turns, r.n_own, r.text, [tuple(s) for s in r.spans]) == (n, len(spans), text, spans)
        assert all(text[a:b] in {x or "" for c, _, s, x in rows if c == r.conv_id} for a, b in spans)
    pieces = {}
    for r in sorted(chat.rotated_turns(df).collect(), key=lambda r: r.position):
        text, spans = pieces.setdefault((r.conv_id, r.speaker), ([], []))
        text.append(r.text)
        if r.start is not None:
            spans.append((r.start, r.end))
    assert {k: ("".join(t), s) for k, (t, s) in pieces.items()} == {k: v[1:] for k, v in want.items()}


def test_long_dialogue_is_one_rendering(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("ann", "bob", "zoë")[i % 3], f"word {i} é") for i in range(1, 600)]
    check(spark, rows)


def test_nulls_ties_repeats_and_narrators_only(spark):
    check(spark, [
        (None, 1, "a", "no conversation"), (None, None, "b", None), (1, None, "a", "first"), (1, 2, None, "who"), (1, 2, "a", ""), (1, 2, "a", ""), (1, 2, "b", "tie"),
        (1, 3, "system", "late"), (2, 1, "system", "alone"), (3, 1, "a", "x" * 70_000), (3, 1, "a", "\U0001f600" * 3),
    ])


def test_empty(spark):
    check(spark, [])
