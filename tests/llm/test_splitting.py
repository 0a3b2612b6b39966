import random

import numpy as np
import pytest

from skerry.llm import splitting as sp


def pieces_by_hand(content, limit=4000, overlap=3, back=20):
    """The rule read line by line on the text itself."""
    lines = content.split("\n")
    out, new, carry = [], 0, []
    size = lambda ks: sum(len(lines[k]) for k in ks) + len(ks) - 1
    while new < len(lines):
        if len(lines[new]) > limit:
            out += [(new, new)] * -(-len(lines[new]) // limit)
            new, carry = new + 1, []
            continue
        ks = list(carry)
        while ks and size([*ks, new]) > limit:
            ks.pop(0)
        first_new = new
        while new < len(lines) and size([*ks, new]) <= limit:
            ks.append(new)
            new += 1
        if new < len(lines) and len(lines[new]) <= limit:
            blanks = [k for k in ks[-back:] if k >= first_new and not lines[k].strip()]
            if blanks:
                ks = [k for k in ks if k <= blanks[-1]]
                new = blanks[-1] + 1
        out.append((ks[0], ks[-1]))
        carry = ks[-overlap:]
    return out


def random_text(rng, limit):
    parts = []
    for _ in range(rng.randrange(1, 120)):
        r = rng.random()
        if r < 0.2:
            parts.append(rng.choice(["", " ", "\t", "\u3000", "\u00a0 "]))
        elif r < 0.24:
            parts.append("é" * rng.randrange(limit, 3 * limit))
        elif r < 0.3:
            parts.append("x" * limit)
        else:
            parts.append("".join(rng.choice("ab é😀") for _ in range(rng.randrange(1, limit // 3))))
    return "\n".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_cut_follows_the_rule(seed):
    rng = random.Random(seed)
    limit = rng.choice([20, 50, 200])
    text = random_text(rng, limit)
    lines = text.split("\n")
    got = sp.cut(np.array([len(x) for x in lines]), np.array([not x.strip() for x in lines]), limit)
    assert [(a, b) for a, b, _, _ in got] == pieces_by_hand(text, limit)
    for a, b, at, n in got:
        piece = text[at : at + n]
        assert len(piece) == n <= limit
        assert piece == "\n".join(lines[a : b + 1]) or len(lines[a]) > limit
    seen = set()
    for _, _, at, n in got:
        seen.update(range(at, at + n))
    assert all(text[i] == "\n" for i in range(len(text)) if i not in seen)


@pytest.mark.parametrize("seed", range(20))
def test_ranges_stitch_to_the_whole(seed):
    rng = random.Random(seed)
    text = random_text(rng, 30)
    data = text.encode()
    width = rng.choice([1, 2, 3, 5, 64])
    tables = []
    for at in range(0, max(len(data), 1), width):
        own = min(width, len(data) - at)
        chars, blank = sp.range_table(data[at : at + width + 3], at == 0, own)
        tables.append((chars, blank))
    chars, blank = sp.stitch(tables)
    lines = text.split("\n")
    assert chars.tolist() == [len(x) for x in lines]
    # a blank of several bytes that is cut by a range lies in the range of its first byte
    assert blank.tolist() == [not x.strip() for x in lines]


def test_chunks(spark, monkeypatch):
    rng = random.Random(9)
    texts = {i: random_text(rng, 4000) for i in range(12)}
    rows = [(i, i, 0, 1 + 70 * i, None, t) for i, t in texts.items()]
    rows += rows[:3] + [(99, 1, 0, 1, 2, "short"), (98, 1, 0, 1, 2, None), (97, None, None, None, None, "a\n" * 3000), (None, 1, 0, 1, 1, "b" * 9000), (0, 0, 0, 1, None, "another text under this id\n" * 400)]
    df = spark.createDataFrame(rows, "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string").selectExpr("*", "'clash' as item", "0 as range")
    monkeypatch.setattr(sp, "RANGE", 1000)
    got = [tuple(r)[:4] for r in sp.split_chunks(df).collect()]
    want = []
    for c, _, _, s, _, t in {(r[0], r[3], r[5]): r for r in rows}.values():
        if t is not None and len(t) > 4000:
            want += [(c, k, (s or 1) + a, (s or 1) + b) for k, (a, b) in enumerate(pieces_by_hand(t))]
    assert sorted(got, key=str) == sorted(want, key=str)
    items = {(r[0], r[3], r[5]): r for r in rows}.values()
    texts_wanted = []
    for c, _, _, s, _, t in items:
        if t is not None and len(t) > 4000:
            lines = t.split("\n")
            cuts = sp.cut(np.array([len(x) for x in lines]), np.array([not x.strip() for x in lines]))
            texts_wanted += [(c, k, (s or 1) + a, (s or 1) + b, t[at : at + n]) for k, (a, b, at, n) in enumerate(cuts)]
    for width in (1000, 7, 1 << 20):
        monkeypatch.setattr(sp, "RANGE", width)
        if width == 7:
            some = [r for r in rows if r[0] in (0, 1, 97)]
            small = spark.createDataFrame(some, "chunk_id bigint, file_id bigint, chunk_index int, start_line int, end_line int, content string")
            assert sorted(map(tuple, sp.piece_texts(small).collect()), key=str) == sorted((w for w in texts_wanted if w[0] in (0, 1, 97)), key=str)
        else:
            assert sorted(map(tuple, sp.piece_texts(df).collect()), key=str) == sorted(texts_wanted, key=str)
    assert sp.split_chunks(df.limit(0)).count() == 0
