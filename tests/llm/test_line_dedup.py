import random

from flowprep.llm import line_dedup

from .conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def within_one(a, b):
    """Edit distance of at most one: what is left between the common ends is one character at most."""
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    end = 0
    while end < min(len(a), len(b)) - at and a[-1 - end] == b[-1 - end]:
        end += 1
    return max(len(a), len(b)) - at - end <= 1


def test_within_one():
    rng = random.Random(7)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        assert within_one(a, b) == (distance(a, b) <= 1)


def brute(rows, min_fuzzy=line_dedup.MIN_FUZZY):
    """Texts after dedup, by comparing every line with every earlier one."""
    places, out = {}, {}
    for doc, text in sorted(rows):
        for no, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\v\f\r").lower()
            if line:
                places.setdefault(line, (doc, no))
    near = {a for a in places if len(a) >= min_fuzzy and any(
        places[b] < places[a] and len(b) >= min_fuzzy and abs(len(a) - len(b)) < 2 and within_one(a, b) for b in places)}
    for doc, text in rows:
        kept, had = [], 0
        for no, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\v\f\r").lower()
            had += bool(line)
            if not line or (places[line] == (doc, no) and line not in near):
                kept.append(raw)
        out[doc] = "" if had and not any(k.strip(" \t\v\f\r") for k in kept) else "\n".join(kept)
    return out


def edited(rng, line):
    at = rng.randrange(len(line) + 1)
    kind = rng.randrange(4)
    letter = rng.choice("abé ")
    if kind == 0:
        return line[:at] + letter + line[at:]
    if kind == 1:
        return line[:at] + line[at + 1:]
    if kind == 2:
        return line[:at] + letter + line[at + 1:]
    return line[:at] + letter * 2 + line[at:]


def test_matches_brute_force(spark, make):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([1, 3, 19, 20, 21, 31, 32, 33, 34, 63, 64, 65, 66, 150]))) for _ in range(60)]
    rows = []
    for doc in range(120):
        lines = [rng.choice(base) for _ in range(rng.randrange(5))]
        lines = [edited(rng, x) if rng.random() < 0.6 else x for x in lines]
        rows.append((doc, "\n".join(lines)))
    got = dict(tuple(r) for r in line_dedup.dedup_lines(make(rows)).select("doc_id", "text").collect())
    assert got == brute(rows, line_dedup.MIN_FUZZY)


def test_full_bitmap_loses_nothing(spark, make):
    rows = [(i, f"the very same sentence, number {i:03d}, of many") for i in range(40)]
    places = line_dedup.line_places(make(rows), bitmap_bits=6).collect()
    want = {d for d, text in brute(rows, 20).items() if not text}
    assert {r.doc for r in places if r.near} == want and len(want) > 20


def test_odd_rows(spark, make, clashing):
    out = line_dedup.dedup_lines(clashing(make(ODD)), counts=True)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r["__n_lines"]) for r in out.collect())
    assert len(rows) == len(ODD)
    by = {(a, b): (t, x, n) for a, b, t, x, n in rows}
    assert by[True, 1] == (False, "", 0) and by[True, 2] == (True, "", 0) and by[True, 3] == (True, "  \t\n \n", 0)
    assert by[True, 4] == (True, "one", 1) and by[True, 5] == (True, "", 1)  # "One" equals an earlier line
    kept = line_dedup.dedup_lines(make(ODD), drop_emptied=True)
    assert 5 not in {r.doc_id for r in kept.collect()} and kept.columns == make(ODD).columns
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_very_long_line(spark, make):
    line = "xy" * 60_000
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make([(1, line), (2, line[:-1]), (3, line + "yy")])).collect()}
    assert got == {1: line, 2: "", 3: line + "yy"}
