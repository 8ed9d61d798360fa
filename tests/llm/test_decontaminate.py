import random

from treegrammar.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id long, distance int, end string"
ITEMS = "item_id long, text string, doc_id long"


def least(pattern, text):
    """Least edits of pattern against any substring of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def least_bounded(pattern, text):
    """The same among substrings that begin and end at word bounds, each compared in full."""
    best = len(pattern)
    at = [i for i in range(len(text) + 1) if dc.bound(text, i)]
    for a in at:
        row = list(range(len(pattern) + 1))
        for j, t in enumerate(text[a : a + 2 * len(pattern)], a + 1):
            new = [row[0] + 1]
            for i, p in enumerate(pattern):
                new.append(min(row[i] + (p != t), row[i + 1] + 1, new[-1] + 1))
            row = new
            if dc.bound(text, j):
                best = min(best, row[-1])
    return best


def edited(rnd, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rnd.randrange(len(t))
        kind = rnd.randrange(3)
        if kind == 0:
            t[i] = rnd.choice("qxz")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, rnd.choice("qxz"))
    return "".join(t)


def test_myers():
    rnd = random.Random(4)
    for _ in range(300):
        p = "".join(rnd.choice("ab c") for _ in range(rnd.randrange(1, 90)))
        t = "".join(rnd.choice("ab c") for _ in range(rnd.randrange(0, 60)))
        assert dc.Myers(p).least(t)[0] == least(p, t)


def test_pieces_leave_one_whole():
    for k in range(12):
        parts = dc.pieces("x" * 100, k)
        assert len(parts) == k + 1 and sum(len(p) for _, p in parts) == 100 and parts[0][0] == 0


def test_every_item_within_its_budget_is_found(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(8, 40))), 0) for i in range(25)] + [(30, "too short", 0), (31, None, 0), (32, "", 0)]
    items += [(3, items[3][1], 0), (40, items[3][1].upper(), 0)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rnd.randrange(0, 60))]
        if d % 2:
            t = items[d % 25][1]
            body.insert(rnd.randrange(len(body) + 1), edited(rnd, t, rnd.randrange(0, int(len(t) * 0.12) + 1)).replace(" ", rnd.choice([" ", "\n", "  "])))
        docs.append((d, " ".join(body), 0, 0, "e"))
    docs += [(200, None, 0, 0, "e"), (201, "", 0, 0, "e"), (None, items[5][1], 0, 0, "e"), (202, "a " * 40_000 + items[6][1] + " b" * 40_000, 0, 0, "e")]
    want = []
    for d, text, *_ in docs:
        if d == 202:
            want.append((202, 6, 0))
            continue
        for i, t in {(i, dc.normal(t)) for i, t, _ in items if t}:
            k = least(t, dc.normal(text)) if len(t.split()) >= dc.MIN_WORDS else least_bounded(t, dc.normal(text))
            if k <= dc.budget(t, dc.BUDGET):
                want.append((d, i, k))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = [(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 30
    bad = {d for d, *_ in want}
    assert {r.doc_id for r in dc.clean(df, bench).collect()} == {d[0] for d in docs} - bad
    assert dc.contaminated(df, bench.limit(0)).collect() == [] == dc.contaminated(df.limit(0), bench).collect()
    dc.BLOCK_CHARS, kept = 500, dc.BLOCK_CHARS
    again = [(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(df, bench).collect()]
    assert {r.doc_id for r in dc.clean(df, bench).collect()} == {d[0] for d in docs} - bad
    dc.BLOCK_CHARS = kept
    assert sorted(again, key=str) == sorted(got, key=str) and sorted(set(again), key=str) == sorted(set(got), key=str)


def test_short_items_begin_and_end_at_word_bounds(spark):
    items = [(1, "Who wrote  Hamlet?", 0), (2, "two", 0), (3, "art of war", 0), (4, "", 0), (5, "what is the capital of sweden now", 0)]
    docs = [(1, "q: who wrote\nhamlet? a: ...", 0, 0, "e"), (2, "who wrote hamlet", 0, 0, "e"), (3, "network twork", 0, 0, "e"), (4, "network, (TWO) of", 0, 0, "e"), (5, "smart of war, then art of warm", 0, 0, "e"), (6, "start of war; the art of war.", 0, 0, "e"), (7, None, 0, 0, "e")]
    docs += [(8, "so what is the capitall of swedn now?", 0, 0, "e"), (9, "somewhat is the capital of sweden nowhere", 0, 0, "e"), (10, "What was the capital of sweden now", 0, 0, "e")]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in dc.contaminated(df, bench).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (4, 2, 0), (6, 3, 0), (8, 5, 2), (10, 5, 2)]
    assert sorted(r.doc_id for r in dc.clean(df, bench).collect()) == [3, 5, 7, 9]


def test_items_of_one_to_twelve_words_against_brute_force(monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abe") for _ in range(rnd.randrange(1, 7)))
    items = [(n * 10 + k, " ".join(word() for _ in range(n))) for n in range(1, 13) for k in range(4)]
    matcher, hits = dc.Matcher(items, dc.BUDGET), 0
    for _ in range(120):
        t = rnd.choice(items)[1]
        body = [word() for _ in range(rnd.randrange(0, 12))] + [edited(rnd, t, rnd.randrange(0, dc.budget(t, dc.BUDGET) + 2))]
        text = dc.normal((" " if rnd.random() < 0.8 else "").join(body))
        want = [(i, (least if t.count(" ") >= 7 else least_bounded)(t, text)) for i, t in items]
        want = [(i, d) for (i, d), (_, t) in zip(want, items) if d <= dc.budget(t, dc.BUDGET)]
        assert [(i, d) for i, d, _ in matcher.search(text)] == want
        hits += len(want)
    assert hits > 100


def test_more_blocks_than_a_task_keeps(spark, monkeypatch):
    for name, value in (("BLOCK_CHARS", 40), ("SLICE", 1000), ("MATCHERS", 2)):
        monkeypatch.setattr(dc, name, value)
    items = [(i, f"item number {i} of a long list of {i} benchmark items", 0) for i in range(30)]
    docs = [(i, f"text {i} with item number {i % 40} of a long list of {i % 40} benchmark items in it", 0, 0, "e") for i in range(200)]
    df, bench = spark.createDataFrame(docs, SCHEMA).coalesce(1), spark.createDataFrame(items, ITEMS)
    matcher = dc.Matcher([(i, dc.normal(t)) for i, t, _ in items], dc.BUDGET)
    want = sorted((d, i, k) for d, t, *_ in docs for i, k, _ in matcher.search(t))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in dc.contaminated(df, bench).collect()) == want
    assert {r.doc_id for r in dc.clean(df, bench).collect()} == {d[0] for d in docs} - {d for d, *_ in want}
