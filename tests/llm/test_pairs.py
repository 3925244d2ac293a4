"""Similar set pairs, near-duplicate groups and layout copies against brute force."""

import itertools
import random

import pytest

from wordloom.llm import near_duplicates, set_pairs
from wordloom.llm.layout_copies import layout_copies
from wordloom.llm.near_duplicates import near_duplicate_groups
from wordloom.llm.set_pairs import similar_members, similar_pairs

PAIRS = "workflow_id string, prompt_shingles array<string>, tool_shingles array<string>, node bigint, bucket string, first int, a int, key int"
PAGES = "id string, title string, content string, tags array<string>, node bigint, bucket string, grams string, part int, key int, form string"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], PAIRS)
    return sorted(map(tuple, similar_pairs(df, "workflow_id", "prompt_shingles", "tool_shingles").collect()))


def brute_pairs(rows):
    sets = {}
    for k, p, t in rows:
        p, t = ({x for x in (s or []) if x is not None} for s in (p, t))
        if k is not None and p and t:
            sets[k] = (p, t)
    out = []
    for x, y in itertools.combinations(sorted(sets), 2):
        (n1, d1), (n2, d2) = ((len(sets[x][s] & sets[y][s]), len(sets[x][s] | sets[y][s])) for s in (0, 1))
        if 5 * (n1 * d2 + n2 * d1) >= 6 * d1 * d2:
            out.append((x, y))
    return out


def workflow_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            _, p, t = rng.choice(rows)
            p, t = list(p), list(t)
            for s in (p, t):
                for _ in range(rng.randint(0, max(1, len(s) // 3))):
                    s[rng.randrange(len(s))] = f"n{rng.random()}"
        else:
            p, t = ([f"{c}{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30))] for c in "pt")
        rows.append((f"w{k:04}", p, t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    rows = workflow_rows(seed)
    assert pairs(spark, rows) == brute_pairs(rows)


def test_pairs_edges(spark):
    rows = [
        ("a", ["1", None, "1", "2"], ["x"]), ("b", ["2", "1"], ["x", "x"]), ("b", ["2", "1"], ["x"]), ("c", None, ["x"]),
        ("d", [], ["x"]), ("e", [None], ["x"]), (None, ["1", "2"], ["x"]), ("f", ["1", "2", "3", "4", "5"], ["x"]),
        ("g", ["9"], ["y"]), ("h", ["1"], ["2", "x"]),
    ]
    # f shares 2 of 5 prompts with a and b: (2/5 + 1) / 2 = 0.7
    assert pairs(spark, rows) == [("a", "b"), ("a", "f"), ("b", "f")] == brute_pairs(rows)
    assert pairs(spark, []) == []


def test_pairs_on_the_threshold(spark):
    rows = [("a", ["1"], ["x", "y", "z", "u", "v"]), ("b", ["1"], ["x", "p", "q", "r", "s"])]
    assert pairs(spark, rows) == brute_pairs(rows)  # (1 + 1/9) / 2 is below
    rows = [("a", ["1"], ["x", "y", "z"]), ("b", ["1"], ["x", "p", "q"])]
    assert pairs(spark, rows) == [("a", "b")]  # (1 + 1/5) / 2 is 0.6


def test_hot_copies(spark):
    rows = [(f"h{k:03}", ["1", "2"], ["x"]) for k in range(60)] + workflow_rows(3, 60)
    assert pairs(spark, rows) == brute_pairs(rows)


def test_blocks_of_a_hot_class(spark, monkeypatch):
    """A class larger than a block: its pairs are listed block by block, and counted without being listed."""
    rows = [(f"h{k:03}", ["1", "2"], ["x"]) for k in range(90)] + [(f"i{k:03}", ["1", "2", "3"], ["x"]) for k in range(40)] + workflow_rows(5, 50)
    monkeypatch.setattr(set_pairs, "blocks", lambda members, size=7, made=set_pairs.blocks: made(members, size))
    want = brute_pairs(rows)
    assert pairs(spark, rows) == want
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in [*rows, ("h000", ["2", "1"], ["x"]), (None, ["1"], ["x"]), ("z", None, ["x"])]], PAIRS)
    got = {r.workflow_id: (r.class_id, r.links) for r in similar_members(df, "workflow_id", "prompt_shingles", "tool_shingles").collect()}
    sets = {k: (frozenset(p), frozenset(t)) for k, p, t in rows}
    assert got == {k: (min(j for j in sets if sets[j] == sets[k]), sum(k in p for p in want)) for k in sets}


def test_block_tasks_are_bounded(spark):
    """20,000 equal records: no group of the join that lists their pairs has more than two blocks of members."""
    from pyspark.sql import functions as F

    members = spark.range(20_000).select(F.lit(1).cast("bigint").alias("node"), F.col("id").cast("string").alias("key"))
    placed = set_pairs.blocks(members)
    assert placed.groupBy("block").count().agg(F.max("count")).head()[0] < 1.2 * set_pairs.MEMBERS
    assert placed.select("parts").distinct().collect() == [(10,)]


def groups(spark, rows, size=3, share=0.6):
    df = spark.createDataFrame([(*r, None, 1, "x", "y", 2, 3, "z") for r in rows], PAGES)
    return {r.id: r.group_id for r in near_duplicate_groups(df, "id", "title", "content", size, share).collect()}


def brute_groups(rows, size=3, share=0.6):
    import re

    grams = {}
    for k, title, content in rows:
        if k is None or not re.search(r"[^\W_]", content or ""):
            continue
        words = re.findall(r"[^\W_]+", f"{title or ''}\n{content or ''}".lower())
        grams[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    link = {k: set() for k in grams}
    for x, y in itertools.combinations(grams, 2):
        if (u := len(grams[x] | grams[y])) and len(grams[x] & grams[y]) / u >= share:
            link[x].add(y)
            link[y].add(x)
    out = {}
    for k in grams:
        if link[k]:
            seen, todo = {k}, [k]
            while todo:
                for n in link[todo.pop()] - seen:
                    seen.add(n)
                    todo.append(n)
            out[k] = min(seen)
    return out


def page_rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    passage = " ".join(rng.choices(words, k=25))
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            _, title, content = rng.choice(rows)
            parts = content.split(" ")
            for _ in range(rng.randint(0, 6)):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(words))
            content = " ".join(parts)
        else:
            title, content = rng.choice(words), " ".join(rng.choices(words, k=rng.randint(3, 120)))
            if rng.random() < 0.4:
                content = f"{content} {passage}"
        rows.append((f"e{k:04}", title, content))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = page_rows(seed)
    assert groups(spark, rows) == brute_groups(rows)


def test_groups_defaults(spark):
    rows = page_rows(5, 90)
    assert groups(spark, rows, 5, 0.8) == brute_groups(rows, 5, 0.8)


def test_groups_edges(spark):
    long = "alpha beta gamma delta " * 3000 + "end"
    rows = [
        ("a", None, "one two three"), ("b", "", "ONE, two; three!"), ("b", "", "ONE, two; three!"), ("c", "one two three", None),
        ("d", "one two three", " \n"), (None, None, "one two three"), ("e", "x", "y"), ("f", "x", "y"), ("g", None, long),
        ("h", None, long + " more"), ("i", "one", "two three"), ("j", None, "___"),
    ]
    assert groups(spark, rows) == {"a": "a", "b": "a", "i": "a", "g": "g", "h": "g"} == brute_groups(rows)
    assert groups(spark, []) == {}


def copies(spark, rows):
    df = spark.createDataFrame([(k, "t", c, g, 1, "x", "y", 2, 3, "z") for k, c, g in rows], PAGES)
    return {r.id: r.n_copies for r in layout_copies(df, "id", "content", "tags").collect()}


def test_copies(spark):
    rows = [
        ("a", "---\nB: 2\nA: 1\n---\nHello,  World", ["One Two", "b"]), ("b", " --- \r\na 1\r\n\r\nb: 2\r\n---\r\nhello world!", ["B", "one-two", ""]),
        ("b", " --- \r\na 1\r\n\r\nb: 2\r\n---\r\nhello world!", ["B", "one-two", ""]), ("c", "a 1 b 2 hello world", ["b", "one two"]),
        ("d", "---\na 1\nb 2\nhello world", ["b", "one two"]), ("e", "hello world", None), ("f", "HELLO_world", []), ("g", "Hello\rworld", [None, "", "_"]),
        ("h", None, None), ("i", "---", None), (None, "hello world", None), ("j", "---\n---\nhello world", None), ("k", "---\nb 2\na 1\na 1\n---\nhello world", ["b", "one two"]),
        ("l", "x\n---\na\n---\nhello world", None), ("m", "x\n---\na\n---\nhello  world", None),
    ]
    assert copies(spark, rows) == {"a": 2, "e": 4, "l": 2, "c": 2}
    assert copies(spark, []) == {}


def test_crowded_buckets(spark, monkeypatch):
    """The exact path alone: every bucket counts as crowded."""
    for module in (set_pairs, near_duplicates):
        monkeypatch.setattr(module, "CROWD", 1)
    rows = workflow_rows(7, 120) + [(f"z{k}", ["hot", f"own{k}"], ["hot", f"own{k}"]) for k in range(40)]
    assert pairs(spark, rows) == brute_pairs(rows)
    rows = page_rows(8, 120)
    assert groups(spark, rows) == brute_groups(rows)


def test_chains_of_edits(spark):
    """A group whose ends are unlike: each member is an edit of the one before."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(25):
        words = [*words[:k], f"new{k}", *words[k + 1 :]]
        rows.append((f"c{k:02}", "t", " ".join(words)))
    assert groups(spark, rows) == brute_groups(rows) == {r[0]: "c00" for r in rows}


def test_one_set_shared_by_many(spark, monkeypatch):
    """Equal tool sets beside unlike prompts with one common value: what isn't similar doesn't meet."""
    monkeypatch.setattr(set_pairs, "CROWD", 8)
    rng = random.Random(11)
    rows = [(f"h{k:03}", ["hot", *[f"o{k}-{n}" for n in range(rng.choice([3, 4, 9]))]], ["x", "y"]) for k in range(300)]
    rows += [(f"i{k:03}", [*rows[k][1][: 1 + len(rows[k][1]) // 2], f"e{k}"], ["x", "y"]) for k in range(0, 300, 7)]
    rows += [(f"t{k:03}", ["p", "q"], ["hot", *[f"u{k}-{n}" for n in range(9)]]) for k in range(100)] + workflow_rows(12, 60)
    assert pairs(spark, rows) == brute_pairs(rows)
    df = spark.createDataFrame(rows, "k string, p array<string>, t array<string>")
    classes, _ = set_pairs.set_classes(df, "k", "p", "t")
    assert set_pairs.candidates(classes).count() < 3_000


def test_large_groups_that_share_a_passage(spark, monkeypatch):
    """Two groups of edited copies, unlinked, whose pages share a passage: they aren't compared member by member."""
    monkeypatch.setattr(near_duplicates, "CROWD", 8)
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(60)]
    seen = []
    linked = near_duplicates.linked
    monkeypatch.setattr(near_duplicates, "linked", lambda pairs, *rest: (seen.append(pairs.count()), linked(pairs, *rest))[1])

    def compared(n):
        rows = []
        for g in "ab":
            page = [*[f"{g}{k}" for k in range(50)], *passage]
            for k in range(n):
                words = list(page)
                words[rng.randrange(110)] = f"new{g}{k}"
                rows.append((f"{g}{k:03}", "t", " ".join(words)))
        seen.clear()
        assert groups(spark, rows) == brute_groups(rows)
        return sum(seen)

    few, many = compared(240), compared(480)
    assert few < 8_000 and many < 2 * few  # 240 x 240 pairs lie between the groups, and four times as many
