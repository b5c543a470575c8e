"""Merkle manifests, repair of conversations and license scans against plain programs, and their defined edge results."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engramlake.llm import licenses, merkle, ordering, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\v\f\r"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nulls_first(v, nothing):
    return v is not None, nothing if v is None else v


# the order of tables


def test_positions_count_inside_groups_whatever_the_ties(spark):
    rows = [(k % 3 if k % 7 else None, k // 9, 0) for k in range(200)] + [(1, 4, 0)] * 150
    d = spark.createDataFrame(rows, "g long, k long, at long").repartition(5).drop("at")
    got = ordering.positions(ordering.in_order(d, "test", "g", "k"), "g").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.pos, r.k, r.n))
    for g, held in by.items():
        held.sort()
        assert [p for p, _, _ in held] == list(range(len(held))) and {n for _, _, n in held} == {len(held)}
        assert [k for _, k, _ in held] == sorted(k for x, k, _ in rows if x == g)
    assert len(got) == len(rows)


# 11


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            first = i // 3 * 3
            out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
            i //= 3
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((nulls_first(r[0], 0), leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: nulls_first(s and s.encode(), b"") if s is not None else (False, b""))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, node, r) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            steps, text = path(trees[s], i) + path(over, k), r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for a, b in steps:
                at = h(a + at + b)
            root = over[-1][0]
            out.append((r[0], node, trees[s][-1][0], root, h("".join(a + b for a, b in steps)), at, at == root))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_equals_a_plain_program(spark, height):
    r = random.Random(height)
    rows = [(k, f"text {k}\nmore" if k % 4 else None, "en" if k % 5 else None, f"s{r.randrange(4)}" if k % 6 else "hot", k) for k in range(240)]
    rows += [(None, "a\nb", "en", None, None), (7, "", "en", "hot", 0), (1000, "x" * 300_000 + "\n", "é", "é|z", 5)] + [(7, "again\n", "en", "hot", 1)] * 30
    d = spark.createDataFrame(rows, DOCS).select("*", F.lit("x").alias("node"), F.lit(3).alias("tree"), F.lit(1).alias("pos"), F.lit(0).alias("at")).repartition(3)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    got = merkle.audit(d, tampered, F.replace(F.col("text"), F.lit("\n"), F.lit("")), height)
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)
    assert merkle.audit(d.limit(0), tampered, F.col("text")).count() == 0


def test_paths_of_blocks_of_every_size():
    for n in range(1, 90):
        nodes = [h(str(k)) for k in range(n)]
        height = merkle.levels(n)
        root = merkle.top(nodes, height)
        steps = [[*p] for p in merkle.traverse(nodes, height)]
        assert len(steps) == n
        for node, path in zip(nodes, steps):
            for a, b in path:
                node = h(a + node + b)
            assert node == root


def test_a_treehash_stack_holds_two_nodes_a_level():
    work = merkle.Treehash(6)
    for k in range(3**6):
        work.push(h(str(k)))
        assert all(len(x) < 3 for x in work.stack[:6]) and len(work.stack) == 7


# 12


def plain_repair(rows):
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    said = lambda v: " " if v is None else str(v)
    by = defaultdict(list)
    for c, t, role, text in rows:
        held, lot = by[c], zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if lot == 1 else "".join(x for x in text if x not in ".!?") if lot == 2 else text
        held += [] if lot == 0 else [(t, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda x: (nulls_first(x[0], 0), x[1].encode(), x[2].encode()))
        numbers = [t for t, _, _ in turns if t is not None]
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]

        def put(ways, state, way):
            if state not in ways or way[:2] < ways[state][:2]:
                ways[state] = way

        def inserted(ways):
            for _ in range(4):
                for role in ("user", "assistant"):
                    for i, j in step[role[0]].items():
                        if i in ways:
                            put(ways, j, (ways[i][0] + 3, ways[i][1] + "I", [*ways[i][2], (role, "")]))
            return ways

        ways = inserted({0: (0, "", [])})
        for (_, role, text), fault in zip(turns, faults):
            now = {}
            for i, (cost, audit, done) in ways.items():
                put(now, i, (cost + 4, audit + "D", done))
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault == "truncated" else 0
                if i in step.get(role[:1], {}):
                    put(now, step[role[:1]][i], (cost + more, audit + "K", [*done, (role, text)]))
                for other in ("user", "assistant"):
                    if i in step[other[0]]:
                        put(now, step[other[0]][i], (cost + more + 3, audit + "R", [*done, (other, text)]))
            ways = inserted(now)
        cost, audit, done = min((ways[k] for k in (0, 3) if k in ways), key=lambda w: w[:2])
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, h("\n".join(f"{r}:{t}" for r, t in done))))
    return Counter(out)


def turns(seed, conversations, most):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "u", "", None], ["Yes.", "No", "", " \n", None, "Why?", "well", "ok. \t"]
    for c in range(conversations):
        for k in range(r.randrange(1, most)):
            yield c, k if r.random() < 0.9 else None if r.random() < 0.3 else k - 1, r.choices(roles, [9, 9, 2, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.4 else f"{r.random()}."


@pytest.mark.parametrize("run,fan", [(4, 2), (256, 64)])
def test_repair_equals_a_plain_program(spark, monkeypatch, run, fan):
    monkeypatch.setattr(repair, "RUN", run)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = [*turns(run, 60, 12), *[(99, *x[1:]) for x in turns(5, 1, 400) for _ in (0, 1)], *[(None, *x[1:]) for x in turns(8, 3, 40)], *[(77, 3, "user", "same.")] * 300]
    rows += [(500, k, "user", "x" * 200_000 + ".") for k in range(3)]
    d = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("at"), F.lit("x").alias("run"), F.lit(None).cast("int").alias("audit")).repartition(3)
    got = repair.report(d)
    assert Counter(map(tuple, got.collect())) == plain_repair(rows)
    assert repair.report(d.limit(0)).count() == 0


def test_conversations_without_turns_have_an_empty_result(spark):
    lost = [(c, t) for c in range(50) for t in range(10) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    d = spark.createDataFrame([(c, t, "user", "gone.") for c, t in lost], TURNS)
    assert {tuple(r)[1:] for r in repair.report(d).collect()} == {(0, 0, 0, 0, 0, 0, "", h(""))}


def test_products_are_associative_and_the_closure_is_idempotent():
    r = random.Random(4)
    assert repair.times(repair.CLOSURE, repair.CLOSURE) == repair.CLOSURE
    kinds = [(r.choice(["s", "u", "a", ""]), r.random() < 0.2, r.random() < 0.3) for _ in range(60)]
    whole = repair.product(kinds)
    for k in (1, 7, 30, 59):
        assert repair.times(repair.product(kinds[:k]), repair.product(kinds[k:])) == whole


# 13


def test_license_places_and_labels(spark):
    long = "word " * 60_000
    texts = [
        "Released under the MIT License.", "See: Apache License -- VERSION 2 and cc by/nc; cc by nc nc", None, "", "permission to nobody",
        long + "Under the MIT license\n" + long + "under the mit license", "the mit license", "Licenced under an Apache license, version 2.0 it is",
        "this program is free software you may redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "it may be used under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "under the émit license", "Ünder the MIT License", "license under the mit", "under the mit license under the mit license",
    ]
    d = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)] + [(None, texts[0], "en", None, None)] * 2, DOCS)
    d = d.select("*", F.lit(1).alias("row"), F.lit(2).alias("t"), F.lit("x").alias("label"), F.lit(5).alias("n_words")).repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(d, licenses.notices(spark)).collect())
    n = 60_000
    assert got == Counter({
        (0, 5, 1, 1, 1, "mit", "mit"): 1, (1, 13, 3, 1, 9, "apache-2,cc-by-nc", "apache-2,cc-by-nc"): 1, (2, 0, 0, None, None, "", ""): 1, (3, 0, 0, None, None, "", ""): 1,
        (4, 3, 0, None, None, "", ""): 1, (5, 2 * n + 8, 2, n, 2 * n + 4, "mit", "mit"): 1, (6, 3, 0, None, None, "", ""): 1, (7, 10, 1, 3, 3, "apache-2", "apache-2"): 1,
        (8, 29, 0, None, None, "", "gpl"): 1, (9, 21, 0, None, None, "", "lgpl"): 1, (10, 4, 0, None, None, "", ""): 1, (11, 4, 0, None, None, "", ""): 1, (12, 4, 0, None, None, "", ""): 1,
        (13, 8, 2, 0, 4, "mit", "mit"): 1, (None, 5, 1, 1, 1, "mit", "mit"): 2,
    })
    assert licenses.scan(d.limit(0), licenses.notices(spark)).count() == 0


def test_license_spans_allow_edits_and_both_joins_agree(spark, monkeypatch):
    known = spark.createDataFrame([("x", False, " ".join(f"n{k}" for k in range(40))), ("y", True, "n3 n4 n5")], "label string, exact boolean, text string")
    w = [f"n{k}" for k in range(40)]
    edits = [w, w[:20] + ["new"] + w[20:], w[:10] + w[12:], [x if k % 13 else "z" for k, x in enumerate(w)], w[:30], w[20:] + w[:20], w[:20] + ["z"] * 40 + w[20:]]
    d = spark.createDataFrame([(k, " ".join(["a", *x, "b"]), "en", "a", 1) for k, x in enumerate(edits)], DOCS)
    first = sorted(map(tuple, licenses.scan(d, known).collect()))
    assert [r[6] for r in first] == ["x,y", "x,y", "x,y", "x,y", "y", "y", "y"]
    assert first[0][7] == 1.0 and all(0 <= r[7] <= 1 for r in first)
    monkeypatch.setattr(licenses, "MOST_PLACES", 0)
    assert sorted(map(tuple, licenses.scan(d, known).collect())) == first
    with pytest.raises(Exception, match="3 words or more"):
        licenses.scan(d, known.union(spark.createDataFrame([("z", True, "two words")], known.schema))).collect()
