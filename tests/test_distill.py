"""Segments folded with a state, rollback, reversible redaction and matching, against plain programs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engramlake.functions import privacy
from engramlake.operators import distill, similar, undo


def stand_in():
    def model(text, carry):  # not of the module, so that tasks get it by value
        words = text.split()
        signals = [{"type": "t", "topic": w, "what": f"{w}{carry}"} for w in words if w.isalpha()]
        return {"summary": str(len(words)), "signals": signals, "overturned": [{"topic": w[1:]} for w in words if w[0] == "-"], "carry": f"{carry[-5:]}{words[0] if words else ''}"}

    return model


def test_a_fold_hands_its_state_on_and_a_reduction_drops_what_was_overturned(spark):
    r, model = random.Random(3), stand_in()
    lines = [(s, g, m, r.choice(["a", "B", "c -a", "b d", "-B e", None, "f"])) for s in ("x", "y", None) for g in range(r.randrange(40, 60)) for m in range(3)]
    got = distill.folded(spark.createDataFrame(lines, "session string, segment int, msg int, line string").repartition(5), model).collect()
    by = defaultdict(lambda: defaultdict(list))
    for s, g, _, line in sorted(lines, key=lambda x: (x[0] or "", x[1], x[2], x[3] is not None, x[3] or "")):
        by[s][g].append(line)
    want, said, turned = {}, {}, set()
    for s, segments in by.items():
        carry = ""
        for g, part in segments.items():
            out = model("\n".join(x for x in part if x is not None), carry)
            carry = out["carry"]
            want[s, g] = (out["summary"], [tuple(x.values()) for x in out["signals"]], [x["topic"] for x in out["overturned"]], carry)
            said |= {(s, "t", x["topic"].lower()): (x["topic"], x["what"], g) for x in out["signals"]}
            turned |= {(s, x["topic"].lower()) for x in out["overturned"]}
    assert {(x.session, x.segment): (x.summary, [tuple(y) for y in x.signals], [y.topic for y in x.overturned], x.carry) for x in got} == want
    frame = spark.createDataFrame(got, "session string, segment long, summary string, signals array<struct<type:string,topic:string,what:string>>, overturned array<struct<topic:string,reason:string>>, carry string")
    left = {(x.session, x.type, x.topic, x.what, x.segment) for x in distill.reduced(frame, F.lower).collect()}
    assert left == {(s, t, *v) for (s, t, k), v in said.items() if (s, k) not in turned}
    assert distill.folded(spark.createDataFrame([], "session string, segment int, msg int, line string"), stand_in()).count() == 0


def test_attempts_are_undone_from_the_last(spark):
    r = random.Random(5)
    for _ in range(2):
        contribs = [(k, r.randrange(12), f"p{r.randrange(8)}" if r.random() < 0.9 else None, r.random() < 0.7) for k in range(40)]
        journal = [(k, r.randrange(12), f"r{r.randrange(6)}", r.choice([None, f"v{k}"])) for k in range(60)]
        wanted = set(r.sample(range(13), 7))
        pages = defaultdict(set)
        for _, a, p, _ in contribs:
            pages[a] |= {p} - {None}
        gone = set()
        for a in sorted(wanted, reverse=True):  # one after the other, the last first
            if not any(x > a and act and x not in gone and p in pages[a] for _, x, p, act in contribs):
                gone.add(a)
        rows = {}
        for row in {j[2] for j in journal if j[1] in gone}:
            mine, value, undone, blocked, refused = [j for j in journal if j[2] == row], None, 0, False, 0
            for _, a, _, before in sorted(mine, reverse=True):
                blocked |= a not in gone
                if not blocked:
                    value, undone = before, undone + 1
                elif a in gone:
                    refused += 1
            rows[row] = (value, undone, refused)
        frame = spark.createDataFrame(contribs, "contribution_id int, attempt int, page string, active boolean")
        got = undo.rolled_back(frame, spark.createDataFrame(journal, "seq int, attempt int, row string, before string"), spark.createDataFrame([(a,) for a in wanted], "attempt int"))
        assert {(x.attempt, x.status, x.deactivated) for x in got["attempts"].collect()} == {
            (a, "undone" if a in gone else "refused", sum(x == a and act for _, x, _, act in contribs) if a in gone else 0) for a in wanted
        }
        assert {x.row: (x.value, x.undone, x.refused) for x in got["rows"].collect()} == rows
        touched = {p for _, a, p, _ in contribs if a in gone and p}
        left = {p: sum(q == p and act and a not in gone for _, a, q, act in contribs) for p in touched}
        assert {(x.page, x.active, x.orphaned) for x in got["pages"].collect()} == {(p, n, n == 0) for p, n in left.items()}


def test_redaction_is_undone_exactly(spark):
    r = random.Random(1)
    pieces = ["13912345678", "1391234567812345678", "6222020200112233445", "10.0.0.1", "The", "phone", " ", "x", "[REDACTED_PHONE]", "é\n", "😀", "\\", "12345678901234567X", "."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(80)] + [None, "", "13912345678 " * 700]
    blocked = ("phone", "the", "x")
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("*", privacy.redacted(F.col("text"), "body", blocked).alias("r"))
    rows = d.select("text", "r", privacy.restored(F.col("r.text"), F.col("r.records"), len(privacy.patterns(blocked))).alias("back")).collect()
    for row in rows:
        assert row.back == row.text
        now, records = row.text, []
        for k, (kind, pattern, mark) in enumerate(privacy.patterns(blocked)):
            found = list(re.finditer(pattern.replace(privacy.EDGE, r"\b").replace("(?iu)", "(?i)"), now or "", re.A))
            shift = 0
            for m in found:
                records.append((k, "body", kind, m[0], mark, m.start(), m.start() + shift))
                shift += len(mark) - len(m[0])
            now = now and re.sub(pattern.replace(privacy.EDGE, r"\b").replace("(?iu)", "(?i)"), lambda _: mark, now, flags=re.A)  # noqa: B023
        assert row.r.text == now and [tuple(x) for x in row.r.records] == records


def grams(x):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", x.lower()) for i in range(len(w) + 1)}


def alike(a, b, threshold):
    x, y = grams(a), grams(b)
    return a == b or bool(x | y) and len(x & y) / len(x | y) >= threshold


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_matches_equal_taking_the_first_one_left(spark, threshold):
    r = random.Random(int(threshold * 100))
    words = ["ship the release", "ship the releases", "ship a release", "hire an editor", "hire editor", "hire the editor now", "写 报告", "", "same same"]
    out = [(f"s{r.randrange(2)}", r.choice("ab"), k, r.choice(words)) for k in r.sample(range(1000), 120)] + [("s", "hot", 2000 + k, "hot text") for k in range(300)]
    gold = [(f"s{r.randrange(2)}", r.choice("ab"), k, r.choice(words)) for k in r.sample(range(1000), 120)] + [("s", "hot", 2000 + k, "hot text") for k in range(280)]
    kind = "session string, type string, id int, text string"
    got = similar.matched(spark.createDataFrame(out, kind), spark.createDataFrame(gold, kind), ["session", "type"], threshold)
    left, want = sorted(gold, key=lambda x: x[2]), set()
    for s, t, k, text in sorted(out, key=lambda x: x[2]):
        at = next((i for i, g in enumerate(left) if g[:2] == (s, t) and alike(text, g[3], threshold)), None)
        want.add((k, None if at is None else left.pop(at)[2], "extra" if at is None else "matched"))
    want |= {(None, g[2], "missed") for g in left}
    assert Counter(map(tuple, got.select("output_id", "golden_id", "kind").collect())) == Counter(want)
