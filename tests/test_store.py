"""Signals written to a store against a plain program that takes them one after the other."""

import hashlib
import random
import re
from collections import Counter

from engramlake.operators import store

SIGNAL = (
    "seq long, kind string, slug string, title string, detail string, facet string, confidence string, entities array<string>, aliases array<string>, alternatives array<string>, date string, platform string, source_hash string"
)


def slug_of(s):
    def kebab(x):
        k = re.sub("[^a-z0-9]+", "-", x.lower()).strip("-")
        mark = hashlib.sha256(x.encode()).hexdigest()[:12]
        return k if len(k) >= 3 else f"{k}-{mark}" if k else mark

    title = s["title"] or ""
    if s["kind"] == "entity":
        return s["slug"]
    if s["kind"] == "knowledge":
        return f"knowledge/{s['facet']}/{hashlib.sha256(title.encode()).hexdigest()[:12]}"
    return f"{store.FOLDERS[s['kind']]}/{kebab(title)}"


def one_by_one(signals, pages, links, entries):
    pages, links, entries, tags, outcome = {k: dict(v) for k, v in pages.items()}, dict(links), dict(entries), set(), []
    new_links, new_entries, touched = set(), set(), set()
    for s in signals:
        written = skipped = failed = 0
        origin = f"{s['platform']}:{s['source_hash']}" if s["platform"] else s["source_hash"]

        def add_link(src, dst, kind, context):
            if src not in pages or dst not in pages:
                return False
            old = links.get((src, dst, kind), (None, None, None))
            links[src, dst, kind] = (context, s["platform"] or old[1], s["source_hash"])
            new_links.add((src, dst, kind))
            return True

        def add_entry(slug, summary, detail):
            if slug not in pages:
                return False
            entries[slug, s["date"], summary] = (detail, s["platform"] or "", origin)
            new_entries.add((slug, s["date"], summary))
            return True

        if s["kind"] == "timeline":
            for e in s["entities"] or []:
                ok = add_entry(e, s["title"], "")
                written, failed = written + ok, failed + (not ok)
        elif s["kind"] == "link":
            ok = add_link(*s["entities"], s["facet"], s["detail"] or "")
            written, failed = int(ok), int(not ok)
        else:
            slug, forced = slug_of(s), s["kind"] in store.FORCED
            page = pages.get(slug)
            if s["kind"] == "knowledge" and s["confidence"] == "speculative" or page and (page["hash"] == s["source_hash"] or page["edited"] and not forced):
                skipped = 1
            else:
                names = None
                if s["kind"] == "entity" and s["facet"] == "person" and s["aliases"]:
                    names = list(dict.fromkeys([*((page or {}).get("aliases") or []), *s["aliases"]]))
                seen = ((page or {}).get("seen") or origin) if s["kind"] == "entity" else None
                pages[slug] = {"hash": s["source_hash"], "edited": False, "aliases": names, "seen": seen, "title": s["title"], "names": names}
                touched.add(slug)
                tags |= {(slug, s["kind"])} | ({(slug, s["facet"])} if s["kind"] in store.TAGGED else set())
                whole = True
                for e in (s["entities"] or []) if s["kind"] in store.LINKING else []:
                    if whole:
                        whole = add_link(slug, e, "mentions", f"Referenced in {s['kind']}")
                if whole and s["kind"] == "decision":
                    for e in s["entities"] or []:
                        add_entry(e, f"Decision: {s['title']}", s["detail"] or "")
                written, failed = int(whole), int(not whole)
        outcome.append((s["seq"], s["kind"], written, skipped, failed))
    return {
        "pages": {(k, pages[k]["hash"], pages[k]["seen"], pages[k]["title"]) for k in touched}, "tags": tags, "outcome": Counter(outcome),
        "links": {(*k, *links[k]) for k in new_links}, "entries": {(*k, *entries[k]) for k in new_entries}, "names": {k: v["names"] for k, v in pages.items() if k in touched and v["names"]},
    }


def signals(seed, n):
    r = random.Random(seed)
    for k in range(n):
        kind = r.choice(["entity", *store.FOLDERS, "knowledge", "timeline", "link"])
        ends = [f"e{r.randrange(9)}" for _ in range(2 if kind == "link" else r.randrange(4))]
        facet = {"entity": r.choice(["person", "person", "tool"]), "knowledge": f"t{k % 2}", "discovery": "risk", "preference": "style", "task": "done"}.get(kind, "x")
        yield {
            "seq": k, "kind": kind, "slug": f"e{r.randrange(7)}" if kind == "entity" else None, "title": r.choice(["A b", "a-B!", "计划", "X", "Z z"]), "detail": r.choice([None, "", "why"]), "facet": facet,
            "confidence": r.choice(["speculative", "direct", None]), "entities": ends or r.choice([[], None]), "aliases": r.choice([None, [], ["n1", "n2"], ["n3"]]), "alternatives": None,
            "date": f"2024-01-0{r.randrange(1, 3)}", "platform": r.choice(["im", None]), "source_hash": f"h{r.randrange(2)}",
        }


def test_signals_act_as_if_one_after_the_other(spark):
    for seed in range(3):
        every = list(signals(seed, 150))
        old = {"e1": {"hash": "h0", "edited": True, "aliases": ["n9", "n1"], "seen": None}, "e2": {"hash": "h1", "edited": False, "aliases": ["n8"], "seen": "then"}, "tasks/a-b": {"hash": "h0", "edited": False, "aliases": None, "seen": None}}
        old["preferences/z-z"] = {"hash": "no", "edited": True, "aliases": None, "seen": None}
        old_links, old_entries = {("decisions/a-b", "e1", "mentions"): ("c", "old", "h")}, {("e1", "2024-01-01", "A b"): ("d", "s", "p")}
        want = one_by_one(every, old, old_links, old_entries)
        pages = spark.createDataFrame([(k, v["hash"], v["edited"], v["aliases"], v["seen"]) for k, v in old.items()], "slug string, source_hash string, edited boolean, aliases array<string>, first_seen string")
        links = spark.createDataFrame([(*k, v[1], v[2]) for k, v in old_links.items()], "src string, dst string, link_type string, provenance string, source_hash string")
        entries = spark.createDataFrame([(*k, v[2]) for k, v in old_entries.items()], "slug string, date string, summary string, provenance string")
        got = store.store(spark.createDataFrame([tuple(s.values()) for s in every], SIGNAL), pages, links, entries)
        made = got["pages"].collect()
        assert {(p.slug, p.source_hash, p.first_seen, p.title) for p in made} == want["pages"]
        names = {p.slug: re.findall("^- (.*)$", p.body.split("## Context")[0], re.M) for p in made if p.body.startswith("## Aliases")}
        assert names == want["names"]
        assert {tuple(t) for t in got["tags"].collect()} == want["tags"]
        assert {tuple(x) for x in got["links"].collect()} == want["links"]
        assert {tuple(x) for x in got["entries"].collect()} == want["entries"]
        assert Counter(map(tuple, got["outcome"].collect())) == want["outcome"]


def test_an_empty_store_and_no_signals(spark):
    none = spark.createDataFrame([], SIGNAL)
    pages = spark.createDataFrame([], "slug string, source_hash string, edited boolean, aliases array<string>, first_seen string")
    links = spark.createDataFrame([], "src string, dst string, link_type string, provenance string, source_hash string")
    entries = spark.createDataFrame([], "slug string, date string, summary string, provenance string")
    assert all(x.count() == 0 for x in store.store(none, pages, links, entries).values())
