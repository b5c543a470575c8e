"""Pages merged in one call against a plain program."""

import random

from engramlake.operators import merging


def test_merges_follow_chains_and_refuse_what_cannot_be_made(spark):
    r = random.Random(4)
    for _ in range(2):
        slugs = [f"p{k:02}" for k in range(24)]
        pages = [(s, r.choice([None, "", " text ", f"{s}\n"]), r.choice([None, [], [f"a{r.randrange(4)}", "b"]])) for s in slugs]
        moves = {(r.choice([*slugs, "gone"]), r.choice([*slugs, "gone"])) for _ in range(14)} | {("p01", "p02"), ("p02", "p01"), ("p03", "p01")}
        links = {(r.choice(slugs), r.choice(slugs), r.choice("xy")) for _ in range(40)}
        entries = {(r.choice(slugs), f"d{r.randrange(2)}", r.choice("st")): r.choice("uv") for _ in range(40)}
        tags = {(r.choice(slugs), r.choice("klm")) for _ in range(40)}
        handles, cache = [("name", f"n{s}", s) for s in slugs], [(f"x{s}", s) for s in slugs]

        first = {}
        for a, b in sorted(moves):
            if a != b and a in slugs and b in slugs:
                first.setdefault(a, b)

        def end(s):
            seen = set()
            while s in first and s not in seen:
                seen.add(s)
                s = first[s]
            return None if s in first else s

        to = {a: end(a) for a in first if end(a) is not None}
        names = dict((s, (b, al)) for s, b, al in pages)
        want = {}
        for s in slugs:
            if s in to:
                continue
            took = [x for x in slugs if to.get(x) == s]
            body, aliases = names[s]
            said = [f"## Merged from {x}\n\n{(names[x][0] or '').strip()}" for x in took if (names[x][0] or "").strip()]
            if said:
                body = "\n\n".join([(body or "").rstrip(), *said])
            if took:
                aliases = list(dict.fromkeys([*(aliases or []), *[y for x in took for y in [*(names[x][1] or []), x]]]))
            want[s] = (body, aliases)
        go = lambda s: to.get(s, s)
        made = merging.merged({
            "pages": spark.createDataFrame(pages, "slug string, body string, aliases array<string>"), "links": spark.createDataFrame(list(links), "src string, dst string, link_type string"),
            "entries": spark.createDataFrame([(*k, v) for k, v in entries.items()], "slug string, date string, summary string, source string"), "tags": spark.createDataFrame(list(tags), "slug string, tag string"),
            "handles": spark.createDataFrame(handles, "kind string, value string, slug string"), "cache": spark.createDataFrame(cache, "external_id string, display_name string"),
        }, spark.createDataFrame(list(moves), "was string, now string"))
        rows = lambda x: [tuple(y) for y in made[x].collect()]
        assert {s: (b, a) for s, b, a in rows("pages")} == want
        moved = {(go(a), go(b), t) for a, b, t in links}
        assert sorted(rows("links")) == sorted(x for x in moved if x[0] != x[1])
        assert sorted(rows("tags")) == sorted({(go(s), t) for s, t in tags})
        keyed = {}
        for (s, d, t), v in sorted(entries.items(), key=lambda x: (x[0][0] in to, x[1])):
            keyed.setdefault((go(s), d, t), v)
        assert {tuple(x[:3]): x[3] for x in rows("entries")} == keyed
        assert sorted(rows("handles")) == sorted([(k, v, go(s)) for k, v, s in handles] + [("slug", a, b) for a, b in to.items()])
        assert sorted(rows("cache")) == sorted((x, go(s)) for x, s in cache)
        assert {x[:2] for x in rows("refused")} == {m for m in moves if first.get(m[0]) != m[1] or m[0] not in to}
