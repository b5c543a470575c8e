"""Expressions over single messages: canonical texts, entities, kinds, hashes, admissibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of quick entities, in the order of their kinds.
ENTITIES = {
    "url": r"https?://[^\s<>\]）》]+",
    "email": r"[\w.+-]+@[\w.-]+\.\w{2,}",
    "handle": r"(?<![\w.+-])@[\w.-]{2,}",
    "hashtag": r"#[\w一-鿿]+",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}",
    "ticket_id": r"\b\d{12,15}\b",
}
#: Lines that start the footer of a mail.
FOOTERS = (
    "unsubscribe", "view in browser", "all rights reserved", "此邮件由系统自动发送", "请勿回复", "microsoft teams meeting",
    "join on your computer", "join with a video conferencing device",
)
#: Reply chains, deep quotes and original messages in a mail, in the order in which they are cut.
MAIL_TAILS = (
    r"(?s)\n\s*On [^\n]{10,80} wrote:\s*\n.*", r"\n(>{3,}[^\n]*\n?)+", r"(?is)\n\s*---+\s*Original Message\s*---+.*",
)
#: Words of a playbook, and its conditional branch.
PLAYBOOK_WORDS = ("排查", "步骤", "grep", "日志", "runbook", "playbook")
PLAYBOOK_BRANCH = r"如果[\s\S]{0,40}?则"
#: Labels that say no more of a person than the open id beside them.
GENERIC_LABELS = ("", "user", "feishu user")
#: Channel prefixes and the kinds of source they stand for.
SOURCES = {"mail/": "email", "dm/": "dm", "docs/": "document", "calendar/": "structured"}
#: Channel prefixes and the kinds of source that a block's provenance names.
BLOCK_SOURCES = {
    "dm/": "dm", "group/": "group", "mail/": "email", "docs/": "document", "doc/": "document", "calendar/": "calendar", "task/": "task",
    "agent/": "agent_session",
}
#: The axes of a trait in their order, with their colors.
COLORS = {"D": "red", "I": "yellow", "S": "green", "C": "blue"}


#: What a text must have for an entity of the kind to be in it: far cheaper to look for than the entity.
_SIGNS = {"url": "://", "email": "@", "handle": "@", "hashtag": "#"}
_DIGITS = {"phone": r"\d{3}", "ticket_id": r"\d{12}"}


def _values(x: Column) -> dict[str, Column]:
    """The distinct values of each kind of quick entity."""
    none = F.array().cast("array<string>")
    bare = F.when(x.contains(_SIGNS["url"]), F.regexp_replace(x, ENTITIES["url"], " ")).otherwise(x)

    def found(kind: str, pattern: str) -> Column:
        may = x.contains(_SIGNS[kind]) if kind in _SIGNS else x.rlike(_DIGITS[kind])
        values = F.array_distinct(F.regexp_extract_all(bare if kind == "email" else x, F.lit(pattern), F.lit(0)))
        # a null text has null values
        return F.when(x.isNull() | may, values).otherwise(none)

    return {kind: found(kind, pattern) for kind, pattern in ENTITIES.items()}


def entities(x: Column) -> Column:
    """Distinct (type, value) of the quick entities of a text; mail addresses inside URLs do not count."""
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return F.concat(*[typed(kind, values) for kind, values in _values(x).items()])


def mail_body(x: Column) -> Column:
    """The body of a mail without reply chains, deep quotes, the original message and the footer."""
    for pattern in MAIL_TAILS:
        x = F.regexp_replace(x, pattern, "")
    lines = F.split(x, "\n")
    footer = lambda y: reduce(lambda a, b: a | b, [F.lower(y).contains(f) for f in FOOTERS])
    marks = F.transform(lines, footer)
    at = F.array_position(marks, True).cast("int")
    kept = F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)
    return F.regexp_replace(F.array_join(kept, "\n"), r"\s+$", "")


def mail_text(contact: Column, at: Column, content: Column, to: Column, cc: Column) -> Column:
    """The canonical text of a mail: a header, then the body. What is before the first empty line is the subject; null content is empty."""
    content = F.coalesce(content, F.lit(""))
    cut = F.instr(content, "\n\n")
    subject = F.when(cut > 1, F.substr(content, F.lit(1), cut - 1)).otherwise("")
    body = F.when(cut > 1, F.substr(content, cut + 2, F.length(content))).otherwise(content)
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v, F.lit("\n"))).otherwise("")
    names = lambda v: F.array_join(v, ", ")
    return F.concat(
        F.lit("---\nFrom: "), F.coalesce(contact, F.lit("")), F.lit("\n"), line("Subject", subject), F.lit("Date: "), at, F.lit("\n"),
        line("To", names(to)), line("CC", names(cc)), F.lit("---\n"), mail_body(body),
    )


def entity_hints(x: Column, shown: int = 5) -> Column:
    """One line for each kind of quick entity that a text has: its first values, and how many more there are. Empty without any."""

    def line(kind: str, values: Column) -> Column:
        more = F.when(F.size(values) > shown, F.concat(F.lit(" (+"), (F.size(values) - shown).cast("string"), F.lit(" more)"))).otherwise("")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"- {kind}s: "), F.array_join(F.slice(values, 1, shown), ", "), more))

    lines = lambda e: F.array_join(F.array_compact(F.array(*[line(kind, e[kind]) for kind in ENTITIES])), "\n")
    # a lambda variable keeps the patterns from being sought again for each use of their values
    return F.transform(F.array(F.struct(*[v.alias(kind) for kind, v in _values(x).items()])), lines)[0]


def person_slug(name: Column) -> Column:
    """The slug of a person's name: an open id where the label says nothing else, else kebab of a Latin name; null for other scripts.

    Names in CJK characters need a table of readings (`operators.readings`): they give null.
    """
    clean = F.regexp_replace(name, r"^\s+|\s+$", "")
    oid = F.lower(F.regexp_extract(clean, r"\b(ou_[a-zA-Z0-9]+)\b", 1))
    label = F.regexp_replace(F.regexp_replace(clean, r"(?i)[（(][^）)]*ou_[a-zA-Z0-9]+[^）)]*[）)]", ""), r"(?i)\bou_[a-zA-Z0-9]+\b", "")
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z]+", " "))
    generic = (oid != "") & ~label.rlike("[一-鿿]") & plain.isin(*GENERIC_LABELS)
    bare = F.regexp_replace(F.regexp_replace(clean, r"[（(][^）)]*[）)]", ""), r"^\s+|\s+$", "")
    kebab = F.regexp_replace(F.regexp_replace(F.lower(bare), "'", "-"), r"\s+", "-")
    slug = F.when(generic, oid).when(bare.rlike("^ou_[a-zA-Z0-9]+$"), F.lower(bare)).when(bare.rlike(r"^[a-zA-Z\s\-']+$") & (kebab != ""), kebab)
    return F.when(slug.isNotNull(), F.concat(F.lit("person/"), slug))


def source_type(channel: Column, platform: Column, agents: tuple[str, ...] = ("agent",)) -> Column:
    kind = F.when(platform.isin(*agents), "agent_session")
    for prefix, name in SOURCES.items():
        kind = kind.when(channel.startswith(prefix), name)
    return kind.when(channel == "tasks", "structured").otherwise("chat")


def block_source_type(channel: Column, fallback: Column, platform: Column, agents: tuple[str, ...] = ("agent",)) -> Column:
    """The type of a block's source: of an agent's platform that, else what was found before, else by the channel, more finely than `source_type`."""
    kind = F.when(platform.isin(*agents), "agent_session").when(fallback.isNotNull(), fallback)
    for prefix, name in BLOCK_SOURCES.items():
        kind = kind.when(channel.startswith(prefix), name)
    return kind.when(channel == "tasks", "task").otherwise("chat")


def is_playbook(x: Column) -> Column:
    """Two or more signs of a procedure."""
    hits = [F.lower(x).contains(w).cast("int") for w in PLAYBOOK_WORDS] + [x.rlike(PLAYBOOK_BRANCH).cast("int")]
    return F.coalesce(reduce(lambda a, b: a + b, hits) >= 2, F.lit(False))


def identity_hash(platform: Column, channel: Column, at: Column, *keys: Column) -> Column:
    """SHA-256 of a message's identity; the first key that it has names it."""
    return F.sha2(F.concat_ws(":", platform, channel, F.coalesce(*keys), at), 256)


def content_hash(content: Column, attachments: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(content, F.lit("")), F.lit(":"), F.coalesce(F.array_join(attachments, ","), F.lit(""))), 256)


def handle(kind: Column, value: Column) -> Column:
    """A handle as it is stored: mail addresses and open ids in lower case, names with single blanks."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(kind.isin("email", "open_id"), F.lower(v)).when(kind.isin("name", "nickname"), F.regexp_replace(v, r"\s+", " ")).otherwise(v)


def admissibility(kind: Column, authority: Column) -> Column:
    """Where a signal may go: what only an assistant proposed stays in the log, and so do conclusions that it claims."""
    claimed = F.when(kind.isin("decision", "preference"), "session_log_only").otherwise("canonical")
    return F.when(authority == "assistant_proposed", "session_log_only").when(authority == "user_confirmed", "canonical").otherwise(claimed)


def gate(score: Column, admit: float = 0.85, drop: float = 0.15) -> Column:
    return F.when(score >= admit, "admit").when(score <= drop, "drop").otherwise("evaluate")


def four_colors(levels: Column) -> Column:
    """Colors of the axes that are high, in the order of the axes (a map of axis to level)."""
    high = F.filter(F.array(*map(F.lit, COLORS)), lambda a: F.coalesce(F.try_element_at(levels, a) == "high", F.lit(False)))
    return F.transform(high, lambda a: F.element_at(F.create_map(*[F.lit(v) for kv in COLORS.items() for v in kv]), a))


def redactions(x: Column, kind: str, pattern: str) -> Column:
    """(kind, original, position) of each match, from which a redacted text is restored; positions count from 0.

    The text is cut at each match: a match's position is the length of all that is before it.
    """
    found, rest = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    at = lambda i: F.aggregate(F.slice(rest, 1, i + 1), F.lit(0), lambda t, y: t + F.length(y)) + F.aggregate(
        F.slice(found, 1, i), F.lit(0), lambda t, y: t + F.length(y)
    )
    return F.transform(found, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("original"), at(i).alias("position")))


def sections(x: Column) -> Column:
    """(title, body) of each `## ` section; what is before the first has no title and is left out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), x), "\n## "), 2, 1 << 30)
    trim = lambda y: F.regexp_replace(y, r"^\s+|\s+$", "")
    return F.transform(parts, lambda p: F.struct(
        trim(F.substring_index(p, "\n", 1)).alias("title"),
        trim(F.when(F.instr(p, "\n") > 0, F.substr(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")).alias("body"),
    ))
